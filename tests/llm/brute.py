"""Plain versions of the operators, one text or pair at a time, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def edit_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def line_dedup(docs, edits, min_chars, near=None):
    """docs: [(doc_id, text)] -> {(doc_id, index in docs): (n_lines, n_removed, n_near, n_links, sha)}"""
    near = near or (lambda a, b: edit_distance(a, b) <= edits)
    first = {}
    for doc, text in docs:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            if WORD.search(line):
                place = ((doc is not None, doc or 0), no)
                first[line] = min(first.get(line, place), place)
    links = defaultdict(set)
    lines = sorted((x for x in first if len(x) >= min_chars), key=len)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(b) - len(a) > edits:
                break
            if near(a, b):
                links[a].add(b)
                links[b].add(a)
    out = []
    for doc, text in docs:
        lines = text.split("\n") if text is not None else []
        kept, removed, late, degree = [], 0, 0, 0
        for no, line in enumerate(lines):
            if not WORD.search(line):
                kept.append(line)
                continue
            older = any(first[other] < first[line] for other in links[line])
            late += older
            degree += len(links[line])
            if older or ((doc is not None, doc or 0), no) != first[line]:
                removed += 1
            else:
                kept.append(line)
        out.append((doc, len(lines), removed, late, degree, sha("\n".join(kept))))
    return out


def suffix_dedup(docs, length):
    oldest = {}
    raw = [(doc, (text or "").encode()) for doc, text in docs]
    for doc, data in raw:
        if doc is not None:
            for i in range(len(data) - length + 1):
                s = data[i : i + length]
                if oldest.get(s, doc) >= doc:
                    oldest[s] = doc
    out = []
    for doc, data in raw:
        gone = bytearray(len(data))
        if doc is not None:
            for i in range(len(data) - length + 1):
                if oldest[data[i : i + length]] < doc:
                    gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, sha(kept)))
    return out


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def components(docs, k, percent):
    sets = [(doc, shingles(text, k)) for doc, text in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    done = set()
    for same in holders.values():
        for n, i in enumerate(same):
            for j in same[:n]:
                if (i, j) not in done:
                    done.add((i, j))
                    shared = len(sets[i][1] & sets[j][1])
                    if 100 * shared >= percent * len(sets[i][1] | sets[j][1]):
                        parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        r = root(i)
        least[r] = min(least.get(r, doc), doc)
    return [(doc, len(s), least[root(i)], doc == least[root(i)]) for i, (doc, s) in enumerate(sets)]


def contamination(docs, items, width):
    found = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        m = min(width, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            found[tuple(words[i : i + m])].add(item)
    sizes = sorted({len(w) for w in found})
    out = []
    for doc, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, named = set(), set()
        for m in sizes:
            for i in range(len(words) - m + 1):
                w = tuple(words[i : i + m])
                if w in found:
                    hit.update(range(i, i + m))
                    named |= found[w]
        named = sorted(str(x) for x in named if x is not None)
        out.append((doc, len(words), len(hit), len(named), sha(",".join(named)), len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def base_spans(text):
    """Identifiers by the bare patterns, in order: (kind, start, end)."""
    text, out = text or "", []

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    for n, (kind, pattern, good) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.findall("[0-9]", m[0])) <= 15),
    )):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text) if good(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def piece_faults(docs, pieces, encode, capacity):
    """What is wrong with packed pieces: [(doc_id, start, length, crc, doc_tokens, sequence, offset)]."""
    faults, by_doc, by_sequence = [], defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append(p)
    for doc, text in docs:
        ids = [*encode(text or ""), 0]
        at = 0
        for _, start, length, crc, tokens, _, _ in sorted(by_doc[doc], key=lambda p: p[1]):
            raw = b"".join(int(x).to_bytes(4, "little") for x in ids[start : start + length])
            if start != at or tokens != len(ids) or crc != zlib.crc32(raw):
                faults.append((doc, start))
            at = start + length
        if at != len(ids):
            faults.append((doc, at))
    for sequence, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p[6]):
            if p[6] != at:
                faults.append(("sequence", sequence, p))
            at += p[2]
        if at > capacity:
            faults.append(("sequence", sequence, at))
    return faults
