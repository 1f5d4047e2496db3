"""Personal data in texts, also where it is disguised, with spans of the source text.

Emails, IP addresses, card and phone numbers are found in the text as it is. A text with signs
of disguise is also passed through transducers, which rewrite it and keep for every character
the source characters it stands for: homoglyphs, wide and invisible characters become plain
ones, spelled digits become digits (in runs of `DIGIT_RUN` words at least), "(at)", "[dot]",
" at ", " dot " and the like become @ and dots where an address can be. What is found there
and does not overlap what the text itself had of that kind is added, mapped back to the source.
An email written with white space but without any bracketed sign may be plain words: it needs an
ending of two letters (no short word) or one of `LONG_ENDINGS`.

Null and empty texts have no spans. Rows with an equal doc_id are searched one by one.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from passagework.llm import blocks
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
DIGIT_RUN = 3

_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its start fails at every later digit too
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# fixed values: names of the digits in the languages of the texts
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝнкмтвАЕОРСУХІЈЅНКМТВαονρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
        "aeopcyxijshdqwhkmtbAEOPCYXIJSHKMTBaovptuikABEZHIKMNOPTYXig",
    )
)
_INVISIBLE = "­​‌‍⁠﻿"
_OTHER = {**{c: "-" for c in "‐‑‒–—−"}, **{c: "." for c in "․。｡"}}

_AT_WORD, _DOT_WORD = r"(?:at|arroba|a|@|＠)", r"(?:dot|punkt|punto|point|d0t|\.)"
# fixed values: words of two letters that end no address when it is written with spaces
SHORT_WORDS = frozenset("am an as at be by do go he if in is it me my no of oh on or so to up us we".split())
LONG_ENDINGS = frozenset("com org net edu gov mil int info biz name pro io ai app dev eu example test".split())

_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_BRACKET = re.compile(rf"\s*{_OPEN}\s*{_AT_WORD}\s*{_CLOSE}\s*", re.I)
_DOT_BRACKET = re.compile(rf"\s*{_OPEN}\s*{_DOT_WORD}\s*{_CLOSE}\s*", re.I)
_AT_PLAIN = re.compile(r"(?<=[A-Za-z0-9])(?:\s+at\s+|[_-]at[_-]|\s+arroba\s+)(?=[A-Za-z0-9-]+(?:\.|\s+(?:dot|punkt|punto|point)\s+|[_-]dot[_-])[A-Za-z0-9])", re.I)
_DOT_PLAIN = re.compile(r"(?<=[A-Za-z0-9])(?:\s+(?:dot|punkt|punto|point)\s+|[_-]dot[_-])(?=[A-Za-z0-9])", re.I)
_AT_SPACED = re.compile(r"(?<=[A-Za-z0-9])(?: +@ *| *@ +)(?=[A-Za-z0-9-]+ ?\. ?[A-Za-z0-9])")
_DOT_SPACED = re.compile(r"(?<=[A-Za-z0-9]) \. ?(?=[A-Za-z0-9])")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORDS}|[0-9])(?:(?:\s*,\s*|\s+|-)(?:{_WORDS}|[0-9]))*(?![^\W_])", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus[\s-]+(?=[0-9])", re.I)
_DIGIT_LIKE = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OoIl]*[0-9])[0-9OoIl]+(?![A-Za-z0-9])")
_BRACKET_SIGN = re.compile(rf"{_OPEN}\s*(?:{_AT_WORD}|{_DOT_WORD})\s*{_CLOSE}", re.I)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outwards."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            found.append((start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def ips(text: str) -> list[tuple[int, int]]:
    fits = lambda part: len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(fits, m.groups()))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all identifiers as they stand, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(a, 1, b) for a, b in ips(text)]
        found += [(a, 2, b) for a, b in cards(text)]
        if "+" in text:
            found += [(a, 3, b) for a, b in phones(text)]
    return sorted(found)


@cache
def plain(c: str) -> str | None:
    """What a character stands for, if that is another one; empty for invisible ones."""
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in _OTHER:
        return _OTHER[c]
    if unicodedata.category(c) == "Zs" and c != " ":
        return " "
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded != c and folded.isascii() else None


class Rewritten:
    """A text and, for each of its characters, the source characters from `first` to `last`."""

    def __init__(self, text: str):
        self.text = text
        self.first = list(range(len(text)))
        self.last = [i + 1 for i in self.first]
        self.bracketed: list[int] = []  # where in the source a bracketed sign began

    def replace(self, pattern: re.Pattern, by) -> list[int]:
        """Every match gives way to `by(match)`; a match is left alone where that is None.

        Gives the source positions where the replaced matches began.
        """
        out, first, last, begins, at = [], [], [], [], 0
        for m in pattern.finditer(self.text):
            new = by(m)
            a, b = m.span()
            if new is None or a == b:
                continue
            out += (self.text[at:a], new)
            begins.append(self.first[a])
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            at = b
        if out:
            self.text = "".join(out) + self.text[at:]
            self.first = first + self.first[at:]
            self.last = last + self.last[at:]
        return begins

    def replace_chars(self) -> None:
        changed = [(i, p) for i, c in enumerate(self.text) if not c.isascii() and (p := plain(c)) is not None]
        if changed:
            out = list(self.text)
            for i, p in changed:
                out[i] = p
            keep = [i for i, c in enumerate(out) if c]
            self.text = "".join(out)
            self.first, self.last = [self.first[i] for i in keep], [self.last[i] for i in keep]

    def spell_digits(self) -> None:
        """Runs of spelled digits as digits, each digit with the word it stands for."""
        token = re.compile(rf"{_WORDS}|[0-9]|\s*,\s*|\s+|-", re.I)
        out, first, last, at = [], [], [], 0
        for run in _SPELLED.finditer(self.text):
            parts = list(token.finditer(self.text, *run.span()))
            if sum(p[0].lower() in DIGIT_WORDS for p in parts) < DIGIT_RUN:
                continue
            a, b = run.span()
            out.append(self.text[at:a])
            first += self.first[at:a]
            last += self.last[at:a]
            for p in parts:
                out.append(DIGIT_WORDS.get(p[0].lower()) or (p[0] if p[0] in "-0123456789" else " "))
                first.append(self.first[p.start()])
                last.append(self.last[p.end() - 1])
            at = b
        if out:
            self.text = "".join(out) + self.text[at:]
            self.first, self.last = first + self.first[at:], last + self.last[at:]


def revealed(text: str) -> Rewritten:
    """The text without disguises."""
    out = Rewritten(text)
    if not text.isascii():
        out.replace_chars()
    out.spell_digits()
    out.replace(_PLUS, lambda m: "+")
    out.replace(_DIGIT_LIKE, lambda m: None if m[0].isdigit() else m[0].replace("O", "0").replace("o", "0").replace("I", "1").replace("l", "1"))
    out.bracketed += out.replace(_AT_BRACKET, lambda m: "@")
    out.bracketed += out.replace(_DOT_BRACKET, lambda m: ".")
    out.replace(_AT_PLAIN, lambda m: "@")
    if "@" in out.text or _DIGIT.search(out.text):
        out.replace(_DOT_PLAIN, lambda m: ".")
        out.replace(_AT_SPACED, lambda m: "@")
        if "@" in out.text:
            out.replace(_DOT_SPACED, lambda m: ".")
    return out


def _is_ending(label: str) -> bool:
    return label in LONG_ENDINGS or (len(label) == 2 and label.isalpha() and label not in SHORT_WORDS)


def all_identifiers(text: str, disguised: bool = True) -> tuple[list, list]:
    """Spans in the text as it is, and all spans."""
    base = identifiers(text)
    if not disguised:
        return base, base
    out = revealed(text)
    if out.text == text:
        return base, base
    added = []
    for a, kind, b in identifiers(out.text):
        start, end = out.first[a], out.last[b - 1]
        if kind == 0 and re.search(r"\s", text[start:end]) and not _is_ending(out.text[a:b].rpartition(".")[2].lower()):
            if not any(start <= x < end for x in out.bracketed):
                continue  # plain words that happen to have an at and a dot among them
        if not any(k == kind and x < end and start < y for x, k, y in base):
            added.append((start, kind, end))
    return base, sorted(base + added)


@cache
def _sign_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the last ASCII parts of the digits' names, and of numerals and the names' other parts."""

    def of(words: list[str]) -> np.ndarray:
        data, offsets = blocks.text_bytes(pa.array(words))
        return np.sort(blocks.Words(data, offsets, blocks.alphanumeric()).hashes())

    parts = [re.findall("[a-z]+", name) for name in DIGIT_WORDS]
    return of([p[-1] for p in parts]), of([*"0123456789", *{x for p in parts for x in p[:-1]}])


def signs(part: pa.RecordBatch) -> np.ndarray:
    """Which texts may hold spelled digits: `DIGIT_RUN` names with nothing but names and numerals between.

    All texts where `_SPELLED` finds as many names: its runs are names and single numerals with no
    letter or digit between. Words are runs of ASCII letters and digits here, since quotes and the
    like may touch a name, so a name counts by its last part ("nf" of "fünf") and others go along.
    """
    data, offsets = blocks.text_bytes(part.column("text"))
    ascii_words = blocks.alphanumeric() & (np.arange(256) < 128)
    words = blocks.Words(blocks.lowered()[data], offsets, ascii_words)
    hashes, row = words.hashes(), np.repeat(np.arange(part.num_rows), words.counts)
    name, between = (np.isin(hashes, h) for h in _sign_hashes())
    either = name | between
    begins = either.copy()
    begins[1:] &= ~either[:-1] | (row[1:] != row[:-1])
    run = np.cumsum(begins)
    long_ = np.bincount(run[name], minlength=run[-1] + 1 if len(run) else 1) >= DIGIT_RUN
    out = np.zeros(part.num_rows, bool)
    out[row[either & long_[run]]] = True
    return out


def needs_rewriting(text: str) -> bool:
    """Whether a rule of `revealed` other than the spelled digits' applies to the text as it is.

    The first rule that applies meets the text unchanged, so where this and `signs` are false
    `revealed` changes nothing.
    """
    if not text.isascii() and any(plain(c) is not None for c in set(text) if not c.isascii()):
        return True
    if _BRACKET_SIGN.search(text) or _AT_PLAIN.search(text):
        return True
    digit, at = _DIGIT.search(text), "@" in text
    if digit and (_PLUS.search(text) or any(not m[0].isdigit() for m in _DIGIT_LIKE.finditer(text))):
        return True
    if (digit or at) and _DOT_PLAIN.search(text):
        return True
    return at and bool(_AT_SPACED.search(text) or _DOT_SPACED.search(text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks.slices(batch, "text"):
            rows = []
            for doc, text, sign in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), signs(part).tolist()):
                text = text or ""
                base, every = all_identifiers(text, sign or needs_rewriting(text))
                counts = [sum(kind == k for _, kind, _ in every) for k in range(len(KINDS))]
                rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row; see the module's text.

    The counts are those of all spans.
    """
    return blocks.narrowed(documents, "doc_id", "text").mapInArrow(_search, _FOUND)
