"""Parts of the operators against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from passagework.llm import blocks, near_dedup, packing, pii, quality, sharding, suffix_array
from passagework.llm.components import smallest_reachable


def test_suffix_array_and_common_prefixes():
    r = np.random.default_rng(0)
    for _ in range(150):
        s = np.append(r.integers(1, r.integers(1, 5) + 1, r.integers(1, 100)), 0).astype(np.uint8)
        text = s.tobytes()
        assert suffix_array.suffix_array(s, 1000).tolist() == sorted(range(len(s)), key=lambda i: text[i:])
        depth = 8 + int(r.integers(0, 30))
        order = suffix_array.suffix_array(s, depth)
        heads = [text[i : i + depth] for i in order]
        assert heads == sorted(heads)
        shared = suffix_array.neighbours(s, order, depth)
        for a, b in zip(order[1:], order[:-1]):
            full = text[a : a + depth] == text[b : b + depth] and len(s) - max(a, b) >= depth
            assert (shared[a] >= depth) == full


def test_splits_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = packing_path()
    with open(path, encoding="utf-8") as file:
        given = file.read()
    mine, real = packing.SplitIds(given), Tokenizer.from_str(given)
    real.encode_special_tokens = True
    r = random.Random(1)
    pool = [*"ab  \n\t'stmdrevl12.,!?é中½٣ 　—’\U0001f642\x1c\x85", "'s", "'re", " '", "<|endoftext|>"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    ids, bounds = mine.encode(*blocks.text_bytes(pa.array(texts)))
    for i, e in enumerate(real.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == e.ids


def test_the_tokenizer_is_asked_for_many_splits_at_once():
    with open(packing_path(), encoding="utf-8") as file:
        mine = packing.SplitIds(file.read())
    real, asked, r = mine.tokenizer, [], random.Random(4)

    class Counted:
        def encode_batch_fast(self, texts, **flags):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **flags)

    mine.tokenizer = Counted()
    odd = ["  ", "\n", "'", "'s", " '", "don", "é\x85", " ", "<|", "endoftext", "|>", "\n\n", "x\ny", "5", " 中½"]
    splits = [*odd, *(" " * (i % 2) + "".join(r.choices("aeiounrst", k=6)) for i in range(5000)), *odd]
    ids, sizes = mine.ask([s.encode() for s in splits])
    ends = sizes.cumsum()
    for split, a, b in zip(splits, ends - sizes, ends):
        assert ids[a:b].tolist() == real.encode(split, add_special_tokens=False).ids
    assert len(asked) < 40
    assert [len(x) for x in mine.ask([])] == [0, 0]


def test_added_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    with open(packing_path(), encoding="utf-8") as file:
        given = file.read()
    mine, real = packing.SplitIds(given), Tokenizer.from_str(given)
    r = random.Random(3)
    pool = [*"ab  \n'stm12.é<|>", "'s", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "\U0001f642"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 12))) for _ in range(3000)] + ["", "x<|endof", "text|>", "<|endoftext|>"]
    ids, bounds = mine.encode_added(*blocks.text_bytes(pa.array(texts)))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == real.encode(text, add_special_tokens=False).ids
    apart = mine.encode_added(*blocks.text_bytes(pa.array(["x<|endof", "text|>", None])))
    assert apart[0].tolist() == [i for t in ("x<|endof", "text|>") for i in real.encode(t, add_special_tokens=False).ids]


def packing_path():
    from passagework.llm.queries import tokenizer_path

    return tokenizer_path()


def test_first_fit():
    r = random.Random(2)
    sizes = sorted((r.randint(1, 100) for _ in range(300)), reverse=True)
    rooms, plain = packing.Rooms(len(sizes), 100), []
    for n in sizes:
        at = next((i for i, room in enumerate(plain) if room >= n), len(plain))
        if at == len(plain):
            plain.append(100)
        assert rooms.put(n) == (at, plain[at])
        plain[at] -= n


def test_differencing_keeps_the_sums():
    r = np.random.default_rng(4)
    sums = r.integers(0, 1000, (60, 4))
    place, total = sharding.difference(sums)
    again = np.zeros(4, int)
    for row, to in zip(sums, place):
        assert sorted(to) == [0, 1, 2, 3]
        again[to] += row
    assert again.tolist() == total.tolist() and again.max() - again.min() <= 50


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(1, 40)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    out = {x.id: x.component for x in smallest_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {x: root(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to jane.doe (at) mail.example (dot) com now", "email", "jane.doe (at) mail.example (dot) com"),
        ("write to jane[at]example[dot]org.", "email", "jane[at]example[dot]org"),
        ("reach jane at example dot com please", "email", "jane at example dot com"),
        ("see jаne@exаmple.com here", "email", "jаne@exаmple.com"),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("host 10 dot 20 dot 30 dot 40 up", "ip", "10 dot 20 dot 30 dot 40"),
        ("host 10[.]20[.]30[.]40 up", "ip", "10[.]20[.]30[.]40"),
        ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
        ("card four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one"),
        ("card ４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises(text, kind, found):
    start = text.index(found)
    base, every = pii.all_identifiers(text)
    assert (start, pii.KINDS.index(kind), start + len(found)) in every
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    assert pii.signs(batch)[0] or pii.needs_rewriting(text)


def gate(text):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    return bool(pii.signs(batch)[0]) or pii.needs_rewriting(text)


@pytest.mark.parametrize(
    "text",
    [
        "write to jane at example.com", "write to jane_at_example.com", "jane-at-example.com", "jane arroba example.com", "jane@example . com",
        "call plus 49 170 1234567", "card four 1 one 1 one 1 1 1 1 1 one 1 1 1 1 1 now", "call plus «four nine three zero one two three four five six»",
        "card FÜNF 1 zéro 5 1 0 5 1 0 5 1 0 5 1 cero 0",
    ],
)
def test_gate_lets_lone_disguises_through(text):
    assert pii.revealed(text).text != text and gate(text)
    assert pii.all_identifiers(text, gate(text)) == pii.all_identifiers(text, True)


@pytest.mark.parametrize(
    "address",
    [
        "jane (at) mail (dot) online", "jane [at] firm [dot] tech", "jane {at} art (dot) museum", "jane at firm [dot] tech", "jane (at) firm dot tech",
        "jane（at）mail （dot） online", "jane (at) my.firm.online", "jane @ firm (dot) tech",
    ],
)
def test_bracketed_addresses_have_any_ending(address):
    for text in (address, f"Write to {address}, or call."):
        start = text.index(address)
        assert pii.all_identifiers(text, gate(text))[1] == [(start, 0, start + len(address))]


def test_plain_words_need_an_ending():
    for text in ("look at it dot now", "meet at noon.Then (at) last", "he was at home dot nobody saw"):
        assert pii.all_identifiers(text)[1] == []


def test_gate_misses_nothing():
    r = random.Random(12)
    pool = [
        "jane", "mail", "com", "at", "arroba", "dot", "punkt", "point", "PLUS", "plus", "4", "49", "170", "1234567", "one", "Two", "three", "fünf", "FÜNF", "zéro",
        "null", "(at)", "[dot]", "(a)", "@", ".", " . ", " @", "@ ", "_at_", "-dot-", "_", "-", ",", "«", "”", "İ", "l1", "O0", "example.com", "+", "\n", "\x85", " ", "\t",
    ]
    changed = 0
    for _ in range(20000):
        text = r.choice(["", " "]).join(r.choice(pool) for _ in range(r.randint(1, 12)))
        if not gate(text):
            assert pii.revealed(text).text == text
        changed += pii.revealed(text).text != text
        assert pii.all_identifiers(text, gate(text)) == pii.all_identifiers(text, True)
    assert changed > 2000


def test_plain_texts_have_no_disguise():
    for text in ("He looked at the dot on page 7.", "un deux trois nous irons au bois", "Version 1.2.3 at one point in time", "ten o l 1l"):
        assert pii.all_identifiers(text) == ([], [])


def test_identifiers_like_the_bare_patterns():
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice("a.@+-1 0(9)%_\n") for _ in range(r.randint(0, 40)))
        assert [(pii.KINDS[k], a, b) for a, k, b in pii.identifiers(text)] == brute.base_spans(text)


def test_attention_learns_from_bags():
    r = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(300):
        bag = r.standard_normal((r.integers(1, 9), quality.FEATURES)).astype(np.float32)
        if i % 2:
            bag[r.integers(len(bag)), 0] = 6
        bags.append(bag)
        labels.append(i % 2)
    model = quality.fit(bags[:200], np.array(labels[:200], float))
    bounds = np.cumsum([0, *map(len, bags[200:])])
    score = model.forward(np.concatenate(bags[200:]), bounds)
    assert np.mean((score > 0.5) == np.array(labels[200:])) > 0.9


def test_gradients():
    r = np.random.default_rng(2)
    model = quality.Model()
    x, bounds, labels = r.standard_normal((9, quality.FEATURES)), np.array([0, 4, 5, 9]), np.array([1.0, 0, 1])
    loss = lambda: -np.sum(np.log(np.where(labels == 1, s := model.forward(x, bounds), 1 - s)))
    slopes = model.gradients(model.forward(x, bounds) - labels)
    for name, slope in slopes.items():
        at = tuple(r.integers(n) for n in slope.shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - slope[at]) < 1e-4


@pytest.mark.parametrize(("slots", "width"), [(near_dedup.SLOTS, near_dedup.SKETCH_BITS), (near_dedup.FINE_SLOTS, near_dedup.FINE_BITS)])
def test_odd_sketches_keep_similar_sets(slots, width):
    r = np.random.default_rng(8)
    limit = near_dedup.most_odd_bits(0.8, slots, width)
    sets = [r.integers(0, 1 << 63, 180, dtype=np.uint64) for _ in range(300)]
    pairs = [(s[:90], np.concatenate([s[:80], s[170:180]])) for s in sets]  # 80 of 100 shared
    apart = [(s[:90], s[45:135]) for s in sets]  # a third shared
    for group, near in ((pairs, True), (apart, False)):
        flat = [np.sort(x) for pair in group for x in pair]
        samples = near_dedup.minhashes(np.concatenate(flat), np.cumsum([0, *map(len, flat)]), slots)
        bits = near_dedup.odd_sketches(samples, width).view(np.uint64)
        odd = np.bitwise_count(bits[0::2] ^ bits[1::2]).sum(axis=1)
        assert np.all(odd <= limit) if near else np.mean(odd > limit) > 0.9
