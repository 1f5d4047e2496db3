"""Ranked search against plain loops on messy tables, and its exact tiles."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from passagework.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n long, terms string, counts int, score long, rank int, term string"
ITEMS = "item_id long, text string, term string, doc_id long"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, counts, n in held:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in own if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def messy():
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéßЖ1_-") for _ in range(r.randint(1, 4))) for _ in range(150)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, line(r.randint(1, 60))) for i in range(200)]
    docs += [(500 + i, docs[3][1].upper()) for i in range(60)]  # ties
    docs += [(3, docs[4][1]), (3, docs[4][1]), (None, docs[3][1]), (None, docs[3][1]), (900, None), (901, ""), (902, "... ,;"), (903, line(20000)), (904, "ÀÉ àé")]
    items = [(i, line(r.randint(1, 15))) for i in range(30)] + [(40, docs[3][1]), (40, "zzz new"), (41, None), (42, ""), (None, docs[4][1]), (43, "nowhere"), (44, "ÀÉ"), (45, line(3000))]
    return docs, items


@pytest.mark.parametrize("top, block_terms", [(10, 1 << 20), (3, 100), (1, 1 << 20)])
def test_like_plain_loops(spark, top, block_terms):
    docs, items = messy()
    documents = spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, "y") for i, t in docs], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEMS)
    rows = lexical.ranked_documents(documents, benchmark, top, block_terms).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == plain(docs, items, top)


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b", "x", 1)], ITEMS)
    docs = spark.createDataFrame([(1, "a", 1, "x", 2, 3, 4, "y")], DOCS)
    assert [lexical.ranked_documents(d, i).count() for d, i in ((none, some), (docs, no_items), (docs, some))] == [0, 0, 1]


def test_tiles_in_pieces_are_exact(monkeypatch):
    r = np.random.default_rng(4)
    rows, terms_, impact = np.sort(r.integers(0, 30, 400)), r.integers(0, 90, 400), r.integers(1, lexical.MOST_IMPACT, 400)
    entries = sorted(set(zip(rows.tolist(), terms_.tolist())))
    rows, terms_ = np.array(entries).T
    impact = impact[: len(rows)]
    asked = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 12, 200), r.integers(20, 99, 200))})
    item_of, item_terms = np.array(asked).T
    weights = r.integers(0, 1 << 33, 100)
    wanted = np.zeros((30, 12), object)
    for row, term, value in zip(rows.tolist(), terms_.tolist(), impact.tolist()):
        for item, other in asked:
            if term == other:
                wanted[row, item] += value * int(weights[term])
    for piece in (1, 7, 2048):
        monkeypatch.setattr(lexical, "TILE_TERMS", piece)
        assert lexical.tile_scores(rows, terms_, impact, 30, item_of, item_terms, 12, weights).tolist() == wanted.tolist()


def test_best_keeps_small_ids_of_ties():
    r = random.Random(5)
    best, seen = lexical.Best(3, 4), []
    docs = list(range(300))
    r.shuffle(docs)
    for start in range(0, 300, 37):
        ids = np.array(docs[start : start + 37])
        scores = np.array([[r.choice((0, 1, 2, 2)), 2, r.randint(0, 50)] for _ in ids])
        best.add(0, scores, ids)
        seen += [(item, -int(s[item]), int(d)) for d, s in zip(ids, scores) for item in range(3) if s[item] > 0]
    wanted = [x for item in range(3) for x in sorted(s for s in seen if s[0] == item)[:4]]
    assert list(zip(best.item.tolist(), (-best.score).tolist(), best.doc.tolist())) == wanted
