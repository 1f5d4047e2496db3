"""Queries' operators and pipeline stages over tables whose columns have the names that are used inside."""

import pytest

from passagework.llm import decontaminate, fingerprints, host_rules, language, lexical, line_dedup, near_dedup, packing, pii, quality, sharding, suffix_dedup
from passagework.llm.queries import remainder, tokenizer_path
from pyspark.sql import functions as F

NAMES = [
    "wanted", "wanted_id", "gone", "left", "n_near", "n_links", "removed_id", "removed_row", "bad_id", "dropped_id", "row", "line", "line_no", "keys",
    "key", "h1", "h2", "first", "band", "id", "c", "c0", "c1", "hc", "hub", "sketch", "fine", "found", "label", "held_out", "score", "predicted", "spans",
    "items", "n", "words", "size", "shard", "slot", "group", "place", "range", "guest", "vector", "part", "terms", "counts", "count", "kept", "kept_text", "rep",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


def texts():
    words = [f"w{i % 97}x{i % 13}" for i in range(4000)]
    page = lambda i, n: " ".join(words[(i * 37 + j) % 4000] for j in range(n))
    base = [f"{page(i, 40)}\n{page(i + 500, 30)}\nshared line of quite some words here" for i in range(30)]
    near = [t.replace("w5x5", "w5y5", 1) for t in base[:5]]
    return [*base, *base[:3], *near, None, "", " \n", "x", page(3, 6000)]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(None if i == 33 else i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or ""), *[f"{n}-{i}" for n in NAMES]) for i, t in enumerate(texts())]
    rows.append(rows[4])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0, "x") for i in range(30)], "doc_id long, quality int, toxic int, label string")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(texts()[2].split()[:20]), "x"), (None, None, "y")], "item_id long, text string, words string")


STAGES = {
    "quality": lambda d, labels, items: quality.accepted(d, labels, remainder(5) == 0),
    "line dedup": lambda d, labels, items: line_dedup.without_repeats(d),
    "near dedup": lambda d, labels, items: near_dedup.keep_one(d),
    "decontamination": lambda d, labels, items: decontaminate.without_contaminated(d, items),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_other_columns(documents, labels, benchmark, name):
    """Every kept row is a row of the input; only line dedup changes texts and their lengths."""
    out = STAGES[name](documents, labels, benchmark)
    assert out.columns == documents.columns and [f.dataType for f in out.schema] == [f.dataType for f in documents.schema]
    free = {"text", "n_chars"} if name == "line dedup" else set()
    shown = lambda r: tuple(r[c] for c in r.__fields__ if c not in free)
    before = [shown(r) for r in documents.collect()]
    after = [shown(r) for r in out.collect()]
    assert after and all(after.count(r) <= before.count(r) for r in set(after))


OPERATORS = {
    "line dedup": lambda d, labels, items: line_dedup.deduplicated(d),
    "quality": lambda d, labels, items: quality.quality_scores(d, labels, remainder(5) == 0),
    "suffix dedup": lambda d, labels, items: suffix_dedup.deduplicated(d),
    "sharding": lambda d, labels, items: sharding.sharded(d),
    "packing": lambda d, labels, items: packing.packed(d, tokenizer_path()),
    "language": lambda d, labels, items: language.languages(d, remainder(3) == 1),
    "host rules": lambda d, labels, items: host_rules.judged_texts(d),
    "pii": lambda d, labels, items: pii.personal_data(d),
    "near dedup": lambda d, labels, items: near_dedup.near_duplicates(d),
    "decontamination": lambda d, labels, items: decontaminate.contamination(d, items),
    "lexical": lambda d, labels, items: lexical.ranked_documents(d, items),
    "fingerprints": lambda d, labels, items: fingerprints.edited_fingerprints(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_ignore_other_columns(documents, labels, benchmark, name):
    plain = documents.select("doc_id", "text", "lang", "source")
    run = lambda d: sorted(map(repr, OPERATORS[name](d, labels.drop("label"), benchmark.drop("words")).collect()))
    wide = sorted(map(repr, OPERATORS[name](documents, labels, benchmark).collect()))
    assert wide and wide == run(plain)


def test_rejected_copies_go_with_their_doc_id(spark, labels):
    """Rows that share a doc_id with a rejected row go; rows without doc_id are judged by themselves."""
    good, bad = texts()[0], "### *** $$$ " * 50
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(30)] + [(40, good), (40, bad), (None, good), (None, bad)], "doc_id long, text string")
    scored = {(r.doc_id, r.text) for r in quality.accepted(docs, labels, F.lit(False)).collect()}
    scores = quality.quality_scores(docs, labels, F.lit(False)).collect()
    assert {r.predicted for r in scores} == {0, 1}
    assert (None, good) in scored and (None, bad) not in scored and 40 not in {i for i, _ in scored}
    assert {i for i, _ in scored if i is not None} == set(range(1, 30, 2))
