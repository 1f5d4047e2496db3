"""The pipeline's stages, and the queries over the smallest tables."""

import brute
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from passagework.llm.sql import SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_the_columns_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS
        assert docs.count() <= before
    kept = docs.collect()
    assert kept and len({r.doc_id for r in kept}) == len(kept)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(x[5] for x in brute.contamination([(r.doc_id, r.text) for r in kept], items, 13))
    assert all(x[3] for x in brute.components([(r.doc_id, r.text) for r in kept], 5, 80) if x[0] is not None)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept}


#: Their rows are not documents.
OTHERS = ("op11_whitening", "op12_lexical_search")


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n not in OTHERS])
def test_queries_cover_all_documents(spark, sf, name):
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in entry.queries()[name](spark, sf).collect()} == ids


def test_whitening_covers_all_vectors(spark, sf):
    rows = entry.queries()["op11_whitening"](spark, sf).collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert {(r.vec_id, r.component) for r in rows} == {(i, c) for i in ids for c in range(1, 5)}
    assert all(r.identity_error < 1e-9 for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
