import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.functions import arrays, chunking, text
from passagework.operators import chunk, table_functions

texts = st.text(alphabet="ab \n\u00e9\u00a0", max_size=60)


def one_each(words):
    return np.array([0 if w == "" else 1 for w in words], np.int64)


def walk(body, budget, count):
    """The rules, one word at a time."""
    out, current, used = [], [], 0
    words = []
    for line in body.split("\n"):
        words += [*line.split(" "), "\n"]
    for word, size in zip(words, count(words)):
        if used + size > budget:
            out.append((" ".join(current).strip(), used))
            current, used = [word], size
        else:
            current.append(word)
            used += size
    out.append((" ".join(current).strip(), used))
    kept = [(b, int(n)) for b, n in out if b]
    return [(i, b, n) for i, (b, n) in enumerate(kept)]


@settings(deadline=None, max_examples=300)
@given(texts, st.integers(1, 9), st.sampled_from([one_each, chunking.estimate_counts]))
def test_same_as_the_word_by_word_walk(body, budget, count):
    assert list(chunking.chunks(body, budget, count)) == walk(body, budget, count)


@settings(deadline=None, max_examples=200)
@given(texts, st.integers(1, 9))
def test_words_survive_in_order_and_budgets_hold(body, budget):
    cut = list(chunking.chunks(body, budget))
    assert " ".join(b for _, b, _ in cut).split() == body.split()
    for _, b, tokens in cut:
        assert tokens <= budget or " " not in b.replace("\n", "").strip()


def test_rules_by_example():
    count = one_each
    assert list(chunking.chunks("a  b \n c", 3, count)) == [(0, "a  b", 3), (1, "c", 2)]
    assert list(chunking.chunks("aaaaaaaaaaaaa b", 2)) == [(0, "aaaaaaaaaaaaa", 4), (1, "b", 2)]
    assert list(chunking.chunks("\n\n\n", 2)) == []
    # an inner newline keeps a space on both sides
    assert list(chunking.chunks("a\nb", 9, count)) == [(0, "a \n b", 4)]


def test_column_expressions_agree_with_the_helper(spark):
    bodies = ["", "a", "a b", " a  b \n\nccccc ", "\n", "\u00e9 x y", "\U0001f600" * 9, "a\u00a0b\tc\r\nd"]
    rows = (
        spark.createDataFrame([(b,) for b in bodies], "t string")
        .select(
            "t",
            text.words(F.col("t")).alias("w"),
            text.text_tokens(F.col("t")).alias("n"),
            F.transform(text.words(F.col("t")), text.estimated_tokens).alias("each"),
        )
        .collect()
    )
    for row in rows:
        assert row.each == list(chunking.estimate_counts(row.w))
        assert row.w == chunking.split_words(row.t)
        assert row.n == chunking.estimate_counts(row.w).sum()


def test_jobs(spark):
    docs = spark.createDataFrame(
        [(1, "aaaa bbbb cccc dddd"), (2, ""), (3, None), (4, "x")], "id int, content string"
    )
    cut = chunk.chunk_documents(docs, budget=2)
    assert sorted(map(tuple, cut.collect())) == [
        (1, 0, "aaaa bbbb", 2), (1, 1, "cccc dddd", 2), (1, 2, "", 1), (4, 0, "x", 2),
    ][:2] + [(4, 0, "x", 2)]
    stats = {r.article_id: tuple(r)[1:] for r in chunk.chunk_stats(cut).collect()}
    assert stats == {1: (2, 4, 2), 4: (1, 2, 2)}
    again = chunk.rechunk_oversize(cut, 1, budget=1)
    assert sorted(map(tuple, again.select("article_id", "chunk_no", "part_no", "content_chunk").collect())) == [
        (1, 0, 0, "aaaa"), (1, 0, 1, "bbbb"), (1, 1, 0, "cccc"), (1, 1, 1, "dddd"), (4, 0, 0, "x"),
    ]
    kept = chunk.rechunk_oversize(cut, 5)
    assert kept.where("part_no = 0").count() == cut.count() == kept.count()


def test_table_function(spark, plan):
    table_functions.register_chunk_text(spark)
    spark.createDataFrame([(1, "aaaa bbbb"), (2, None), (3, ""), (4, "x")], "id int, text string").repartition(2).createOrReplaceTempView("texts")
    found = spark.sql("SELECT * FROM chunk_text(TABLE(texts), 1)")
    assert sorted(map(tuple, found.collect())) == [(1, 0, "aaaa", 1), (1, 1, "bbbb", 1), (4, 0, "x", 1)]
    assert "ArrowEvalPythonUDTF" in plan(found)
    with pytest.raises(Exception, match="the budget must be positive"):
        spark.sql("SELECT * FROM chunk_text(TABLE(texts), 0)").collect()


def test_chunking_runs_once_per_text(spark, plan):
    docs = spark.createDataFrame([(1, "a")], "id int, content string").repartition(2, "id")
    assert plan(chunk.chunk_documents(docs)).count("ArrowEvalPython") == 1


def test_parts_of_batches_hold_few_bytes_and_full_requests(monkeypatch):
    texts = pa.array(["x" * 400, None, "y" * 700, "", "z" * 5000, None, None, "u", "v", "w"])
    numbers = pa.array(range(10))
    monkeypatch.setattr(arrays, "SLICE_BYTES", 1000)
    parts = list(arrays.slices(texts, numbers))
    assert [p.to_pylist() for _, p in parts] == [[0, 1], [2, 3], [4], [5, 6, 7, 8, 9]]
    assert [t for p, _ in parts for t in p.to_pylist()] == texts.to_pylist()
    for step in (2, 3):
        sizes = [len(p) - p.null_count for p, _ in arrays.slices(texts, numbers, step=step)]
        assert all(n % step == 0 for n in sizes[:-1]) and sum(sizes) == 7
    assert list(arrays.slices(texts[:0])) == []


def test_workers_hand_texts_on_in_parts(spark, monkeypatch):
    """A batch of many texts is neither read nor returned as a whole."""
    handed = chunk.chunker(4).func(iter([pa.array(["a b\nc"] * 5001)]))
    sizes = [len(part) for part in handed]
    assert sum(sizes) == 5001 and max(sizes) <= arrays.SLICE_ROWS
    body = "word " * 3000
    rows = spark.range(300, numPartitions=1).select(F.col("id"), F.when(F.col("id") % 7 > 0, F.lit(body)).alias("content"))
    counts = chunk.chunk_documents(rows, budget=1000).groupBy("article_id").count().collect()
    assert sorted(r["article_id"] for r in counts) == [i for i in range(300) if i % 7]
    assert {r["count"] for r in counts} == {len(list(chunking.chunks(body, 1000)))}
