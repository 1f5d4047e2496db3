"""Batches are published whole after their checks, or not at all."""

import pytest

from passagework import schemas
from passagework.session import new_path
from passagework.sources import published

ARTICLE = "id long, title string, content string, title_vector array<float>"
CHUNK = "chunk_id long, article_id long, content_chunk string, content_chunk_vector array<float>"


@pytest.fixture
def stored(spark):
    path = new_path(spark, "published")
    published.create(spark, path)
    good = spark.createDataFrame([(1, "a", "x", [1.0, 2.0]), (2, "b", None, None)], ARTICLE)
    assert published.append_articles(good, path, dim=2) == 1
    return path


def rows(spark, path):
    return sorted((r.id, r.title) for r in published.read(spark, path, schemas.ARTICLES).collect())


def test_batches_add_up(spark, stored):
    more = spark.createDataFrame([(3, "c", "y", None)], ARTICLE)
    assert published.append_articles(more, stored, dim=2) == 2
    assert published.append_articles(more.where("false"), stored, dim=2) == 3
    assert rows(spark, stored) == [(1, "a"), (2, "b"), (3, "c")]
    assert published.read(spark, stored, schemas.ARTICLES).where("processed_timestamp IS NULL").count() == 0


@pytest.mark.parametrize(
    "row, name",
    [
        ((2, "again", "x", None), "stored_keys"),
        ((None, "none", "x", None), "null_keys"),
        ((9, None, "x", None), "null_titles"),
        ((9, "t" * 256, "x", None), "long_titles"),
        ((9, "v", "x", [1.0]), "wrong_vectors"),
        ((8, "twice", "x", None), "repeated_keys"),
    ],
)
def test_a_broken_batch_leaves_the_table(spark, stored, row, name):
    batch = spark.createDataFrame([(8, "good", "x", None), row], ARTICLE)
    with pytest.raises(published.Rejected) as caught:
        published.append_articles(batch, stored, dim=2)
    assert caught.value.broken == {name: 1}
    assert rows(spark, stored) == [(1, "a"), (2, "b")]


def test_chunks_need_their_articles(spark, stored):
    articles = published.read(spark, stored, schemas.ARTICLES)
    path = new_path(spark, "published")
    published.create(spark, path)
    chunks = [(1, 1, "t", [1.0, 2.0]), (2, None, "t", None), (3, 7, "t", None), (4, 7, "t", None)]
    with pytest.raises(published.Rejected) as caught:
        published.append_chunks(spark.createDataFrame(chunks, CHUNK), path, articles, dim=2)
    assert caught.value.broken == {"orphans": 2}
    assert published.read(spark, path, schemas.CHUNKS).count() == 0
    assert published.append_chunks(spark.createDataFrame(chunks[:2], CHUNK), path, articles, dim=2) == 1
    assert published.read(spark, path, schemas.CHUNKS).count() == 2


def test_a_second_writer_fails(spark, stored, monkeypatch):
    """A batch whose version number was taken meanwhile is not published."""
    batch = spark.createDataFrame([(5, "late", "x", None)], ARTICLE)
    newest = published._newest(spark, stored)
    published.append_articles(spark.createDataFrame([(4, "first", "x", None)], ARTICLE), stored, dim=2)
    monkeypatch.setattr(published, "_newest", lambda *_: newest)
    with pytest.raises(published.Conflict):
        published.append_articles(batch, stored, dim=2)
    monkeypatch.undo()
    assert rows(spark, stored) == [(1, "a"), (2, "b"), (4, "first")]
    with pytest.raises(published.Conflict):
        published.create(spark, stored)


def test_unpublished_folders_are_not_read(spark, stored):
    """What a job left that died before its manifest does not count."""
    spark.createDataFrame([(77, "lost", "x", None)], ARTICLE).write.parquet(f"{stored}/data-lost")
    assert rows(spark, stored) == [(1, "a"), (2, "b")]
