from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from passagework import fixed, schemas
from passagework.functions.embedding import HashingProvider
from passagework.functions.urls import normalize_url, title_from_url
from passagework.operators import constraints, embed, extract, ingest
from passagework.plans import loading
from passagework.session import new_path
from passagework.sources import readers, sinks
from passagework.streaming import incremental


def column(spark, values, expression):
    df = spark.createDataFrame([(v,) for v in values], "u string")
    return [r[0] for r in df.select(expression(F.col("u"))).collect()]


def test_normalize_url(spark):
    urls = [None, "", "en.x.org/a", "http://x/a", "https://x/a#f", "HTTP://x", "ftp://x"]
    assert column(spark, urls, normalize_url) == [
        None, None, "https://en.x.org/a", "http://x/a", "https://x/a#f", "https://HTTP://x",
        "https://ftp://x",
    ]


def test_title_from_url(spark):
    urls = [
        "https://x/wiki/A;b?x=1#f", "https://x/wiki/C%2B%2B_a+b", "https://x/100%_x",
        "https://x/AC%2FDC", "https://x/en/12/", "https://x", "https://x?q=/a", "https://x/a/%C3%A9t%c3%a9",
        "https://x/%zz_%4", "https://x/#a/b", "https://x/A_(b)|c d", "https://x/%FF",
    ]
    expected = [unquote(urlparse(u).path.split("/")[-1]).replace("_", " ") for u in urls]
    assert column(spark, urls, title_from_url) == expected
    assert expected[:6] == ["A", "C++ a+b", "100% x", "AC/DC", "", ""]


def questions(spark):
    rows = [
        (0, "en.x.org/a", None, "https://en.x.org/b"),
        (1, "https://en.x.org/a", "", "http://en.x.org/a"),
        (2, "known.org/k", "en.x.org/c\nd", None),
    ]
    p = fixed.LINK_COLUMN_PREFIX
    return spark.createDataFrame(rows, f"q_id long, {p}1 string, {p}2 string, {p}11 string")


def test_unpivot_skips_missing_columns_and_nulls(spark):
    rows = sorted((r.q_id, r.slot, r.link) for r in ingest.unpivot_links(questions(spark)).collect())
    assert rows == [
        (0, 1, "en.x.org/a"), (0, 11, "https://en.x.org/b"), (1, 1, "https://en.x.org/a"), (1, 2, ""),
        (1, 11, "http://en.x.org/a"), (2, 1, "known.org/k"), (2, 2, "en.x.org/c\nd"),
    ]


def test_new_urls_first_wins_and_known_are_left_out(spark):
    links = ingest.normalized_links(ingest.unpivot_links(questions(spark)))
    known = spark.createDataFrame([("https://known.org/k",)] * 3, "url string")
    rows = sorted(map(tuple, ingest.new_urls(links, known).collect()))
    assert rows == [
        ("http://en.x.org/a", 1, 11),
        ("https://en.x.org/a", 0, 1),
        ("https://en.x.org/b", 0, 11),
        ("https://en.x.org/c\nd", 2, 2),
    ]
    again = ingest.new_urls(links, known.union(ingest.new_urls(links, known).select("url")))
    assert again.count() == 0


def test_hot_url_is_reduced_before_the_shuffle(spark, plan):
    links = spark.range(30).selectExpr("id q_id", "1 slot", "if(id % 3 = 0, 'https://hot', concat('https://', id)) url")
    text = plan(ingest.first_per_url(links))
    assert text.index("partial_min") > text.index("Exchange")  # below it in the tree
    assert ingest.first_per_url(links).where("url = 'https://hot'").first()["q_id"] == 0


def test_tsv_round_trip_with_quotes_and_line_breaks(spark):
    path = new_path(spark, "tsv")
    source = questions(spark)
    source.coalesce(1).write.options(
        sep="\t", header=True, quote='"', escape='"', ignoreTrailingWhiteSpace=False
    ).csv(path)
    back = readers.read_questions_tsv(spark, path)
    assert dict(back.dtypes)["q_id"] == "bigint"
    # an empty field is a missing link
    wanted = {tuple(v or None for v in r) if r.q_id else tuple(r) for r in source.collect()}
    assert {tuple(r) for r in back.collect()} == wanted


def test_outcomes_append_and_rejects(spark):
    extracted = spark.createDataFrame(
        [
            ("https://x/good_one", "text"),
            ("https://x/empty", ""),
            ("https://x/none", None),
            ("https://x/" + "t" * 256, "text"),
            ("https://x/" + "t" * 255, "text"),
        ],
        "url string, content string",
    )
    rows = ingest.with_serial(ingest.article_rows(extracted), "url", 10)
    summary = {r.status: r.n_rows for r in ingest.ingest_summary(rows).collect()}
    assert summary == {"processed": 2, "no content": 2, "error": 1}
    path = new_path(spark, "articles")
    rejects = sinks.append_articles(rows, path)
    assert rejects.count() == 3
    stored = readers.read_articles(spark, path)
    assert {len(r.title) for r in stored.collect()} == {8, 255}
    assert stored.where("processed_timestamp IS NULL OR title_vector IS NOT NULL").count() == 0


def test_serial_numbers_are_dense_repeatable_and_continue(spark):
    df = spark.range(5000).selectExpr("concat('u', id) url")
    first = {r.url: r.id for r in ingest.with_serial(df, "url", 7).collect()}
    second = {r.url: r.id for r in ingest.with_serial(df.repartition(3), "url", 7).collect()}
    assert first == second
    assert sorted(first.values()) == list(range(8, 5008))
    assert ingest.next_serial(spark.createDataFrame([], "id long")) == 0


def test_chunk_ids_are_unique_and_continue(spark):
    rows = spark.createDataFrame(
        [(7, c, p) for c in range(3) for p in range(2)] + [(9, 0, 0), (8, 2, 1)],
        "article_id int, chunk_no int, part_no int",
    )
    numbered = ingest.with_chunk_ids(rows, 100).orderBy("article_id", "chunk_no", "part_no").collect()
    ids = [r.chunk_id for r in numbered]
    assert ids == sorted(set(ids)) and ids[0] == 101
    assert ingest.with_chunk_ids(rows.where("false"), 0).count() == 0


def test_loading_flow_twice(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://en.x.org/a", page("one")),
            (2, "https://en.x.org/a", page("other capture")),
            (3, "https://en.x.org/b", "<p>no root"),
            (4, "https://known.org/k", page("known")),
            (5, "https://unused.org/u", page("unused")),
            (6, "http://en.x.org/a", page("plain")),
        ],
        "page_id long, url string, html string",
    )
    path = new_path(spark, "articles")
    known = spark.createDataFrame([(50, "https://known.org/k")], "id long, url string")
    summary = loading.load_articles(questions(spark), pages, known, path)
    assert {r.status: r.n_rows for r in summary.collect()} == {"processed": 2, "no content": 2}
    stored = readers.read_articles(spark, path)
    assert {(r.url, r.content) for r in stored.collect()} == {
        ("https://en.x.org/a", "one"), ("http://en.x.org/a", "plain"),
    }
    assert all(50 < r.id <= 54 for r in stored.collect())
    again = known.unionByName(stored.select("id", "url"))
    summary = loading.load_articles(questions(spark), pages, again, path)
    assert {r.status: r.n_rows for r in summary.collect()} == {"no content": 2}
    assert readers.read_articles(spark, path).count() == 2

    out, provider = new_path(spark, "chunks"), HashingProvider(4, 20)
    sinks.create_table(spark, out, schemas.CHUNKS)
    empty = readers.read_chunks(spark, out)
    assert loading.embed_new_articles(stored, empty, out, provider).count() == 0
    chunks = readers.read_chunks(spark, out)
    assert chunks.count() == 2 == chunks.select("chunk_id").distinct().count()
    sinks.create_table(spark, out, schemas.CHUNKS)
    loading.embed_new_articles(stored, chunks, out, provider)
    assert readers.read_chunks(spark, out).count() == 2


def test_constraints(spark):
    articles = spark.createDataFrame(
        [(1, "a", [1.0, 2.0]), (1, None, None), (None, "t" * 256, [1.0]), (3, "c", None)],
        "id int, title string, title_vector array<float>",
    )
    report = constraints.constraint_report(articles, 2).first().asDict()
    assert report == {
        "null_ids": 1, "duplicate_ids": 1, "null_titles": 1, "long_titles": 1, "wrong_vectors": 1,
    }
    chunks = spark.createDataFrame([(1,), (9,), (9,), (None,)], "article_id int")
    rows = constraints.fk_violations(chunks, articles.where("id is not null")).collect()
    assert [tuple(r) for r in rows] == [(9, 2)]


def test_resume(spark):
    articles = spark.range(1, 6).selectExpr("id", "concat('t', id) title")
    chunks = spark.createDataFrame([(3,), (3,), (1,)], "article_id long")
    assert [r.id for r in embed.resume_watermark(articles, chunks).orderBy("id").collect()] == [4, 5]
    assert embed.resume_watermark(articles, chunks.where("false")).count() == 5
    pending = embed.articles_without_chunks(articles, chunks).orderBy("id")
    assert [r.id for r in pending.collect()] == [2, 4, 5]


def page(text):
    return f'<div id="{fixed.CONTENT_ROOT_ID}"><p>{text}</p></div>'


def test_incremental_ingest_adds_new_urls_once(spark):
    pages, target = new_path(spark, "pages"), new_path(spark, "sink")
    schema = "page_id long, url string, html string"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(pages)

    deliver([(1, "https://x/a", page("one")), (2, "https://x/b", page("two")), (3, "https://x/a", page("three"))])
    incremental.run(spark, pages, target)
    deliver([(4, "https://x/b", page("again")), (5, "https://x/c", page("four")), (6, "https://x/d", "<p>no root")])
    for _ in range(2):
        incremental.run(spark, pages, target)
    rows = incremental.stored(spark, target, "articles").orderBy("page_id").collect()
    assert [(r.page_id, r.title, r.content, r.batch_id) for r in rows] == [
        (1, "a", "one", 0), (2, "b", "two", 0), (5, "c", "four", 1),
    ]
    chunks = incremental.stored(spark, target, "chunks").orderBy("article_id").collect()
    assert [(r.article_id, r.chunk_no, r.content_chunk) for r in chunks] == [
        (1, 0, "one"), (2, 0, "two"), (5, 0, "four"),
    ]


def test_wikitext_column(spark):
    df = spark.createDataFrame([("'''a'''",), (None,)], "raw string")
    cleaned = extract.clean_wikitext(df, "raw").collect()
    assert [r.content for r in cleaned] == ["a", None]
    assert [r.error for r in cleaned] == [None, "no text"]


def test_incremental_ingest_keeps_its_rejects(spark):
    pages, target = new_path(spark, "pages"), new_path(spark, "sink")
    rows = [(1, "https://x/a", page("one")), (2, "https://x/b", "<p>no root"), (3, "https://x/" + "t" * 256, page("long"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(pages)
    incremental.run(spark, pages, target)
    rejects = incremental.stored(spark, target, "rejects").orderBy("page_id").collect()
    assert [(r.page_id, r.status, r.batch_id) for r in rejects] == [(2, "no content", 0), (3, "error", 0)]


def test_chunk_constraints(spark):
    chunks = spark.createDataFrame(
        [(1, 1, [1.0, 2.0]), (1, 9, [1.0]), (None, 9, None), (4, None, None)],
        "chunk_id long, article_id long, content_chunk_vector array<float>",
    )
    articles = spark.createDataFrame([(1,)], "id long")
    report = constraints.chunk_constraint_report(chunks, articles, 2).first().asDict()
    assert report == {"null_ids": 1, "duplicate_ids": 1, "wrong_vectors": 1, "orphans": 2}
