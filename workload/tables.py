"""Queries: the declarative table interface and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import mutations, tables
from passagework.operators.predicates import where
from workload import sql, views
from workload.registry import query

LINE_KEY = "l_orderkey, l_linenumber, l_partkey, l_quantity"


def _lines(spark, sf):
    return views.table(spark, sf, "lineitem")


def _filtered(df, spec, *fields):
    return where(df, spec).select(*fields)


@query(f"SELECT {LINE_KEY} FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus <> 'F'")
def where_eq_neq(spark, sf):
    spec = {"l_returnflag": {"_eq": "A"}, "l_linestatus": {"_neq": "F"}}
    return _filtered(_lines(spark, sf), spec, *LINE_KEY.split(", "))


@query(
    f"""SELECT {LINE_KEY} FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 30
    AND l_linenumber >= 2 AND l_discount < 0.05"""
)
def where_range(spark, sf):
    spec = {
        "l_quantity": {"_gt": 10, "_lte": 30},
        "l_linenumber": {"_gte": 2},
        "l_discount": {"_lt": 0.05},
    }
    return _filtered(_lines(spark, sf), spec, *LINE_KEY.split(", "))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def where_in(spark, sf):
    spec = {"o_orderpriority": {"_in": ["1-URGENT", "2-HIGH"]}}
    return _filtered(views.table(spark, sf, "orders"), spec, "o_orderkey", "o_orderpriority")


@query(
    r"""SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r_n%' ESCAPE '\'
    AND p_name NOT LIKE 'small%' ESCAPE '\'"""
)
def where_like(spark, sf):
    spec = {"p_name": {"_like": "%r_n%", "_nlike": "small%"}}
    return _filtered(views.table(spark, sf, "part"), spec, "p_partkey", "p_name")


@query("SELECT doc_id, text FROM documents WHERE text ILIKE '%THE %' AND text NOT ILIKE '%Éé%'")
def where_ilike(spark, sf):
    spec = {"text": {"_ilike": "%THE %", "_nilike": "%Éé%"}}
    return _filtered(views.table(spark, sf, "documents"), spec, "doc_id", "text")


@query(
    """SELECT doc_id, text FROM documents WHERE regexp_matches(text, '[0-9]{2}')
    AND NOT regexp_matches(text, '@[a-z]+')"""
)
def where_regex(spark, sf):
    spec = {"text": {"_regex": "[[:digit:]]{2}", "_nregex": "@[[:lower:]]+"}}
    return _filtered(views.table(spark, sf, "documents"), spec, "doc_id", "text")


@query(
    """SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i)THAT|ENTRE')
    AND NOT regexp_matches(text, '(?i)licen[sc]e')"""
)
def where_iregex(spark, sf):
    spec = {"text": {"_iregex": "THAT|ENTRE", "_niregex": "licen[sc]e"}}
    return _filtered(views.table(spark, sf, "documents"), spec, "doc_id", "text")


@query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
def where_starts_with(spark, sf):
    spec = {"p_type": {"starts_with": "S"}}
    return _filtered(views.table(spark, sf, "part"), spec, "p_partkey", "p_type")


@query(
    """SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).')
    AND NOT regexp_full_match(p_brand, '.*[05]')"""
)
def where_similar(spark, sf):
    spec = {"p_brand": {"_similar": "Brand#(1|2)_", "_nsimilar": "%[05]"}}
    return _filtered(views.table(spark, sf, "part"), spec, "p_partkey", "p_brand")


LOGICAL = {
    "_or": [
        {"o_orderstatus": {"_eq": "F"}},
        {"_and": [{"o_totalprice": {"_gt": 200000}}, {"o_custkey": {"_lt": 500}}]},
    ],
    "_not": {"o_orderpriority": {"_like": "5%"}},
}
LOGICAL_SQL = """(o_orderstatus = 'F' OR (o_totalprice > 200000 AND o_custkey < 500))
    AND NOT o_orderpriority LIKE '5%'"""


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {LOGICAL_SQL}")
def where_logical(spark, sf):
    orders = views.table(spark, sf, "orders")
    return _filtered(orders, LOGICAL, "o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {sql.ARTICLES} SELECT id, title FROM articles WHERE title_vector IS NOT NULL")
def where_is_null(spark, sf):
    spec = {"title_vector": {"_is_null": False}}
    return _filtered(views.articles(spark, sf), spec, "id", "title")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en'")
def permission_view(spark, sf):
    docs = views.table(spark, sf, "documents")
    return tables.permission_view(docs, ["doc_id", "lang", "source"], {"lang": {"_eq": "en"}})


@query(
    """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
    ORDER BY o_orderpriority NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey
    LIMIT 50 OFFSET 25"""
)
def order_limit_offset(spark, sf):
    return tables.select_many(
        views.table(spark, sf, "orders"),
        order_by=[{"o_orderpriority": "Asc"}, {"o_totalprice": "Desc"}, {"o_orderkey": "Asc"}],
        limit=50,
        offset=25,
        fields=["o_orderkey", "o_orderpriority", "o_totalprice"],
    )


@query(
    f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {LOGICAL_SQL}
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10"""
)
def select_many(spark, sf):
    return tables.select_many(
        views.table(spark, sf, "orders"),
        where_=LOGICAL,
        order_by=[{"o_totalprice": "Desc"}, {"o_orderkey": "Asc"}],
        limit=100,
        offset=10,
        fields=["o_orderkey", "o_custkey", "o_totalprice"],
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey OFFSET 1000"""
)
def offset_without_limit(spark, sf):
    """Everything after the first thousand rows."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return tables.select_many(
        _lines(spark, sf),
        order_by=[{"l_extendedprice": "Desc"}, *({c: "Asc"} for c in key)],
        offset=1000,
        fields=[*key, "l_extendedprice"],
    )


@query(f"WITH {sql.ARTICLES} SELECT id, title, content FROM articles WHERE id = 42")
def select_by_id(spark, sf):
    return tables.select_by_id(views.documents(spark, sf), 42).select("id", "title", "content")


@query(f"WITH {sql.ARTICLES} SELECT id, title FROM articles WHERE id > 42 ORDER BY id LIMIT 100")
def keyset_page(spark, sf):
    return tables.keyset_page(views.documents(spark, sf), 42, 100).select("id", "title")


@query("SELECT count(*) AS _count, count(quality) AS quality_count FROM labels WHERE toxic = 1")
def agg_count(spark, sf):
    return tables.aggregate(
        views.table(spark, sf, "labels"),
        {"_count": True, "quality": ["_count"]},
        {"where_": {"toxic": {"_eq": 1}}},
    )


@query(
    """SELECT count(l_partkey) AS l_partkey_count, count(DISTINCT l_partkey) AS l_partkey_count_distinct,
           count(DISTINCT l_returnflag) AS l_returnflag_count_distinct FROM lineitem"""
)
def agg_count_distinct(spark, sf):
    spec = {"l_partkey": ["_count", "_count_distinct"], "l_returnflag": ["_count_distinct"]}
    return tables.aggregate(_lines(spark, sf), spec)


@query("SELECT min(text) AS text_min, max(text) AS text_max, min(source) AS source_min FROM documents")
def agg_text_minmax(spark, sf):
    spec = {"text": ["min", "max"], "source": ["min"]}
    return tables.aggregate(views.table(spark, sf, "documents"), spec)


INT_FUNCTIONS = [
    "avg", "bit_and", "bit_or", "bit_xor", "max", "min", "stddev", "stddev_pop", "stddev_samp",
    "sum", "var_pop", "var_samp", "variance",
]
NUMERIC_FUNCTIONS = [f for f in INT_FUNCTIONS if not f.startswith("bit_")]
REAL = ("avg", "stddev", "stddev_pop", "stddev_samp", "var_pop", "var_samp", "variance")


def _rounded(df):
    """Doubles to six digits: their last digits depend on the order of summation."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _aggregate_sql(column: str, functions: list[str], source: str, sum_type: str) -> str:
    terms = []
    for function in functions:
        if function in REAL:
            term = f"round({function}({column}::DOUBLE), 6)"
        elif function == "sum":
            term = f"sum({column})::{sum_type}"
        else:
            term = f"{function}({column})"
        terms.append(f"{term} AS {column}_{function}")
    return f"SELECT {', '.join(terms)} FROM {source}"


@query(_aggregate_sql("l_linenumber", INT_FUNCTIONS, "lineitem", "BIGINT"))
def agg_int(spark, sf):
    return _rounded(tables.aggregate(_lines(spark, sf), {"l_linenumber": INT_FUNCTIONS}))


@query(_aggregate_sql("l_partkey", INT_FUNCTIONS, "lineitem", "DECIMAL(38,0)"))
def agg_bigint(spark, sf):
    return _rounded(tables.aggregate(_lines(spark, sf), {"l_partkey": INT_FUNCTIONS}))


PRICED = "(SELECT l_extendedprice::DECIMAL(15,2) AS price FROM lineitem)"


@query(_aggregate_sql("price", NUMERIC_FUNCTIONS, PRICED, "DECIMAL(25,2)"))
def agg_numeric(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(15,2)").alias("price")
    lines = _lines(spark, sf).select(price)
    return _rounded(tables.aggregate(lines, {"price": NUMERIC_FUNCTIONS}))


@query(
    """SELECT count(*) AS _count, sum(o_custkey)::DECIMAL(38,0) AS o_custkey_sum, max(o_orderkey) AS o_orderkey_max
    FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000 OFFSET 10)"""
)
def agg_over_page(spark, sf):
    return tables.aggregate(
        views.table(spark, sf, "orders"),
        {"_count": True, "o_custkey": ["sum"], "o_orderkey": ["max"]},
        {
            "where_": {"o_orderstatus": {"_eq": "O"}},
            "order_by": [{"o_totalprice": "Desc"}, {"o_orderkey": "Asc"}],
            "limit": 1000,
            "offset": 10,
        },
    )


@query(
    """SELECT count(*) AS _count, min(l_shipdate) AS l_shipdate_min, max(l_shipdate) AS l_shipdate_max,
           sum(l_linenumber)::BIGINT AS l_linenumber_sum, round(avg(l_linenumber), 6) AS l_linenumber_avg,
           count(DISTINCT l_suppkey) AS l_suppkey_count_distinct
    FROM lineitem WHERE l_quantity >= 5 AND l_returnflag IN ('A', 'R')"""
)
def select_aggregate(spark, sf):
    spec = {
        "_count": True,
        "l_shipdate": ["min", "max"],
        "l_linenumber": ["sum", "avg"],
        "l_suppkey": ["_count_distinct"],
    }
    chosen = {"where_": {"l_quantity": {"_gte": 5}, "l_returnflag": {"_in": ["A", "R"]}}}
    return _rounded(tables.aggregate(_lines(spark, sf), spec, chosen))


@query(
    """SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber, l_extendedprice::DECIMAL(15,2)::VARCHAR AS price
    FROM lineitem"""
)
def api_number_strings(spark, sf):
    price = F.col("l_extendedprice").cast("decimal(15,2)").alias("price")
    return tables.number_strings(_lines(spark, sf).select("l_orderkey", "l_linenumber", price))


@query(
    f"""WITH {sql.ARTICLES}, {sql.CHUNKS}
    SELECT a.id, a.title, count(*) AS n_chunks FROM articles a JOIN chunks c ON c.article_id = a.id
    WHERE length(a.content) >= 500 GROUP BY a.id, a.title"""
)
def sql_over_views(spark, sf):
    return tables.query_views(
        spark,
        {"articles": views.documents(spark, sf), "chunks": views.chunks(spark, sf)},
        """SELECT a.id, a.title, count(*) AS n_chunks
           FROM articles a JOIN chunks c ON c.article_id = a.id
           WHERE length(a.content) >= :shortest GROUP BY a.id, a.title""",
        shortest=500,
    )


def _articles(spark, sf):
    return views.documents(spark, sf).select("id", "title", "content")


@query(
    f"""WITH {sql.ARTICLES} SELECT id, title, content FROM articles
    UNION ALL SELECT item_id + 1000000000, text, NULL FROM benchmark"""
)
def mutate_insert(spark, sf):
    objects = views.questions(spark, sf).select(
        (F.col("qid") + 1_000_000_000).alias("id"), F.col("query").alias("title")
    )
    return mutations.insert(_articles(spark, sf), objects, {"title": {"_neq": ""}}).table


@query(
    f"""WITH {sql.ARTICLES}, added AS (SELECT max(id) AS last FROM articles)
    SELECT FALSE AS added, id, title, content FROM articles
    UNION ALL SELECT TRUE, last + (SELECT count(*) FROM benchmark), text, NULL FROM benchmark, added"""
)
def mutate_insert_keyed(spark, sf):
    """Under the model's contract: new titles get the next ids, no title may be NULL.

    Which of them gets which is open: they are shown with the last.
    """
    stored, titles = _articles(spark, sf), views.questions(spark, sf).select(F.col("query").alias("title"))
    last = stored.agg(F.max("id")).first()[0]
    done = mutations.insert(stored, titles, {"title": {"_neq": ""}}, key="id", required=("title",))
    ids = done.returning.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("n")).first()
    if (ids.low, ids.high, ids.n) != (last + 1, last + done.affected_rows, done.affected_rows):
        raise AssertionError("ids are not the next ones")
    added = F.col("id") > last
    shown = F.when(added, F.lit(ids.high)).otherwise(F.col("id")).alias("id")
    return done.table.select(added.alias("added"), shown, "title", "content")


@query(
    f"""WITH {sql.ARTICLES}
    SELECT a.id,
      CASE WHEN l.toxic = 0 AND a.content <> '' THEN 'quality ' || l.quality ELSE a.title END AS title,
      CASE WHEN l.quality = 0 AND a.content <> '' THEN NULL ELSE a.content END AS content
    FROM articles a LEFT JOIN labels l ON l.doc_id = a.id"""
)
def mutate_update(spark, sf):
    """Labelled articles: clean ones get a new title, poor ones lose their text."""
    changes = views.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("quality "), "quality").alias("title"),
        (F.col("toxic") == 0).alias("title_set"),
        F.lit(None).cast("string").alias("content"),
        (F.col("quality") == 0).alias("content_set"),
    )
    return mutations.update(
        _articles(spark, sf),
        changes,
        set_columns=("title", "content"),
        pre_check={"content": {"_neq": ""}},
        post_check={"title": {"_is_null": False}},
    ).table


ONE_ID = 7


@query(
    f"""WITH {sql.ARTICLES}
    SELECT id, CASE WHEN id = {ONE_ID} THEN 'renamed' ELSE title END AS title,
           CASE WHEN id <> {ONE_ID} THEN content END AS content FROM articles"""
)
def mutate_update_by_id(spark, sf):
    changes = {"title": "renamed", "content": None}
    return mutations.update_by_id(_articles(spark, sf), ONE_ID, changes).table


@query(f"WITH {sql.ARTICLES} SELECT id, title, content FROM articles WHERE id <> {ONE_ID}")
def mutate_delete_by_id(spark, sf):
    return mutations.delete_by_id(_articles(spark, sf), ONE_ID).table


DELETE_SQL = """FROM documents WHERE {} (doc_id IN (SELECT doc_id FROM labels) AND lang = 'en')"""


def _delete(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "lang", "text")
    keys = views.table(spark, sf, "labels")
    return mutations.delete(docs, keys, key="doc_id", pre_check={"lang": {"_eq": "en"}})


@query(f"SELECT doc_id, lang, text {DELETE_SQL.format('NOT')}")
def mutate_delete(spark, sf):
    return _delete(spark, sf).table


@query(
    f"SELECT doc_id, lang, text, count(*) OVER () AS affected_rows {DELETE_SQL.format('')}"
)
def mutation_response(spark, sf):
    return mutations.response(_delete(spark, sf))
