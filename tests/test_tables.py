import datetime
from decimal import Decimal

import pytest

from passagework.operators import mutations, pages, tables
from passagework.operators.context import parse_tool_input, prompt_budget, tool_rounds
from passagework.operators.predicates import predicate, where
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "Alpha", 10), (2, "beta_x", None), (3, None, 30), (4, "a\\bc", 40), (5, "tab 12", 10)],
        "id int, name string, n int",
    )


@pytest.mark.parametrize(
    "spec, ids",
    [
        ({"n": {"_eq": 10}}, [1, 5]),
        ({"n": {"_neq": 10}}, [3, 4]),
        ({"n": {"_gt": 10, "_lte": 30}}, [3]),
        ({"n": {"_gte": 30}}, [3, 4]),
        ({"n": {"_lt": 30}}, [1, 5]),
        ({"n": {"_in": [30, 40]}}, [3, 4]),
        ({"n": {"_in": []}}, []),
        ({"name": {"_like": "%a%"}}, [1, 2, 4, 5]),
        ({"name": {"_nlike": "%a%"}}, []),
        ({"name": {"_like": r"beta\_x"}}, [2]),
        ({"name": {"_like": r"b\eta%"}}, [2]),
        ({"name": {"_like": r"a\\bc"}}, [4]),
        ({"name": {"_ilike": "A%"}}, [1, 4]),
        ({"name": {"_nilike": "A%"}}, [2, 5]),
        ({"name": {"_regex": "[[:digit:]]+"}}, [5]),
        ({"name": {"_nregex": "[[:digit:]]"}}, [1, 2, 4]),
        ({"name": {"_regex": r"\m12\M"}}, [5]),
        ({"name": {"_iregex": "^A"}}, [1, 4]),
        ({"name": {"_niregex": "^A"}}, [2, 5]),
        ({"name": {"_similar": "(Al|tab)%"}}, [1, 5]),
        ({"name": {"_nsimilar": "(Al|tab)%"}}, [2, 4]),
        ({"name": {"_similar": "b_ta"}}, []),
        ({"name": {"starts_with": "be"}}, [2]),
        ({"name": {"ts_match_tt": "12 TAB"}}, [5]),
        ({"name": {"_is_null": True}}, [3]),
        ({"n": {"_is_null": False}, "name": {"_is_null": False}}, [1, 4, 5]),
        ({"_or": [{"id": {"_eq": 2}}, {"_and": [{"n": {"_eq": 10}}, {"id": {"_gt": 1}}]}]}, [2, 5]),
        ({"_not": {"n": {"_eq": 10}}}, [3, 4]),
        ({"_and": []}, [1, 2, 3, 4, 5]),
        ({"_or": []}, []),
        ({}, [1, 2, 3, 4, 5]),
    ],
)
def test_where(rows, spec, ids):
    assert [r.id for r in where(rows, spec).orderBy("id").collect()] == ids


def test_unknown_operator(rows):
    with pytest.raises(ValueError, match="_almost"):
        predicate({"n": {"_almost": 1}})


def test_filters_reach_the_scan(spark, sf, plan):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan(
        tables.select_many(
            docs,
            where_={"lang": {"_eq": "en"}, "n_chars": {"_gt": 100}},
            order_by=[{"n_chars": "Desc"}, {"doc_id": "Asc"}],
            limit=5,
            offset=2,
            fields=["doc_id", "n_chars"],
        )
    )
    assert "EqualTo(lang,en)" in text and "GreaterThan(n_chars,100)" in text
    assert "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text


def test_null_order(rows):
    def ids(direction):
        out = tables.select_many(rows, order_by=[{"n": direction}, {"id": "Asc"}])
        return [r.id for r in out.collect()]

    assert ids("Asc") == [1, 5, 3, 4, 2]
    assert ids("Desc") == [2, 4, 3, 1, 5]
    with pytest.raises(ValueError):
        ids("Up")


def page_rows():
    values = [(i, None if i % 3 == 0 else i % 7, ["a", "B", None, "é"][i % 4], float("nan") if i % 11 == 0 else i / 7) for i in range(400)]
    return values, "id long, n int, s string, f double"


def in_order(rows, order):
    """Sorted by the stated rules: NULLs last ascending, first descending; NaN above all numbers."""
    out = list(rows)
    for place, way in reversed(order):
        value = lambda r: (r[place] is not None, isinstance(r[place], float) and r[place] != r[place], 0 if r[place] is None or r[place] != r[place] else r[place])
        plain = lambda r: 0 if r[place] is None else value(r)[1:]
        some, none = [r for r in out if r[place] is not None], [r for r in out if r[place] is None]
        some.sort(key=plain, reverse=way == "Desc")
        out = some + none if way == "Asc" else none + some
    return out


@pytest.mark.parametrize("order", ["n Desc, id Asc", "s Asc, f Desc, id Desc", "f Asc, id Asc", "s Desc, n Asc, id Asc"])
@pytest.mark.parametrize("offset, limit", [(0, 40), (13, 200), (137, None), (399, 1), (400, 5), (950, None), (20, 0), (395, 50), (150, 8), (160, 170)])
def test_deep_pages(spark, order, offset, limit):
    rows, schema = page_rows()
    order = [tuple(part.split()) for part in order.split(", ")]
    df = spark.createDataFrame(rows, schema).repartition(5)
    out = pages.page(df, order, offset, limit, edge_rows=15)
    wanted = in_order(rows, [("id n s f".split().index(c), way) for c, way in order])
    end = None if limit is None else offset + limit
    assert [r.id for r in out.collect()] == [r[0] for r in wanted[offset:end]]


def test_deep_pages_sort_only_their_ends(spark, plan):
    df = spark.range(0, 5000, 1, 5).selectExpr("id", "hash(id) % 1000 n")
    out = pages.page(df, [("n", "Desc"), ("id", "Asc")], 1700, 2000, edge_rows=100)
    # the ends are top-n over a filter on the keys; the rest is filtered only
    shown = plan(out)
    assert shown.count("TakeOrderedAndProject") == 2 and "GlobalLimit" not in shown
    wanted = sorted((-r.n, r.id) for r in df.collect())[1700:3700]
    assert [(-r.n, r.id) for r in out.collect()] == wanted
    low, high = pages.borders(df, [("n", "Desc"), ("id", "Asc")], 1700, pages.Border(None, 0), pages.Border(None, 5000), 100)
    assert low.rows <= 1700 < high.rows <= low.rows + 100
    assert pages.between(df, [("n", "Desc"), ("id", "Asc")], low, high).count() == high.rows - low.rows


def test_deep_page_over_equal_rows(spark):
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "1 n")
    page = pages.page(df, [("n", "Asc")], 300, 450, edge_rows=10)
    assert page.columns == ["id", "n"]
    assert page.select("id").distinct().count() == page.count() == 450
    assert pages.page(df, [], 990, None, edge_rows=10).count() == 10
    same = spark.range(0, 300, 1, 4).selectExpr("1 n", "cast(null as string) s")
    assert pages.page(same, [("s", "Desc")], 100, 150, edge_rows=10).count() == 150


def test_by_id_and_pages(rows):
    assert [r.id for r in tables.select_by_id(rows, 4).collect()] == [4]
    assert [r.id for r in tables.keyset_page(rows, 2, 2).collect()] == [3, 4]
    assert tables.keyset_page(rows, 5, 2).count() == 0


def test_aggregate_types_and_subset(spark, rows):
    out = tables.aggregate(
        rows,
        {"_count": True, "n": ["sum", "avg", "_count", "_count_distinct", "bit_or"], "name": ["min"]},
    )
    assert tuple(out.first()) == (5, 90, 22.5, 4, 3, 62, "Alpha")
    assert dict(out.dtypes)["n_sum"] == "bigint"
    page = {"order_by": [{"id": "Desc"}], "limit": 2, "offset": 1}
    assert tables.aggregate(rows, {"n": ["sum"]}, page).first()["n_sum"] == 70
    wide = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "v long")
    assert tables.aggregate(wide, {"v": ["sum"]}).first()["v_sum"] == Decimal(3 * 2**62)
    one = tables.aggregate(rows.limit(1), {"n": ["stddev", "var_samp", "var_pop"]}).first()
    assert tuple(one) == (None, None, 0.0)


def test_permission_and_number_strings(spark, rows):
    seen = tables.permission_view(rows, ["id"], {"n": {"_gt": 10}})
    assert seen.columns == ["id"] and seen.count() == 2
    wide = spark.createDataFrame([(1, 2**40, Decimal("1.50"))], "i int, l long, d decimal(5,2)")
    assert tuple(tables.number_strings(wide).first()) == (1, str(2**40), "1.50")


def test_sql_with_arguments(spark, rows):
    out = tables.query_views(spark, {"t": rows}, "SELECT count(*) c FROM t WHERE n = :n", n=10)
    assert out.first()["c"] == 2


def test_insert_is_all_or_nothing(spark, rows):
    new = spark.createDataFrame([(6, "six"), (7, "seven")], "id int, name string")
    done = mutations.insert(rows, new, {"name": {"_neq": ""}})
    assert (done.affected_rows, done.table.count()) == (2, 7)
    assert done.returning.columns == rows.columns
    with pytest.raises(mutations.CheckFailed):
        mutations.insert(rows, new, {"id": {"_lt": 7}})
    with pytest.raises(mutations.CheckFailed):  # a check that is NULL does not hold
        mutations.insert(rows, new, {"n": {"_gt": 0}})


def test_update_by_id_null_is_not_absent(rows):
    done = mutations.update_by_id(rows, 1, {"n": None})
    assert done.affected_rows == 1
    assert tuple(done.table.where("id = 1").first()) == (1, "Alpha", None)
    assert mutations.update_by_id(rows, 1, {"n": 5}, pre_check={"n": {"_gt": 99}}).affected_rows == 0
    with pytest.raises(mutations.CheckFailed):
        mutations.update_by_id(rows, 1, {"n": 5}, post_check={"n": {"_gt": 99}})
    assert mutations.update_by_id(rows, 77, {"n": 5}).affected_rows == 0


def test_update_many(spark, rows):
    changes = spark.createDataFrame(
        [(1, None, True, "x", False), (2, 7, True, "y", True), (3, 8, False, "z", True), (9, 1, True, "w", True)],
        "id int, n int, n_set boolean, name string, name_set boolean",
    )
    done = mutations.update(rows, changes, set_columns=("n", "name"), pre_check={"id": {"_lte": 2}})
    assert {tuple(r) for r in done.returning.collect()} == {(1, "Alpha", None), (2, "y", 7)}
    assert done.affected_rows == 2 and done.table.count() == 5
    with pytest.raises(ValueError, match="more than once"):
        mutations.update(rows, changes.union(changes), set_columns=("n",))
    with pytest.raises(mutations.CheckFailed):
        mutations.update(rows, changes, set_columns=("n",), post_check={"n": {"_is_null": False}})


def test_delete(spark, rows):
    keys = spark.createDataFrame([(1,), (1,), (2,), (99,)], "id int")
    done = mutations.delete(rows, keys, pre_check={"n": {"_eq": 10}})
    assert done.affected_rows == 1
    assert sorted(r.id for r in done.table.collect()) == [2, 3, 4, 5]
    one = mutations.delete_by_id(rows, 3)
    assert [tuple(r) for r in mutations.response(one).collect()] == [(3, None, 30, 1)]
    assert mutations.delete_by_id(rows, 3, pre_check={"name": {"_eq": "x"}}).table.count() == 5


def test_tool_input(spark):
    calls = spark.createDataFrame(
        [(1, '{"query":"a","top_k":2}'), (2, '{"top_k":2}'), (3, "broken"), (4, '{"query":"b"}')],
        "seq int, input_json string",
    )
    out = parse_tool_input(calls, F.lit("the question"), 5).orderBy("seq").collect()
    assert [(r.query, r.top_k, r.valid) for r in out] == [
        ("a", 2, True), ("the question", 2, False), ("the question", 5, False), ("b", 5, True),
    ]


def test_tool_rounds_trim_a_hot_conversation_before_the_shuffle(spark, plan):
    calls = spark.range(300).selectExpr("if(id % 3 = 0, 0, id) conv_id", "id seq")
    rounds = tool_rounds(calls)
    assert "row_number(), 5, Partial" in plan(rounds)
    hot = rounds.where("conv_id = 0").orderBy("round").collect()
    assert [(r.seq, r["round"]) for r in hot] == [(0, 1), (3, 2), (6, 3), (9, 4), (12, 5)]


def test_prompt_budget(spark):
    messages = spark.createDataFrame(
        [(1, 0, "user", "aaaa"), (1, 1, "user", "bbbb bbbb")], "conv_id int, seq int, role string, content string"
    )
    out = prompt_budget(messages, 3).orderBy("seq").collect()
    assert [(r.n_tokens, r.total_tokens, r.status) for r in out] == [
        (2, 2, "ok"), (3, 5, "prompt is too long"),
    ]


def test_insert_with_a_key(spark, rows):
    new = spark.createDataFrame([(None, "six"), (None, "seven"), (9, "nine")], "id int, name string")
    done = mutations.insert(rows, new, key="id", required=("name",))
    assert sorted((r.id, r.name) for r in done.returning.collect())[0] == (9, "nine")
    assert sorted(r.id for r in done.returning.collect()) == [9, 10, 11]
    assert done.table.count() == done.table.select("id").distinct().count() == 8
    for bad in ([(1, "stored")], [(7, "twice"), (7, "twice")], [(7, None)]):
        with pytest.raises(mutations.CheckFailed):
            mutations.insert(rows, spark.createDataFrame(bad, "id int, name string"), key="id", required=("name",))
