"""Hits to context blocks, prompts and multi-round transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagework import fixed
from passagework.functions.text import text_tokens
from passagework.schemas import TOOL_INPUT


def context_blocks(hits: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """One numbered text block per query (`qid`, or other `keys`). A query has at most its k hits.

    Hits are shuffled by query before grouping: collecting texts in the map
    tasks would save nothing and hold them in memory twice.
    """
    header = F.format_string(fixed.HIT_HEADER, F.col("rank"), F.col("similarity"))
    line = F.concat(header, F.col(text_col))
    lines = F.sort_array(F.collect_list(F.struct(F.col("rank"), line.alias("line"))))
    keys = keys or ("qid",)
    return hits.repartition(*keys).groupBy(*keys).agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("context")
    )


def prompt(context: Column, query: Column) -> Column:
    """Opening, context, request and the query itself; no hits give an empty context."""
    return F.concat(
        F.lit(fixed.PROMPT_OPENING + "\n\n"),
        F.coalesce(context, F.lit("")),
        F.lit("\n\n" + fixed.PROMPT_REQUEST + "\n"),
        query,
    )


def parse_tool_input(
    calls: DataFrame, question: Column, default_k: int, input_col: str = "input_json"
) -> DataFrame:
    """`query` and `top_k` of each recorded call, with the defaults for absent fields.

    `valid` is false when the text is not an object, lacks the required `query` or asks
    for a negative number of hits; the question and the default number then stand in.
    `pretty` is the indented echo.
    """
    parsed = F.from_json(F.col(input_col), TOOL_INPUT)
    return (
        calls.withColumn("_in", parsed)
        .withColumn("countable", F.coalesce(F.col("_in.top_k") >= 0, F.lit(True)))
        .withColumn("valid", F.coalesce(F.col("_in.query").isNotNull(), F.lit(False)) & F.col("countable"))
        .withColumn("query", F.coalesce(F.col("_in.query"), question))
        .withColumn("top_k", F.coalesce(F.when(F.col("countable"), F.col("_in.top_k")), F.lit(default_k)))
        .withColumn("pretty", F.to_json(F.col("_in"), {"pretty": "true"}))
        .drop("_in", "countable")
    )


def tool_rounds(
    calls: DataFrame, order_col: str = "seq", most: int = fixed.MAX_TOOL_ROUNDS
) -> DataFrame:
    """The rounds that are answered: the first `most` calls of each conversation.

    Spark trims every task's share of a conversation to `most` rows before the
    shuffle, so one giant conversation does not land in one task.
    """
    order = Window.partitionBy("conv_id").orderBy(order_col)
    numbered = calls.withColumn("round", F.row_number().over(order))
    return numbered.where(F.col("round") <= most)


def transcript(
    questions: DataFrame, rounds: DataFrame, most: int = fixed.MAX_TOOL_ROUNDS
) -> DataFrame:
    """Message rows `(conv_id, seq, role, content)`.

    seq 0 is the question; round r adds the call at 3r-2, its result at 3r-1,
    and after the last allowed round the stop message at 3r.
    """
    opening = questions.select(
        "conv_id", F.lit(0).alias("seq"), F.lit("user").alias("role"), F.col("query").alias("content")
    )

    def message(offset: int, role: str, content: Column) -> Column:
        return F.struct(
            (F.col("round") * 3 - offset).alias("seq"),
            F.lit(role).alias("role"),
            content.alias("content"),
        )

    call = message(2, "assistant", F.col("input_json"))
    result = message(1, "user", F.coalesce("context", F.lit("")))
    stop = message(0, "user", F.lit(fixed.ROUND_LIMIT_MESSAGE))
    messages = F.when(F.col("round") >= most, F.array(call, result, stop)).otherwise(
        F.array(call, result)
    )
    return opening.unionByName(rounds.select("conv_id", F.inline(messages)))


def prompt_budget(messages: DataFrame, budget: int) -> DataFrame:
    """Running token total per message and whether a prompt that ends here fits.

    A transcript has a bounded number of rows (see `tool_rounds`), so the
    per-conversation window stays small.
    """
    counted = messages.select(
        "conv_id", "seq", "role", text_tokens(F.col("content")).alias("n_tokens")
    )
    upto = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = counted.withColumn("total_tokens", F.sum("n_tokens").over(upto))
    fits = F.col("total_tokens") <= budget
    return total.withColumn("status", F.when(fits, F.lit("ok")).otherwise(F.lit(fixed.TOO_LONG)))
