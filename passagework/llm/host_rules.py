"""Quality rules with a verdict for each host, in SQL functions only.

Every text gets counts of words, symbols, repeated lines and repeated three-word windows, and
fails the base rules by too few words or too much repetition. Failures are counted for each
host (`source`; null is a host of its own). A beta prior is fitted to the hosts' failure
rates by moments, every host's rate is shrunk towards it, and the texts of a host whose
shrunk rate exceeds `MAX_RATE` are not kept. Small hosts lean on the prior, so a single bad
page does not condemn its host.

A window is compared by two 64-bit hashes of its words, whatever the text's length; a text of
a million windows has a chance near 1e-27 that two different ones agree. Null, empty and word-less texts have zeros and fail. Rows with an equal doc_id
are judged one by one. Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from passagework.session import write_and_read
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_RATE = 0.5

SECOND_SEED = 0x5EED
_GAP = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def text_counts(documents: DataFrame) -> DataFrame:
    """doc_id, source and the counts of every text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = documents.select(
        "doc_id",
        "source",
        F.filter(F.split(text, _GAP), lambda w: w != "").alias("words"),
        F.length(F.translate(text, _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    step = step.select(
        "doc_id", "source", "words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size("words"), F.lit(0)).alias("n"),
    )
    # a window: its hashes and its number; equal windows are neighbours when sorted
    words = "w, get(words, i + 1), get(words, i + 2)"
    window = f"transform(slice(words, 1, greatest(n - 2, 0)), (w, i) -> struct(xxhash64({words}) AS a, xxhash64({SECOND_SEED}, {words}) AS b, CAST(i AS long) AS i))"
    step = step.select("doc_id", "source", "word_chars", "n_symbols", "n_dup_lines", "n", F.sort_array(F.expr(window)).alias("sorted"))
    same = "coalesce(x.a = get(sorted, i {0} 1).a AND x.b = get(sorted, i {0} 1).b, false)"
    twice = f"filter(sorted, (x, i) -> {same.format('-')} OR {same.format('+')})"
    places = F.sort_array(F.expr(f"transform({twice}, x -> x.i)"))
    step = step.select("doc_id", "source", "word_chars", "n_symbols", "n_dup_lines", "n", places.alias("places"))
    covered = "aggregate(transform(places, (p, i) -> least(3L, p - coalesce(get(places, i - 1), p - 3L))), 0L, (a, x) -> a + x)"
    return step.select("doc_id", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def host_rates(judged: DataFrame) -> DataFrame:
    """source, rows, failures, rate: the failure rate of every host after shrinking."""
    hosts = judged.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    moments = hosts.agg(
        F.sum("rows").alias("n"),
        F.count("*").alias("h"),
        (F.sum("failures") / F.sum("rows")).alias("m"),
        (F.sum(F.col("failures") * F.col("failures") / F.col("rows")) / F.sum("rows")).alias("second"),
    )
    noise = "m * (1 - m) * h / n"
    between = f"greatest(second - m * m - {noise}, 1e-6)"
    prior = moments.select("m", F.expr(f"least(greatest(m * (1 - m) / {between} - 1, 1.0), 1e6)").alias("weight")).first()
    mean, weight = prior.m or 0.0, prior.weight or 1.0
    return hosts.withColumn("rate", (F.col("failures") + F.lit(weight * mean)) / (F.col("rows") + F.lit(weight)))


def judged_texts(documents: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row; see the module's text."""
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    judged = write_and_read(text_counts(documents).withColumn("base_failed", failed), "rule-counts")
    bad = host_rates(judged).where(F.col("rate") > max_rate).select(F.col("source").alias("bad_source"), F.lit(True).alias("bad"))
    out = judged.join(bad, judged["source"].eqNullSafe(bad["bad_source"]), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("bad").isNull()).alias("kept"),
    )
