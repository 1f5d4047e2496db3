"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from passagework.session import write_and_read
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest_reachable(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every end of the links (a, b).

    Each round points every vertex to the smallest vertex around it and replaces links by
    links between those (with one jump along the pointers), so the graph shrinks and long
    chains shorten by a factor each round. Tables are written each round; only counts come
    to the driver.
    """
    links = write_and_read(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    labels = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    labels = write_and_read(labels, "components")
    while not links.isEmpty():
        ends = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = write_and_read(ends.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")), "components")
        jump = to.select(F.col("v").alias("p"), F.col("p").alias("q"))
        to = write_and_read(to.join(jump, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "components")
        labels = write_and_read(
            labels.join(to, labels["component"] == to["v"], "left").select("id", F.coalesce("p", "component").alias("component")), "components"
        )
        a = to.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        b = to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = links.join(a, "a").join(b, "b").where("pa <> pb")
        links = write_and_read(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "components")
    return labels
