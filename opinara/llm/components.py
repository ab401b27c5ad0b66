"""Connected components by large-star and small-star rounds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the least node around it.

    The least neighbour is an aggregate with map-side partial results, joined back by node, so no
    node's neighbours meet in one place and a skewed join can be split.
    """
    if large:
        around = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).unionAll(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    else:
        around = edges.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m"))
    least = around.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    joined = around.join(least, "n")
    if large:
        moved = joined.where(F.col("m") > F.col("n")).select(F.col("m").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("m").alias("a"), F.col("low").alias("b")).unionAll(least.select(F.col("n").alias("a"), F.col("low").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for every node of a link.

    Each round is written to the shared folder. It ends when a round changes nothing, however many that takes, seen
    in the count and an order-free checksum of the links; nothing else reaches the driver.
    """
    now = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "links")
    seen, rows = None, now.count()
    while True:
        after = written(_star(_star(now, True), False), "links", rows)
        drop_written(now)
        now = after
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if mark == seen:
            break
        seen, rows = mark, mark["n"]
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots).distinct()
