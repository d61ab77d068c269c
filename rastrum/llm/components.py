"""Connected components of an edge table, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, drop, gathered, hot_keys, spread


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (or smaller) neighbours on the smallest of its neighbourhood. Minima are aggregated before the join, and the
    neighbours of a node that has very many are dealt to many tasks in it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    hot = hot_keys(least, "a", "n")
    joined = dealt(both, "a", hot, "b").join(spread(least, "a", hot), ["a", "part"])
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of edges (a, b) with the smallest node that it reaches. Each round is written to the shared folder, and the
    one before it deleted; the loop ends when a round changes nothing."""
    now = cut(gathered(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = mark(now)
    while before[0]:
        half = cut(gathered(_star(now, True)), "edges")
        then, now = now, cut(gathered(_star(half, False)), "edges")
        drop(then, half)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
