"""Connected components of a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, stored


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component's name is its smallest node.

    Each step is two shuffles of the edges, with a minimum a node that is summed up before the shuffle. The edges of a
    step are written to the shared folder. Steps end when nothing changes: after some log(n) steps in practice; more than `rounds`
    is an error, never a wrong result. Null nodes are left out; an empty table gives no rows."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    now = stored(now, "edges")
    sign = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        # large star: neighbours above a node meet the smallest node around it
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its neighbours below it meet the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(down, F.col("a") == F.col("n"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select(F.col("n").alias("a"), F.col("m").alias("b")))
        new = stored(small.where("a <> b").distinct(), "edges")
        found = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(now)
        now = new
        if sign == found:
            break
        sign = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
