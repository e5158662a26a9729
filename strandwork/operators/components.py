"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import drop, saved


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has a link: edges (a, b) of longs in, (id, component) out.

    Large-star and small-star rounds; every round is two aggregations with map-side combine and two joins that
    adaptive execution can split, so a hub with a third of all links is no single task. Loops (a = a) and nulls are
    ignored; no links give no rows. Nothing but two numbers a round reaches the driver.
    """
    low_first = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = saved(low_first(edges.where("a is not null and b is not null and a <> b")), "edges")
    digest = F.struct(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"))
    before = current.select(digest.alias("d")).first()["d"]
    if before["n"] == 0:
        return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(max_rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        new = saved(low_first(small.where("a <> b")), "edges")
        drop(current)
        current, after = new, new.select(digest.alias("d")).first()["d"]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    links = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return links.union(links.select(F.col("component").alias("id"), "component").distinct())
