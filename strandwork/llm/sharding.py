"""Hierarchical weighted hash tree: region, rack and shard are drawn level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT_BUCKETS = 256


@dataclass(frozen=True)
class Tree:
    """regions -> racks -> shard weights; shards are numbered in this order. A node's weight is the sum below it."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """One more shard, in a region and rack of its own: no other subtree's weight changes, so rows move into it only."""
        return Tree((*self.regions, ((weight,),)))


def even_tree(n_shards: int, racks: int = 2, shards_per_rack: int = 4) -> Tree:
    """n shards of weight 1 in racks of shards_per_rack and regions of so many racks."""
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    ids = [1.0] * n_shards
    rack_list = [tuple(ids[i : i + shards_per_rack]) for i in range(0, n_shards, shards_per_rack)]
    return Tree(tuple(tuple(rack_list[i : i + racks]) for i in range(0, len(rack_list), racks)))


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """Weighted rendezvous: -ln(u) / w of a 48-bit hash draw; the smallest draw wins in proportion to the weights."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), node)), 1, 12), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((bits + 1.0) / F.lit(float(2**48 + 1))) / weight)


def _pick(key: Column, node: Column, weights: Column) -> Column:
    """The number of the child with the smallest draw; children of weight 0 get nothing."""
    draws = F.transform(weights, lambda w, i: F.struct(_draw(key, F.concat(node, i.cast("string")), w).alias("d"), i.alias("i")))
    return F.array_min(F.filter(draws, lambda x: x["d"].isNotNull()))["i"]


def with_shard(df: DataFrame, key: Column, tree: Tree, name: str) -> DataFrame:
    """Add the shard of a key: a draw among regions, then among the racks of that region, then among that rack's shards.

    The tree's weights are literals; its size is set by the number of shards. A draw's hash names the node by its path.
    """
    if sum(w for region in tree.regions for rack in region for w in rack) <= 0:
        raise ValueError("some shard needs a weight over 0")
    number = iter(range(tree.n_shards))
    ids = [[[next(number) for _ in rack] for rack in region] for region in tree.regions]
    nest = lambda x: F.array(*map(nest, x)) if isinstance(x, (list, tuple)) else F.lit(x)
    racks = [[float(sum(rack)) for rack in region] for region in tree.regions]
    text, dot = F.coalesce(key.cast("string"), F.lit("null")), F.lit(".")
    df = df.withColumn("_r", _pick(text, F.lit("r"), nest([float(sum(r)) for r in racks])))
    df = df.withColumn("_k", _pick(text, F.concat(F.lit("r"), F.col("_r").cast("string"), dot), F.get(nest(racks), F.col("_r"))))
    at = lambda x: F.get(F.get(x, F.col("_r")), F.col("_k"))
    weights = at(nest([[list(map(float, rack)) for rack in region] for region in tree.regions]))
    df = df.withColumn("_s", _pick(text, F.concat(F.lit("r"), F.col("_r").cast("string"), dot, F.col("_k").cast("string"), dot), weights))
    return df.withColumn(name, F.get(at(nest(ids)), F.col("_s")).cast("int")).drop("_r", "_k", "_s")


def with_slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Add slot: gapless from 0 in each shard, ordered by hash bucket and then by `order`.

    A shard is never sorted in one task: rows are numbered within (shard, bucket), and the bucket's start is a running
    count over at most shards x SLOT_BUCKETS rows, a fixed bound that is safe to broadcast.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)).cast("int"))
    starts = df.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return df.withColumn("_at", F.row_number().over(within) - 1).join(F.broadcast(starts), [shard, "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_bucket", "_at", "_start")


def assign_shards(df: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row, by the law `key`.

    The key alone decides the shard. A null text counts 8 bytes and the checksum of no bytes; a null key is drawn as
    the text "null"; repeated rows keep a slot each; no rows give no rows; other columns are ignored.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = df.select(
        F.col(key),
        (F.length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = with_shard(with_shard(rows, F.col(key), tree, "shard"), F.col(key), tree.grown(), "grown_shard")
    return with_slots(rows, "shard", [key, "text_crc32", "size"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
