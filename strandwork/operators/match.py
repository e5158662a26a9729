"""Exact matches between queries and reference texts, and offset look-ups."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import packed as P
from ..functions import seq as S
from ..store import saved


#: Letters of texts whose windows may be broadcast: 8 MB of windows of a long and an id, or 16 with places.
FEW = 500_000


def letters(texts: DataFrame) -> int:
    return texts.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("n")).first()["n"]


def hits(queries: DataFrame, refs: DataFrame, size: int, few: bool = False) -> DataFrame:
    """(query_id, ref_id, q, diagonal): windows of `size` letters without N that a query and a reference share.

    few: the queries are known to hold at most FEW letters, so their windows are broadcast and no window of a reference is shuffled.
    """
    q = P.windows(queries, "seq", size, ["query_id"], both=False).select("query_id", F.col("pos").alias("q"), "code")
    r = P.windows(refs, "seq", size, ["ref_id"], both=False).select("ref_id", F.col("pos").alias("r"), "code")
    return r.join(F.broadcast(q) if few else q, "code").select("query_id", "ref_id", "q", (F.col("r") - F.col("q")).alias("diagonal"))


def islands(found: DataFrame, window: str) -> DataFrame:
    """(query_id, ref_id, q_start, r_start, len): hits at adjacent places of a diagonal as one match; column `window`: their length."""
    w = Window.partitionBy("query_id", "ref_id", "diagonal").orderBy("q")
    runs = found.withColumn("island", F.col("q") - F.row_number().over(w))
    out = runs.groupBy("query_id", "ref_id", "diagonal", "island").agg(F.min("q").alias("q_start"), F.count(F.lit(1)).alias("n"), F.first(window).alias("_w"))
    return out.select("query_id", "ref_id", "q_start", (F.col("q_start") + F.col("diagonal")).alias("r_start"), (F.col("n") + F.col("_w") - 1).alias("len"))


#: Letters of a seed window, at most: what a long holds.
SEED = 31


def mems(queries: DataFrame, refs: DataFrame, least: int) -> DataFrame:
    """(query_id, ref_id, q_start, r_start, len): all maximal exact matches of at least `least` letters without N.

    Windows of length `least` (SEED at most) of both sides, as longs, meet by an equality join; matches on one diagonal
    at adjacent places are one match, found as islands. Longer ones than SEED are islands of enough windows.
    """
    size = min(least, SEED)
    found = islands(hits(queries, refs, size, letters(queries) <= FEW).withColumn("_size", F.lit(size)), "_size")
    return found if size == least else found.where(F.col("len") >= least)


def index_shape(least: int, step: int) -> int:
    """Letters of the windows of an index that finds all matches of `least` letters by every step-th place."""
    size = min(least - step + 1, SEED)
    if step < 1 or size < step:
        raise ValueError(f"every {step}th window cannot find all matches of {least} letters")
    return size


def match_index(refs: DataFrame, least: int, step: int = 1) -> DataFrame:
    """(ref_id, pos, code, before, n_before, after, n_after): the references' windows at every step-th place with the letters beside them.

    A match of `least` letters or more holds at least one of them whole, so the index is a step-th of all windows.
    """
    return P.sampled_windows(refs, "seq", index_shape(least, step), step, step - 1, ["ref_id"])


def save_index(refs: DataFrame, least: int, step: int, path: str, buckets: int = 64) -> None:
    """Write match_index() at path, bucketed and sorted by code, with what load_index() must know of it."""
    spark = refs.sparkSession
    name = f"match_index_{uuid.uuid4().hex}"
    index = match_index(refs, least, step)
    index.repartition(buckets, "code").write.bucketBy(buckets, "code").sortBy("code").option("path", f"{path}/windows").saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay: the table is registered anew by whoever loads it
    spark.createDataFrame([(least, step, buckets, refs.schema["ref_id"].dataType.simpleString())], "least int, step int, buckets int, kind string").coalesce(1).write.parquet(f"{path}/shape")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """(index, least, step) of a stored index. Its table keeps its buckets, so joins by code read it without a shuffle."""
    shape = spark.read.parquet(f"{path}/shape").first()
    name = f"match_index_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} (ref_id {shape['kind']}, pos bigint, code bigint, before bigint, n_before int, after bigint, n_after int) using parquet clustered by (code) sorted by (code) into {shape['buckets']} buckets location '{path}/windows'")
    return spark.table(name), shape["least"], shape["step"]


def _alike(a: str, b: str, na: str, nb: str) -> Column:
    """How many of the nearest letters of two packed stretches agree: zero bits below the lowest that differs."""
    x = F.col(a).bitwiseXOR(F.col(b))
    low = F.bit_count(F.bitwise_not(x).bitwiseAND(x - 1))
    return F.least(F.when(x == 0, F.lit(64)).otherwise(F.floor(low / 2)), F.col(na), F.col(nb)).cast("long")


def indexed_mems(queries: DataFrame, index: DataFrame, least: int, step: int, shortest: int | None = None) -> DataFrame:
    """mems() through an index made for `least` and `step`; shortest: a greater least length of matches.

    Every window of the queries looks for the index's; hits `step` places apart on a diagonal are one match, which goes on
    by fewer than `step` letters on either side. How many, the letters beside the windows say: no text is read again.
    """
    size = index_shape(least, step)
    names = {"pos": "q", "before": "qb", "n_before": "nqb", "after": "qa", "n_after": "nqa"}
    q = P.sampled_windows(queries, "seq", size, 1, step - 1, ["query_id"]).withColumnsRenamed(names)
    found = index.join(q, "code").select("query_id", "ref_id", "q", (F.col("pos") - F.col("q")).alias("diagonal"), _alike("before", "qb", "n_before", "nqb").alias("more_left"), _alike("after", "qa", "n_after", "nqa").alias("more_right"))
    w = Window.partitionBy("query_id", "ref_id", "diagonal").orderBy("q")
    runs = found.withColumn("island", F.col("q") - step * F.row_number().over(w))
    ends = runs.groupBy("query_id", "ref_id", "diagonal", "island").agg((F.min("q") - F.min_by("more_left", "q")).alias("q_start"), (F.max("q") + size + F.max_by("more_right", "q")).alias("q_end"))
    out = ends.select("query_id", "ref_id", "q_start", (F.col("q_start") + F.col("diagonal")).alias("r_start"), (F.col("q_end") - F.col("q_start")).alias("len"))
    return out.where(F.col("len") >= max(least, shortest or 0))


def unique_matches(found: DataFrame, both: bool = False) -> DataFrame:
    """Of mems those whose text occurs once in the references (MAM), and once in the queries as well if both (MUM).

    found must hold all mems. Another occurrence of a match's text in the references gives a match of the same query
    that covers the same stretch of it, so a match is unique iff no other covers it: one running maximum over a query's
    matches by start. The same holds with sides changed.
    """
    for side, start in (("query_id", "q_start"), *((("ref_id", "r_start"),) if both else ())):
        end = F.col(start) + F.col("len")
        before = Window.partitionBy(side).orderBy(F.col(start), F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
        alike = Window.partitionBy(side, start, "len")
        marked = found.withColumns({"_reach": F.max(end).over(before), "_alike": F.count(F.lit(1)).over(alike)})
        lone = marked.where((F.col("_alike") == 1) & (F.col("_reach").isNull() | (F.col("_reach") < end))).drop("_reach", "_alike")
        kept = lone if side == "query_id" else kept.join(lone.select("query_id", "ref_id", "q_start", "r_start", "len"), ["query_id", "ref_id", "q_start", "r_start", "len"], "left_semi")
    return kept


def verify(found: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    """found + ok: both texts are equal there."""
    j = found.join(queries.select("query_id", F.col("seq").alias("_q")), "query_id").join(refs.select("ref_id", F.col("seq").alias("_r")), "ref_id")
    cut = lambda s, p: F.substr(F.col(s), F.col(p).cast("int"), F.col("len").cast("int"))
    return j.withColumn("ok", cut("_q", "q_start") == cut("_r", "r_start")).drop("_q", "_r")


def concat_offsets(refs: DataFrame, order: str, length: str, gap: int = 1, buckets: int = 1024) -> DataFrame:
    """(order, start): where each text begins when all are joined with gap signs between.

    The running sum is taken within ranges of the order column and then over the ranges' totals, so no task sorts all.
    """
    bounds = refs.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = max(1, ((bounds["hi"] or 0) - (bounds["lo"] or 0)) // buckets + 1)
    b = F.floor((F.col(order) - F.lit(bounds["lo"] or 0)) / width)
    rows = refs.select(order, (F.col(length) + gap).alias("_n"), b.alias("_b"))
    tops = rows.groupBy("_b").agg(F.sum("_n").alias("_t"))
    tops = tops.select("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # at most `buckets` rows
    inner = F.coalesce(F.sum("_n").over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_i", inner).join(tops, "_b").select(order, (F.col("_i") + F.col("_s")).alias("start"))


def asof(points: DataFrame, starts: DataFrame, on: str, group: str | None = None) -> DataFrame:
    """points + the row of starts with the greatest `on` not after the point's, within group if one is named: one sort of the union.

    Without a group both sides are dealt out by ranges of `on`, and each range gets the last start of those before it, a
    row a range; no task holds more than a range. Of starts at one place any one counts. Points before all starts get nulls.
    """
    extra = [c for c in starts.columns if c not in (on, group)]
    left = points.withColumns({c: F.lit(None).cast(starts.schema[c].dataType) for c in extra} | {"_side": F.lit(1)})
    missing = [c for c in points.columns if c not in (on, group)]
    right = starts.withColumns({c: F.lit(None).cast(points.schema[c].dataType) for c in missing} | {"_side": F.lit(0)})
    both = left.unionByName(right).withColumn("_row", F.when(F.col("_side") == 0, F.struct(*extra))).drop(*extra)
    if group:
        w = Window.partitionBy(group).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_row", F.last("_row", ignorenulls=True).over(w))
    else:
        ranged = saved(both.repartitionByRange(on, "_side").withColumn("_p", F.spark_partition_id()), "ranged")
        last = ranged.groupBy("_p").agg(F.max_by("_row", F.when(F.col("_side") == 0, F.col(on))).alias("_end"))
        ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        carried = last.select("_p", F.last("_end", ignorenulls=True).over(ahead).alias("_carried"))
        w = Window.partitionBy("_p").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = ranged.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).join(F.broadcast(carried), "_p").withColumn("_row", F.coalesce("_row", "_carried"))
    return found.where("_side = 1").select(*points.columns, *[F.col("_row").getField(c).alias(c) for c in extra])


def occurrences(patterns: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, n): occurrences of each pattern (id, seq), of any length, in the references on either strand; other signs than bases are one letter, N.

    A pattern of up to P.ANY letters is one window of its length; a longer one is cut into windows of P.ANY letters, the
    last one ending with it, and stands where all of them meet the reference on one diagonal: nothing is verified on
    texts. Null and empty patterns occur nowhere. Patterns of FEW letters together are sent to the tasks, which pass over the
    references once and count; more of them meet the references' windows in joins, a pass each length of windows (P.ANY at most).
    """
    p = patterns.where(F.length("seq") > 0)
    both = p.select("id", "seq").union(p.where(F.col("seq") != S.revcomp(F.col("seq"))).select("id", S.revcomp(F.col("seq"))))
    both = both.withColumns({"_n": F.length("seq"), "size": F.least(F.length("seq"), F.lit(P.ANY)), "strand": F.monotonically_increasing_id()})
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("_n") - F.col("size"), F.col("size")), F.array(F.col("_n") - F.col("size"))))
    cut = both.select("id", "strand", "size", F.size(starts).alias("_of"), "seq", F.explode(starts).alias("at"))
    blocks = saved(cut.select("id", "strand", "size", "_of", "at", P.any_code(F.substr("seq", F.col("at") + 1, F.col("size"))).alias("code")), "patterns")
    sizes = sorted(r[0] for r in blocks.select("size").distinct().collect())  # P.ANY numbers at most
    if not sizes:
        return patterns.select("id", F.lit(0).cast("long").alias("n"))
    if letters(both) <= FEW:
        codes = blocks.select("size", "code").distinct().toPandas()  # FEW rows at most
        met = saved(P.known_windows(refs, {n: np.sort(codes["code"][codes["size"] == n].to_numpy(np.int64)) for n in sizes}), "met")
    else:
        met = reduce(DataFrame.union, [P.any_windows(refs, "seq", n, ["ref_id"]).select(F.lit(n).alias("size"), "code", F.lit(1).cast("long").alias("n"), "ref_id", "pos") for n in sizes])
    met = met.join(blocks, ["size", "code"])
    short = met.where(F.col("size") < P.ANY).select("id", "n")
    whole = met.where(F.col("size") == P.ANY).groupBy("strand", "ref_id", (F.col("pos") - F.col("at")).alias("start")).agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("_met"), F.first("_of").alias("_of"))
    out = short.union(whole.where("_met = _of").select("id", F.lit(1).cast("long")))
    return patterns.select("id").join(out.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
