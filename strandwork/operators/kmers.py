"""k-mer counting, solid k-mers and their overlaps. k-mers are longs (functions/packed.py) and become texts at the end."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import buckets as B
from ..functions import packed as P
from ..store import saved


def kmers(reads: DataFrame, k: int, double_stranded: bool = True) -> DataFrame:
    """(read_id, pos, code, same): every valid window of every read; same: the read holds the canonical form."""
    return P.windows(reads, "seq", k, ["read_id"], double_stranded)


def kmer_count(reads: DataFrame, k: int, double_stranded: bool = True) -> DataFrame:
    """(code, cov) of each distinct k-mer: its windows come together in stretches of text, and one task counts them."""
    return B.by_bucket(reads, "seq", k, partial(B.counted, both=double_stranded), "code long, cov long")


def solid(counts: DataFrame) -> DataFrame:
    return counts.where("cov > 1")


def solid_count(reads: DataFrame, k: int) -> DataFrame:
    """solid(kmer_count()): k-mers met once do not leave their task."""
    return B.by_bucket(reads, "seq", k, partial(B.counted, least=2), "code long, cov long")


def spelt(rows: DataFrame, k: int) -> DataFrame:
    """rows with the column code as the text kmer."""
    return rows.select(P.letters(F.col("code"), k).alias("kmer"), *[c for c in rows.columns if c != "code"])


def kmer_totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("cov") > 1).alias("n_solid"), F.sum("cov").alias("n_windows"))


def read_solid_kmers(reads: DataFrame, solid_kmers: DataFrame, k: int) -> DataFrame:
    """(read_id, n_solid): windows of each read that are solid k-mers."""
    return kmers(reads, k).join(solid_kmers.select("code"), "code", "left_semi").groupBy("read_id").agg(F.count(F.lit(1)).alias("n_solid"))


def own_solid_kmers(reads: DataFrame, k: int) -> DataFrame:
    """read_solid_kmers() of the reads' own solid k-mers: counted where the windows are, a row a read and task leaves it."""
    return B.by_bucket(reads, "seq", k, B.solid_by_tag, "tag long, n long", tag="read_id").groupBy(F.col("tag").alias("read_id")).agg(F.sum("n").alias("n_solid"))


def weak(counts: DataFrame) -> DataFrame:
    """The k-mers met once."""
    return counts.where("cov = 1").select("code")


def weak_kmers(reads: DataFrame, solid_kmers: DataFrame, k: int) -> DataFrame:
    return kmer_count(reads, k).select("code").join(solid_kmers.select("code"), "code", "left_anti")


def _sides(code: np.ndarray, k: int):
    """Of a (k+1)-mer both k-mers in canonical form, each with the mask bit of its neighbour."""
    c = code.view(np.uint64)
    a, b = c >> np.uint64(2), c & np.uint64((1 << 2 * k) - 1)
    first, last = (c >> np.uint64(2 * k)).astype(np.int64), (c & np.uint64(3)).astype(np.int64)
    ta, tb = P.turned(a, k), P.turned(b, k)
    ma = np.where(a <= ta, 1 << (3 - last), 16 << last)
    mb = np.where(b <= tb, 16 << (3 - first), 1 << first)
    return np.minimum(a, ta).view(np.int64), ma.astype(np.int32), np.minimum(b, tb).view(np.int64), mb.astype(np.int32)


def overlap_masks(reads: DataFrame, solid_kmers: DataFrame, k: int) -> DataFrame:
    """(code, mask) of every solid k-mer: which bases were seen beside it in a read, where both neighbours are solid.

    Mask: high nibble left A, C, G, T, low nibble right, from the highest bit. Equal (k+1)-mers are one row before the
    joins, so a repeated passage meets the solid set once.
    """
    pairs = P.counts(reads, "seq", k + 1).select("code").distinct()
    sides = P.mapped(pairs, lambda c: _sides(c, k), "ka long, ma int, kb long, mb int")
    known = solid_kmers.select("code")
    sides = sides.join(known.withColumnRenamed("code", "ka"), "ka", "left_semi").join(known.withColumnRenamed("code", "kb"), "kb", "left_semi")
    ends = F.array(F.struct(F.col("ka").alias("code"), F.col("ma").alias("mask")), F.struct(F.col("kb").alias("code"), F.col("mb").alias("mask")))
    marks = sides.select(F.explode(ends).alias("m")).select("m.*").groupBy("code").agg(F.bit_or("mask").alias("mask"))
    return known.join(marks, "code", "left").select("code", F.coalesce("mask", F.lit(0)).alias("mask"))


def solid_masks(reads: DataFrame, k: int) -> DataFrame:
    """overlap_masks() of the reads' own solid k-mers.

    A task that holds a k-mer also knows what was seen beside it, and most of its neighbours; only neighbours of other tasks
    are compared, by the k + 1 letters of both: an overlap counts if both of its k-mers ask for it.
    """
    if P.check(k) % 2 == 0:  # a k-mer may be its own reverse complement
        return overlap_masks(reads, saved(solid(kmer_count(reads, k)), "solid"), k)
    rows = saved(B.by_bucket(reads, "seq", k, B.masked, "code long, sure int, open int"), "masked")
    asked = rows.where("open <> 0").select("code", F.explode(F.filter(F.array(*[F.lit(b) for b in range(8)]), lambda b: F.getbit("open", b) > 0)).alias("bit"))
    letter = F.when(F.col("bit") < 4, 3 - F.col("bit")).otherwise(7 - F.col("bit")).cast("long")
    edge = F.when(F.col("bit") < 4, F.shiftleft("code", 2).bitwiseOR(letter)).otherwise(F.col("code").bitwiseOR(F.shiftleft(letter, 2 * k)))
    asked = asked.select(F.least(edge, P.revcomp(edge, k + 1)).alias("edge"), F.struct("code", "bit").alias("x"))
    met = asked.groupBy("edge").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).where("n = 2")
    met = met.select(F.explode(F.array("a", "b")).alias("x")).select("x.code", F.expr("shiftleft(1, x.bit)").alias("mask")).groupBy("code").agg(F.bit_or("mask").alias("mask"))
    doubted = rows.where("open <> 0").join(met, "code", "left").select("code", F.col("sure").bitwiseOR(F.coalesce("mask", F.lit(0))).alias("mask"))
    return rows.where("open = 0").select("code", F.col("sure").alias("mask")).unionByName(doubted)


def overlap_degree(masks: DataFrame) -> DataFrame:
    return masks.select("code", F.bit_count(F.shiftright("mask", 4)).alias("n_left"), F.bit_count(F.col("mask").bitwiseAND(F.lit(15))).alias("n_right"))


def _both(code: np.ndarray, mask: np.ndarray, k: int):
    """Each k-mer on both strands, with its reverse complement and its mask as that strand sees it."""
    back = P.turned(code, k).view(np.int64)
    swapped = np.zeros_like(mask)
    for i in range(8):
        swapped |= ((mask >> i) & 1) << (7 - i)
    return np.concatenate([code, back]), np.concatenate([back, code]), np.concatenate([mask, swapped])


def oriented(masks: DataFrame, k: int) -> DataFrame:
    """(v, back, mask): both strands of every k-mer, each with the other strand's code."""
    return P.mapped(masks.select("code", "mask"), lambda c, m: _both(c, m, k), "v long, back long, mask int")


def right_bases(mask="mask"):
    """The letters (0 to 3) to the right that a mask names."""
    return F.filter(F.array(*[F.lit(b).cast("long") for b in range(4)]), lambda b: F.getbit(F.col(mask), (3 - b).cast("int")) > 0)


def kmer_neighbors(masks: DataFrame, k: int) -> DataFrame:
    """(src, dst): codes of oriented k-mers that an arc joins, in both orientations."""
    arcs = oriented(masks, k).select("v", F.explode(right_bases()).alias("b"))
    return arcs.select(F.col("v").alias("src"), P.pushed_right(F.col("v"), F.col("b"), k).alias("dst"))
