"""SimHash fingerprints and near-duplicate classes by a grid join on per-segment bit counts."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, connected_components, stored

SEED = 42
SEGMENTS = 16  # of two bits each in a half of 32 bits
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
_AT = (np.arange(8) * 256).astype(np.uint16)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits, each set if over half of the XXH64 hashes of the word shingles set it; a text without words gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and \x20 \x09-\x0d
    if not words:
        return 0
    body = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])] if len(words) > shingle else [0]
    ends = ends[shingle - 1 :] if len(words) > shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    if len(hashes) < 65536:
        seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _AT).ravel(), minlength=2048)
    else:
        seen = sum(np.bincount((hashes[i : i + 65536].view(np.uint8).reshape(-1, 8) + _AT).ravel(), minlength=2048) for i in range(0, len(hashes), 65536))
    counts = seen.reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "h", "fp"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, fp): the fingerprint of each whole text as a signed long, and a hash of the text. Null and blank texts have fingerprint 0."""
    arrow_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def _half(fp: Column, high: bool) -> Column:
    return F.shiftrightunsigned(fp, 32) if high else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def cell(fp: Column, high: bool) -> Column:
    """Grid coordinates of a half: the bit counts (0..2) of its 16 two-bit segments, two bits each in one long; bit 33 tells the half."""
    x, odd = _half(fp, high), F.lit(0x55555555)
    counts = x.bitwiseAND(odd) + F.shiftright(x, 1).bitwiseAND(odd)
    return counts + F.lit((1 << 33) if high else 0)


def _around(centre: Column) -> Column:
    """The cell and those at Manhattan distance 1 from it."""
    near = [centre]
    for i in range(SEGMENTS):
        value = F.shiftright(centre, 2 * i).bitwiseAND(F.lit(3))
        near += [F.when(value < 2, centre + F.lit(1 << 2 * i)), F.when(value > 0, centre - F.lit(1 << 2 * i))]
    return F.explode(F.array_compact(F.array(*near)))


def fingerprint_classes(values: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, component) for distinct fingerprints (fp): those joined by links of at most max_bits (0..4) differing bits.

    The sum of differences of per-segment bit counts never exceeds the Hamming distance. At most 4 differing bits
    leave a half with at most 2, so there the two grid points are at Manhattan distance 2 or less and some cell is at
    distance 1 or less from both: each fingerprint enters its own and the neighbouring cells of both halves, equal
    cells are joined, and every candidate is verified exactly. Copies with slight edits crowd a cell, so fingerprints
    are first linked to the least and the greatest of their own cell, and the grid join then compares only
    fingerprints of different groups: a crowd adds few rows to the join's output and no link is lost.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the grid covers distances up to 4")
    far = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    own = values.select("fp", F.explode(F.array(cell(F.col("fp"), False), cell(F.col("fp"), True))).alias("cell"))
    heads = own.groupBy("cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    star = own.join(heads, "cell").select("fp", F.explode(F.array("lo", "hi")).alias("head")).where((F.col("fp") != F.col("head")) & (far("fp", "head") <= max_bits))
    first = connected_components(star.select(F.col("fp").alias("a"), F.col("head").alias("b")))
    grouped = stored(values.join(first.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("g")), "groups")
    centres = grouped.select("fp", "g", F.explode(F.array(cell(F.col("fp"), False), cell(F.col("fp"), True))).alias("c"))
    around = centres.select("fp", "g", _around(F.col("c")).alias("cell"))
    a, b = (around.select("cell", F.col("fp").alias(f"fp_{x}"), F.col("g").alias(f"g_{x}")) for x in "ab")
    links = a.join(b.hint("merge"), "cell").where((F.col("g_a") < F.col("g_b")) & (far("fp_a", "fp_b") <= max_bits)).select(F.col("g_a").alias("a"), F.col("g_b").alias("b"))
    second = connected_components(links)
    return grouped.join(second.withColumnRenamed("id", "g"), "g", "left").select("fp", F.coalesce("component", "g").alias("component"))


def near_duplicates(df: DataFrame, max_bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable by links.

    Texts without words have fingerprint 0 and are linked like any other; repeated rows keep a row each; a null
    doc_id gets its fingerprint's class, and never names one unless all its rows are null; other columns are ignored.
    Only fingerprints that differ meet in the join: equal ones are one value, found by aggregation.
    """
    docs = stored(fingerprints(df, key, text).select("doc_id", "fp"), "fingerprints")
    values = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    classes = values.join(fingerprint_classes(values.select("fp"), max_bits), "fp")
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(classes.join(names, "component").select("fp", "component_id"), "classes")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, max_bits: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df of each near-duplicate class, all columns kept: that of the smallest key, a null key being the last.

    A row is known by its key, the hash of its text and its number among those that share both, so a class of null keys
    keeps a row, a key that stands on texts of other classes stays for its own only, and of repeated rows one stays
    (that of the least hash of the other columns; maps are not hashed). Null and blank texts have fingerprint 0 and are
    one class; extra columns of any name pass through; no rows give no rows.
    """
    docs = stored(fingerprints(df, key, text), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("k"), F.col("h"))
    least = docs.groupBy("fp").agg(F.min(place).alias("r"))
    classes = fingerprint_classes(stored(docs.select("fp").distinct(), "values"), max_bits)
    keep = classes.join(least, "fp").groupBy("component").agg(F.min("r").alias("r")).select("r.*")
    k = F.col(key).cast("long")
    other = [F.col(f"`{c}`") for c, kind in df.dtypes if c not in (key, text) and "map<" not in kind]
    rows = df.select(F.struct("*").alias("row"), k.isNull().alias("n"), F.coalesce(k, F.lit(0)).alias("k"), F.xxhash64(text).alias("h"), (F.xxhash64(*other) if other else F.lit(0)).alias("o"))
    rows = rows.join(keep, ["n", "k", "h"], "left_semi")
    number = F.row_number().over(Window.partitionBy("n", "k", "h").orderBy("o"))
    return rows.withColumn("at", number).where("at = 1").select(*[F.col("row").getField(c).alias(c) for c in df.columns])
