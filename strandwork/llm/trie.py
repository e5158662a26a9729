"""Prefix trie of conversations by whole-sequence collapse: equal conversations are one weighted sequence before prefixes are expanded."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns of a conversation whose running digests one window holds, and conv_ids that one piece of an end list holds.
BLOCK, PIECE = 1024, 4096
#: Children of every fifth conversation take its first turns: h is the CRC of the conv_id modulo 9.
FAMILY, MOST_GIVEN = 5, 8
KEY = ["depth", "p1", "p2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, digest, n_bytes): turns numbered from 0 within their conversation, by turn, null first, then digest of role and text.

    Ranges of (conversation, turn) are numbered within and shifted by what precedes them, so a conversation that holds a
    third of all rows is spread over tasks. Null roles and texts are empty; rows of a null conv_id belong to no
    conversation and are left out; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    ranged = stored(rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest").withColumn("p", F.spark_partition_id()), "turns")
    part = ranged.groupBy("conv_id", "p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    at = F.row_number().over(Window.partitionBy("conv_id", "p").orderBy(F.asc_nulls_first("turn"), "digest"))
    shift = part.select("conv_id", "p", F.coalesce(before, F.lit(0)).alias("shift"))
    return ranged.withColumn("at", at).join(shift, ["conv_id", "p"]).select("conv_id", (F.col("at") - 1 + F.col("shift")).alias("i"), "digest", "n_bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, pos, m1, m2, n_bytes) of their turns after rebuilding.

    The first h turns come from conversation c - c % 5 (the remainder has c's sign), at most MOST_GIVEN rows each; then
    c's own turns after its first h. m1 and m2 are hashes of place and turn; their exclusive ors name a prefix.
    """
    c = F.col("conv_id")
    convs = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).select("conv_id", "n_own", (F.crc32(c.cast("string")) % 9).alias("h"), (c - c % FAMILY).alias("donor")), "convs")
    first = turns.where(F.col("i") < MOST_GIVEN).withColumnRenamed("conv_id", "donor")
    given = convs.select("conv_id", "h", "donor").join(first, "donor").where("i < h").select("conv_id", F.col("i").alias("pos"), "digest", "n_bytes")
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("n_own").alias("n_donor"))
    starts = convs.join(donors, "donor", "left").select("conv_id", "h", F.least("h", F.coalesce("n_donor", F.lit(0))).alias("n_given"))
    own = turns.join(starts, "conv_id").where("i >= h").select("conv_id", (F.col("n_given") + F.col("i") - F.col("h")).alias("pos"), "digest", "n_bytes")
    rows = given.unionByName(own).select("conv_id", "pos", F.xxhash64("pos", "digest").alias("m1"), F.xxhash64("digest", "pos").alias("m2"), "n_bytes")
    return convs.select("conv_id"), stored(rows, "rebuilt")


def _prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, bytes, done): each prefix, its parent's name, its last text's bytes, and all bytes up to there."""
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK))
    inner = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"), F.sum("n_bytes").alias("xb"))
    carry = blocks.select("conv_id", "block", *[F.coalesce(f(x).over(outer), F.lit(0)).alias(y) for f, x, y in ((F.bit_xor, "x1", "c1"), (F.bit_xor, "x2", "c2"), (F.sum, "xb", "cb"))])
    run = rows.withColumns({"r1": F.bit_xor("m1").over(inner), "r2": F.bit_xor("m2").over(inner), "rb": F.sum("n_bytes").over(inner)}).join(carry, ["conv_id", "block"])
    p1, p2 = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    return run.select("conv_id", (F.col("pos") + 1).alias("depth"), p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("m1")).alias("q1"), p2.bitwiseXOR(F.col("m2")).alias("q2"), F.col("n_bytes").alias("bytes"), (F.col("rb") + F.col("cb")).alias("done"))


def _digests(batches):
    """SHA-256 of each node's pieces, joined by commas, which come in order; a node's text is never held whole."""
    key, sha = None, None
    for batch in batches:
        out = []
        for *now, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        yield _end_rows(out)
    if key is not None:
        yield _end_rows([(*key, sha.hexdigest())])


def _end_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"depth": pa.int64(), "p1": pa.int64(), "p2": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def end_digests(whole: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the conversations (conv_id, depth, p1, p2) that end at a node.

    Ids are joined to pieces of PIECE consecutive numbers in parallel; the digest, which is sequential by its nature,
    then takes a node's pieces in order as a stream.
    """
    block = F.floor(F.col("conv_id") / PIECE).alias("block")
    pieces = whole.groupBy(*KEY, block).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece"))
    rows = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "piece")
    return rows.mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def _same(a: str, b: str, keys: list[str] = KEY) -> Column:
    on = [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys]
    return on[0] & on[1] & on[2]


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_sequences.

    conversations: (conv_id, turn, role, text), rebuilt by rebuilt(). Equal conversations collapse to one sequence with a
    weight before any prefix is made; a sequence that is a proper prefix of another goes from the leaves by an
    anti-join; prefixes of the sequences are aggregated with their weights. n_sequences counts the distinct sequences
    through a node.

    saved_tokens needs no walk over subtrees: bytes of all members from a node's depth on are a weighted sum over its
    sequences. Less each node's bytes once: a node belongs to the sequence of its smallest member, which then owns all
    that follow on its path, so what a sequence owns below any node is a suffix of it. Nothing is quadratic in depth.

    Prefixes are told apart by 128 bits of hashes. No conversations give no nodes; extra columns are ignored.
    """
    convs, rows = rebuilt(stored(ordered_turns(conversations), "ordered"))
    sums = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("m1").alias("p1"), F.bit_xor("m2").alias("p2"), F.sum("n_bytes").alias("total"))
    whole = stored(convs.join(sums, "conv_id", "left").na.fill(0), "whole")
    seqs = stored(whole.groupBy(*KEY).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"), F.max("total").alias("total")), "sequences")
    body = _prefixes(rows.join(seqs.select("conv_id"), "conv_id", "left_semi"))
    zero = F.lit(0).cast("long")
    root = seqs.select("conv_id", *[zero.alias(k) for k in KEY], *[F.lit(None).cast("long").alias(q) for q in ("q1", "q2")], zero.alias("bytes"), zero.alias("done"))
    prefixes = stored(root.unionByName(body), "prefixes")

    proper = prefixes.join(seqs.select("conv_id", F.col("depth").alias("full")), "conv_id").where("depth < full").select(*KEY).distinct()
    leaves = seqs.join(proper, KEY, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = prefixes.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes")).groupBy("conv_id").agg(F.min("depth").alias("from"), F.sum("bytes").alias("owned"))
    known = stored(seqs.select("conv_id", "weight", "total").join(leaves, "conv_id", "left").join(owned, "conv_id", "left"), "known")

    left = F.col("total") - F.col("done") + F.col("bytes")
    own = F.when(F.col("depth") >= F.col("from"), left).otherwise(F.coalesce("owned", F.lit(0)))
    nodes = prefixes.join(known, "conv_id").groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("q1").alias("q1"),
        F.min("q2").alias("q2"),
        F.sum("weight").alias("n_convs"),
        F.count("leaf").alias("n_leaves"),
        (F.sum(F.col("weight") * left) - F.sum(own)).alias("saved_tokens"),
        F.count(F.lit(1)).alias("n_sequences"),
    )
    nodes = stored(nodes, "nodes")
    up = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    kids = up.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(kids, KEY, "left").join(end_digests(whole.select("conv_id", *KEY)), KEY, "left")
    out = out.alias("n").join(parents.alias("u"), _same("n", "u", ["depth", "q1", "q2"]), "left")
    return out.select("conv_id", "n.depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "n_sequences")
