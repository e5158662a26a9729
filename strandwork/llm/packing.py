"""Best-fit-decreasing packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_batches, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"


class CapacityTree:
    """Segment tree over remaining capacities 0..cap: bins open at each; the tightest that fits is found in log2(cap) steps."""

    def __init__(self, cap: int):
        self.width = 1 << (cap + 1 - 1).bit_length() if cap else 1
        while self.width < cap + 1:
            self.width *= 2
        self.node = [0] * (2 * self.width)

    def add(self, capacity: int, bins: int) -> None:
        i = self.width + capacity
        while i:
            self.node[i] += bins
            i //= 2

    def tightest(self, need: int) -> int:
        """The smallest capacity >= need of an open bin, or -1."""
        i = self.width + need
        if self.node[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.node[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.node[2 * i] else 2 * i + 1
                return i - self.width
            i //= 2
        return -1


def plan_best_fit(histogram: dict[int, int], cap: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for `histogram[length]` items of each length, all items of a length at once.

    Items of one length are alike, and after one of them is placed its bin is still the tightest as long as another
    fits, so a run of bins of equal remaining capacity is filled in one step: the plan is the one that item-by-item
    best-fit decreasing makes, at a cost that depends on cap and not on the number of items. Returns rows (length,
    first item, items, first bin, items a bin, offset of the first) sorted by length and first item, and the bins used.
    """
    tree, runs, plan, bins = CapacityTree(cap), defaultdict(deque), [], 0

    def free(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs[capacity].append((first, n))
            tree.add(capacity, n)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        if not 0 < length <= cap:
            raise ValueError(f"length {length} is outside 1..{cap}")
        done, total = 0, histogram[length]
        while done < total:
            left = total - done
            room = tree.tightest(length)
            if room < 0:
                per = cap // length
                first, have, room = bins, -(-left // per), cap
                bins += have
            else:
                per = room // length
                first, n = runs[room].popleft()
                tree.add(room, -n)
                have = min(n, -(-left // per))
                free(room, first + have, n - have)
            items = min(left, have * per)
            plan.append((length, done, items, first, per, cap - room))
            whole = items // per
            free(room - per * length, first, whole)
            if items % per:
                free(room - (items % per) * length, first + whole, 1)
            done += items
    return np.array(sorted(plan), dtype=np.int64).reshape(-1, 6), bins


def cut_points(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole up to cap, else pieces of cap, the first being the shorter one."""
    first = n if n <= cap else (n % cap or cap)
    return [(0, first), *((s, cap) for s in range(first, n, cap))]


def _cut(batches, path: str, cap: int, end_id: int):
    chunk, seen = TaskContext.get().partitionId(), defaultdict(int)
    encode = tokens.unit_encoder(path)
    end = int(end_id).to_bytes(4, "little")
    for batch in batches:
        out = [[] for _ in range(7)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            for k, (start, length) in enumerate(cut_points(len(ids) // 4, cap)):
                row = (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), chunk, seen[length])
                seen[length] += 1
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)


def _place(batches, plan):
    rows = plan.value
    keys = rows[:, 0] * 2**42 + rows[:, 1]
    for batch in batches:
        length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
        p = rows[np.searchsorted(keys, length * 2**42 + nth, side="right") - 1] if len(length) else rows[:0]
        at = nth - p[:, 1]
        per = np.maximum(p[:, 4], 1)
        made = [pa.array(p[:, 3] + at // per), pa.array(p[:, 5] + at % per * length)]
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "sequence_id", "offset"])


def pack(df: DataFrame, tokenizer: str, cap: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack whole texts into sequences of at most cap tokens, as few as best-fit decreasing makes of them.

    Each text is encoded, end_id is appended, and only what is longer than cap is cut. One row a piece: (doc_id, piece,
    start, length, ids_crc32, sequence_id, offset). A null or empty text is its end_id alone; null keys and repeated
    rows are packed as rows of their own; no rows give no rows; other columns are ignored.

    Only the counts of the lengths 1..cap reach the driver (cap numbers at most), and the plan that goes back has a
    bound set by cap as well. An item's number among those of its length is its number in its task's chunk plus a
    running count over chunks, so no length, however common, is sorted in one task.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    pieces = stored(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_cut, path=tokenizer, cap=cap, end_id=end_id), PIECES), "pieces")
    plan, _ = plan_best_fit({r[0]: r[1] for r in pieces.groupBy("length").count().collect()}, cap)
    starts = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("length", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = pieces.join(starts, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("_start")).alias("nth"))
    shared = spark.sparkContext.broadcast(plan)
    return numbered.mapInArrow(partial(_place, plan=shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
