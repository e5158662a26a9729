"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosine checks."""

from __future__ import annotations

from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, connected_components, stored

WIDTH, PER_TABLE, TABLES, SEED = 1.5, 10, 96, 20
#: Vectors of a bucket that one task compares with as many others.
BLOCK = 512
#: Vectors of a group up to which it is compared along with the batch's other groups.
FEW = 16


def projections(dim: int, tables: int = TABLES, per_table: int = PER_TABLE, width: float = WIDTH, seed: int = SEED):
    """Gaussian (2-stable) directions and offsets of all tables, the same in every task."""
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, tables * per_table)) / width, rng.random(tables * per_table)


def collision_probability(cosine: float, width: float = WIDTH) -> float:
    """That one quantised projection of two unit vectors of this cosine agrees."""
    from math import erf, exp, pi, sqrt

    c = sqrt(max(2 - 2 * cosine, 1e-18))
    r = width / c
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def _unit(batches):
    for batch in batches:
        ids, vectors, labels = (batch.column(i).to_pylist() for i in range(3))
        out = ([], [], [])
        for i, v, label in zip(ids, vectors, labels, strict=True):
            if label is None or not v or None in v:
                continue
            x = np.array(v, dtype=np.float64)
            if not np.isfinite(x).all() or not (top := np.abs(x).max()) > 0:
                continue
            x = x / top  # neither overflow nor underflow in the norm
            for column, value in zip(out, (i, label, (x / np.sqrt(x @ x)).astype("<f8").tobytes()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["vec_id", "label", "unit"])


def _hashed(batches, tables, per_table, width, seed):
    """Rows with `keys`: 32 bits a table that stand for the quantised projections; equal keys are a bucket, wherever compared."""
    for batch in batches:
        units = batch.column(2).to_pylist()
        keys: list[bytes] = [b""] * len(units)
        by_dim: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            by_dim.setdefault(len(u) // 8, []).append(k)
        for dim, rows in by_dim.items():
            a, b = projections(dim, tables, per_table, width, seed)
            x = np.frombuffer(b"".join(units[k] for k in rows), dtype="<f8").reshape(-1, dim)
            q = np.floor(x @ a + b).astype(np.int64).reshape(len(rows), tables, per_table)
            mixed = np.full((len(rows), tables), dim, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            with np.errstate(over="ignore"):
                for j in range(per_table):
                    mixed = (mixed ^ q[:, :, j].view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
                    mixed ^= mixed >> np.uint64(32)
            for k, row in zip(rows, (mixed >> np.uint64(32)).astype("<u4"), strict=True):
                keys[k] = row.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=["rep", "label", "unit", "n", "keys"])


def _cells(batches, tables):
    """A row a vector and table: the bucket, without the vector."""
    for batch in batches:
        bucket = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype="<u4").astype(np.int64)
        rows, at = np.repeat(np.arange(batch.num_rows), tables), np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(at), pa.array(bucket)], names=["rep", "label", "dim", "at", "bucket"])


def _candidates(x, begins, ends, same, first, least):
    """(p, q): rows of one group, of different blocks unless `same`, whose cosine may be `least`: few rows by shifts of the batch, many by a product of matrices."""
    end_of, size_of = np.repeat(ends, ends - begins), np.repeat(ends - begins, ends - begins)
    at = np.arange(len(end_of))
    found = [(at[:0], at[:0])]
    for d in range(1, FEW):
        p = np.flatnonzero((at + d < end_of) & (size_of <= FEW))
        if not len(p):
            break
        p = p[same[p] | (first[p] != first[p + d])]
        p = p[np.einsum("ij,ij->i", x[p], x[p + d]) >= least - 1e-9]
        found.append((p, p + d))
    for lo, hi in zip(begins, ends, strict=True):
        if hi - lo > FEW:
            a, b = lo + np.flatnonzero(first[lo:hi]), lo + np.flatnonzero(~first[lo:hi])
            p, q = np.nonzero(x[a] @ x[a if same[lo] else b].T >= least - 1e-9)
            p, q = a[p], (a if same[lo] else b)[q]
            found.append((p[p < q], q[p < q]) if same[lo] else (p, q))
    return np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _links(x, keys, at, p, q, least):
    """Of the candidates, the links whose first common table is this one; `keys` are those of the tables before it."""
    left = [(p[:0], q[:0])]
    for table in np.unique(at[p]):
        lo, hi = np.searchsorted(at, table), np.searchsorted(at, table, side="right")
        here = at[p] == table
        a, b = p[here], q[here]
        k = np.frombuffer(b"".join(keys[lo:hi]), dtype="<u4").reshape(hi - lo, table)
        for s in range(table):
            new = k[a - lo, s] != k[b - lo, s]
            a, b = a[new], b[new]
        left.append((a, b))
    p, q = np.concatenate([a for a, _ in left]), np.concatenate([b for _, b in left])
    cosine = np.einsum("ij,ij->i", x[p], x[q])
    sharp = np.flatnonzero(np.abs(cosine - least) < 1e-9)
    cosine[sharp] = [x[i] @ x[j] for i, j in zip(p[sharp], q[sharp], strict=True)]  # one way of adding decides what is near the threshold
    return p[cosine >= least], q[cosine >= least]


def _least_reached(p, q, size):
    """The least place that each place reaches over the links."""
    low = np.arange(size)
    while True:
        m = np.minimum(low[p], low[q])
        new = low.copy()
        np.minimum.at(new, p, m)
        np.minimum.at(new, q, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _block_links(batches, least):
    """Sorted rows of block pairs in; of each vector with links there, out: the copies it links with and the least vector reached.

    No pair leaves the task. A group is at most about two blocks; one that goes over the end of a batch waits for the next.
    """
    held = None
    for batch in chain(batches, [None]):
        parts = [b for b in (held, batch) if b is not None and b.num_rows]
        if not parts:
            continue
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        at, lead, i, j = (rows.column(c).to_numpy() for c in ("at", "lead", "i", "j"))
        cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(lead) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        ends = np.append(cuts, rows.num_rows) if batch is None else cuts
        held = rows.slice(ends[-1]) if len(ends) and ends[-1] < rows.num_rows else None if len(ends) else rows
        if not len(ends):
            continue
        size = ends[-1]
        units, keys = (rows.column(c).slice(0, size).to_pylist() for c in ("unit", "keys"))
        width = max(map(len, units))
        x = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), dtype="<f8").reshape(size, -1)
        first = rows.column("first").to_numpy(zero_copy_only=False)[:size]
        p, q = _candidates(x, np.append(0, ends[:-1]), ends, (i == j)[:size], first, least)
        if len(p):
            p, q = _links(x, keys, at[:size], p, q, least)
        if len(p):
            rep, n, others = rows.column("rep").to_numpy(), rows.column("n").to_numpy(), np.zeros(size, dtype=np.int64)
            np.add.at(others, p, n[q])
            np.add.at(others, q, n[p])
            low, has = _least_reached(p, q, size), np.flatnonzero(others)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rep[has], others[has], rep[low[has]])], names=["rep", "others", "low"])


def near_duplicate_vectors(df: DataFrame, least: float = 0.93, tables: int = TABLES, per_table: int = PER_TABLE, width: float = WIDTH, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector.

    Vectors are normalised in double precision; equal unit vectors of one label are one representative, so copies are
    counted and never paired. Each table buckets a representative by per_table quantised Gaussian projections;
    representatives that share a label and a bucket are compared and are linked if their cosine is at least `least`.
    Buckets are cut into blocks of about `block` vectors and every pair of blocks is a group of its own, so a crowded
    bucket is many tasks; a pair counts in the first table where it meets. Groups give counts and a spanning star, no pairs.
    With the defaults a pair just at 0.93 meets with probability 1 - (1 - p^10)^96 (over 0.9999), p = collision_probability(0.93);
    a nearer pair is surer. Vectors that are null, empty, zero or hold a null or non-finite component, and those of a
    null label, link with nothing and are their own component. Vectors of different lengths never link. Repeated ids
    are one node, that of the least label and then unit vector (in bytes), and keep a row each; a null id links with
    nothing and has no component; other columns are ignored; no rows give no rows.
    """
    spark = df.sparkSession
    arrow_batches(spark)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    unit = stored(rows.where("vec_id is not null").mapInArrow(_unit, "vec_id long, label string, unit binary").groupBy("vec_id").agg(F.min(F.struct("label", "unit")).alias("u")).select("vec_id", "u.*"), "unit")
    reps = unit.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "label", "unit", "n")
    hashed = partial(_hashed, tables=tables, per_table=per_table, width=width, seed=SEED)
    reps = stored(reps.mapInArrow(hashed, "rep long, label string, unit binary, n long, keys binary"), "reps")
    members = stored(unit.join(reps, ["label", "unit"]).select("vec_id", "rep", F.col("n").alias("own")), "members")
    cells = reps.select("rep", "label", F.length("unit").alias("dim"), "keys").mapInArrow(partial(_cells, tables=tables), "rep long, label string, dim int, at int, bucket long")
    cell = ["label", "dim", "at", "bucket"]
    shared = cells.groupBy(cell).agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lead")).where("m > 1")
    meet = cells.join(shared, cell).select("rep", "at", "lead", F.ceil(F.col("m") / block).alias("blocks"))
    meet = meet.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meet = meet.select("rep", "at", "lead", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") <= F.col("o")).alias("first"))
    group = ["at", "lead", "i", "j"]
    wide = meet.join(reps.select("rep", "n", "unit", "keys"), "rep").withColumn("keys", F.substr("keys", F.lit(1), F.col("at") * 4)).repartition(*group).sortWithinPartitions(*group, "rep")
    links = stored(wide.mapInArrow(partial(_block_links, least=least), "rep long, others long, low long"), "links")
    others = links.groupBy("rep").agg(F.sum("others").alias("others"))
    names = connected_components(links.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("id", "rep")
    linked = members.join(others, "rep", "left").join(names, "rep", "left").select("vec_id", (F.col("own") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("vec_id").join(linked, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), (F.coalesce("c", "vec_id") == F.col("vec_id")).alias("kept"))
