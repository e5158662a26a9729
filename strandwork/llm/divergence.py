"""Divergence between sources of a language over its terms: cells of a (group block, group block, term block) cube."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, stored

#: Least documents of a language that hold a kept term; scale of a probability, and what is added to a count.
LEAST_DOCS, SCALE, ADDED = 10, 1_000_000_000, 2
#: Groups of a block and about as many terms of one: a cell holds two blocks of groups over a block of terms.
GROUPS, TERMS = 8, 8192
#: Terms that a task counts before it hands them on, and bytes of a text that it splits at a time.
HELD, STRETCH = 400_000, 1 << 22
#: A-Z become small, other ASCII signs than letters part words, all bytes from 128 on are letters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _pieces(text: bytes, stretch: int):
    """The words of a text, a stretch at a time; stretches end between words."""
    if len(text) <= stretch:
        yield text.translate(_TABLE).split()
        return
    rest = b""
    for at in range(0, len(text), stretch):
        part = rest + text[at : at + stretch].translate(_TABLE)
        end = part.rfind(b" ") + 1
        rest = part[end:]
        yield part[:end].split()
    yield rest.split()


def _counted(batches, most: int, stretch: int):
    """(lang, source, term, n, docs): occurrences and documents of terms, added up within the task as far as `most` terms go."""
    held, size = defaultdict(dict), 0
    for batch in batches:
        langs, sources, texts = (c.to_pylist() for c in batch.columns)
        for lang, source, text in zip(langs, sources, texts, strict=True):
            found: Counter = Counter()
            for words in _pieces(text, stretch):
                found.update(words)
            group = held[lang, source]
            before = len(group)
            for term, n in found.items():
                was = group.get(term)
                group[term] = (n, 1) if was is None else (was[0] + n, was[1] + 1)
            size += len(group) - before
            if size >= most:
                yield from _term_rows(held)
                held, size = defaultdict(dict), 0
    yield from _term_rows(held)


def _term_rows(held: dict):
    """A row of a group's own beside its terms, for groups without any."""
    for (lang, source), terms in held.items():
        n = len(terms) + 1
        column = lambda x: pa.array([x] * n, pa.string())
        word = pa.array([None, *terms], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([column(lang), column(source), word, pa.array([0, *(v[0] for v in terms.values())], pa.int64()), pa.array([0, *(v[1] for v in terms.values())], pa.int64())], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents, and a row of null term for every (lang, source) that occurs. Nulls are empty texts."""
    arrow_batches(docs.sparkSession, 1000)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang"), text("source"), text("text").cast("binary"))
    counts = rows.mapInArrow(partial(_counted, most=HELD, stretch=STRETCH), "lang string, source string, term string, n long, docs long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED terms)) of long columns, as an exact decimal quotient; 0 without terms."""
    under = F.col(total) + ADDED * F.col(terms)
    over = F.lit(SCALE).cast("decimal(10,0)") * (F.col(count) + ADDED).cast("decimal(19,0)")
    return F.when(under > 0, 1 + F.call_function("div", over, under.cast("decimal(20,0)"))).otherwise(0)


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), 0 where both are 0; p and q are at most SCALE + 1, so squares fit a long."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _cell(table: pa.Table, size: int) -> pa.Table:
    """(lang_id, a, b, part, seen, p0a, p0b): of one cell, each pair's divergence over the cell's terms, and how many these are.

    Rows of a null term give a group's p for terms that it lacks; every group of both blocks has one.
    """
    lang, x, y = (table.column(c)[0].as_py() for c in ("lang_id", "x", "y"))
    group, term, p = (table.column(c).to_numpy() for c in ("gid", "term_id", "p"))
    none = term < 0
    ids, at = np.unique(group[none], return_index=True)
    base = p[none][at].astype(np.int64)
    terms, column = np.unique(term[~none], return_inverse=True)
    grid = np.repeat(base[:, None], len(terms), axis=1)
    grid[np.searchsorted(ids, group[~none]), column] = p[~none]
    first = np.flatnonzero(ids // size == x)
    rows = []
    for i in first:
        others = np.flatnonzero((ids // size == y) & (ids > ids[i]))
        if len(others):
            rows.append((np.full(len(others), i), others, difference(grid[i][None, :], grid[others]).sum(axis=1)))
    i, j, part = (np.concatenate(c) if rows else np.zeros(0, dtype=np.int64) for c in (zip(*rows, strict=True) if rows else ((), (), ())))
    columns = {"lang_id": np.full(len(i), lang), "a": ids[i], "b": ids[j], "part": part, "seen": np.full(len(i), len(terms)), "p0a": base[i], "p0b": base[j]}
    return pa.table({k: pa.array(np.asarray(v, dtype=np.int64)) for k, v in columns.items()})


def _sized(size: int):
    """_cell as Spark calls it, which looks at the number of a function's arguments."""

    def cell(table: pa.Table) -> pa.Table:
        return _cell(table, size)

    return cell


def pair_divergence(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang_id, a, b, value), a < b: divergence of every two groups of a language over all its kept terms.

    groups: (lang_id, gid from 0 in its language, p0, n_terms); counts: (lang_id, gid, term_id, p) of terms that a group
    has. The cube's axes are group blocks, group blocks and term blocks. A group's slice of a term block goes to each cell
    of its block's row and column; a cell is a task's group of at most 2 GROUPS x about TERMS numbers, however large the
    groups, and its partial divergences are added up along the term axis. Terms that neither block of a cell has are
    not in it: they add the same amount each.
    """
    slabs = F.greatest(F.ceil(F.col("n_terms") / TERMS), F.lit(1))
    sizes = groups.groupBy("lang_id").agg((F.floor(F.max("gid") / GROUPS)).alias("last"), F.max(slabs).alias("slabs"))
    block = F.floor(F.col("gid") / GROUPS)
    heads = groups.select("lang_id", "gid", F.lit(-1).cast("long").alias("term_id"), F.col("p0").alias("p")).join(sizes, "lang_id").withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slabs") - 1)))
    body = counts.join(sizes, "lang_id").withColumn("z", F.pmod(F.xxhash64("term_id"), F.col("slabs")))
    rows = heads.unionByName(body.select(*heads.columns)).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    cells = rows.select("lang_id", F.least(block, F.col("o")).alias("x"), F.greatest(block, F.col("o")).alias("y"), "z", "gid", "term_id", "p")
    parts = cells.groupBy("lang_id", "x", "y", "z").applyInArrow(_sized(GROUPS), "lang_id long, a long, b long, part long, seen long, p0a long, p0b long")
    sums = parts.groupBy("lang_id", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"), F.max("p0a").alias("p"), F.max("p0b").alias("q"))
    rest = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.greatest(F.col("p") + F.col("q"), F.lit(1)))
    terms = groups.groupBy("lang_id").agg(F.max("n_terms").alias("n_terms"))
    return sums.join(terms, "lang_id").select("lang_id", "a", "b", (F.col("part") + (F.col("n_terms") - F.col("seen")) * rest).alias("value"))


def audit(docs: DataFrame, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): a language's sources against one another, and the terms that mark each.

    docs: lang, source and text, nulls as empty texts; other columns are ignored. Terms are runs of letters and of signs
    beyond ASCII, A-Z in small letters; a language keeps those in at least LEAST_DOCS of its documents. Part `pair`: the
    divergence from each other source, every one ranked. Part `term`: the `top` terms that a source has more often than
    its language, by what they add to the divergence. Equal values rank by item. No documents give no rows; a language
    without kept terms has pairs of value 0.

    Groups and documents of any size are counted within tasks before they are shuffled; ranks within a group are taken
    from the first `top` of each task (Spark limits a window's groups before its shuffle).
    """
    counts = stored(term_counts(docs), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    kept = stored(kept.select("lang", "term", "n_lang", F.monotonically_increasing_id().alias("term_id")), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count(F.lit(1)).alias("n_terms"))
    found = stored(counts.join(kept, ["lang", "term"]), "found")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "total_lang", "n_terms"])
    groups = groups.withColumns({"lang_id": F.xxhash64("lang"), "gid": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1, "none": F.lit(0).cast("long")})
    groups = stored(groups.withColumn("p0", scaled("none", "total", "n_terms")).drop("none"), "groups")
    rows = found.join(groups, ["lang", "source"]).withColumns({"p": scaled("n", "total", "n_terms"), "q": scaled("n_lang", "total_lang", "n_terms")})

    pairs = stored(pair_divergence(groups, rows.select("lang_id", "gid", "term_id", "p")), "pairs")
    both = pairs.union(pairs.select("lang_id", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = groups.select("lang_id", "gid", "lang", "source")
    here = name.withColumnRenamed("gid", "a")
    there = name.select("lang_id", F.col("gid").alias("b"), F.col("source").alias("item"))
    pair_rows = both.join(here, ["lang_id", "a"]).join(there, ["lang_id", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pair_rows.withColumn("rank", F.row_number().over(order))

    gap = F.col("p") - F.col("q")
    term_rows = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    marks = term_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(marks)
