"""Cross-site boilerplate lines: HyperLogLog spread per line hash, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LG_K = 10
#: More than seven standard errors of a sketch of 2^LG_K registers (3.25 % each).
MARGIN = 0.25


def boilerplate_lines(lines: DataFrame, sites: int = 10) -> DataFrame:
    """(h1, h2, n_sites, keep_id, keep_at): lines that stand on at least `sites` distinct sites, and their first place.

    lines: (doc_id, site, at, h1, h2). One aggregation by line hash merges a sketch of its sites, made on the map side
    first; estimates within MARGIN of the threshold are settled by exact distinct counts. n_sites is exact there and
    the sketch's estimate elsewhere. Lines of one site only need no sketch and are dropped by least = greatest site.
    """
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", LG_K).alias("s"),
        F.min("site").alias("lo"),
        F.max("site").alias("hi"),
        F.min(F.struct("doc_id", "at")).alias("first"),
    )
    if sites > 1:
        spread = spread.where("lo <> hi")
    spread = stored(spread.select("h1", "h2", F.hll_sketch_estimate("s").alias("n"), F.col("first.doc_id").alias("keep_id"), F.col("first.at").alias("keep_at")).where(F.col("n") >= sites * (1 - MARGIN)), "spread")
    sure = spread.where(F.col("n") > sites * (1 + MARGIN))
    near = spread.where(F.col("n") <= sites * (1 + MARGIN))
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("exact")).where(F.col("exact") >= sites)
    kept = near.join(exact, ["h1", "h2"]).select("h1", "h2", F.col("exact").alias("n_sites"), "keep_id", "keep_at")
    return sure.select("h1", "h2", F.col("n").alias("n_sites"), "keep_id", "keep_at").union(kept)


def remove_boilerplate(df: DataFrame, sites: int = 10, key: str = "doc_id", text: str = "text", site: str = "source", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """df's columns with the text less its boilerplate lines, plus two counts: lines, and lines removed.

    A line is what stands between line feeds; lines of white space only are never boilerplate. A boilerplate line stays
    at its first place (smallest key, then position), so a passage that many documents share survives once, and is
    removed elsewhere. A null site is no site. A null text stays null with no lines; a null key sorts first; rows that
    repeat key and text are treated alike; extra columns of any name pass through, only one that bears the name of a
    count is replaced by it; no rows give no rows.
    """
    rows = df.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h"), F.col(site).cast("string").alias("site"))
    split = F.split("t", "\n")
    lines = rows.select(F.col("k").alias("doc_id"), "h", "site", F.posexplode(split).alias("at", "line"))
    lines = stored(lines.where(F.length(F.trim("line")) > 0).select("doc_id", "h", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")), "lines")
    bad = stored(boilerplate_lines(lines, sites), "boilerplate")
    here = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("at") == F.col("keep_at"))
    cut = lines.join(bad, ["h1", "h2"]).where(~here).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("at")).alias("cut"))
    cut = cut.select(F.col("doc_id").alias("ck"), F.col("h").alias("ch"), "cut")
    joined = rows.join(cut, F.col("k").eqNullSafe(F.col("ck")) & (F.col("h") == F.col("ch")), "left")
    edges = F.concat(F.array(F.lit(-1)), F.col("cut"), F.array(F.size(split)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cut")), lambda i: F.slice(split, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1)))
    new = F.when(F.col("cut").isNull(), F.col("t")).otherwise(F.array_join(kept, "\n"))
    total = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size(split)).alias(counts[0])
    gone = F.when(F.col("cut").isNull(), F.lit(0)).otherwise(F.size("cut")).alias(counts[1])
    return joined.select(*[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns if c not in counts], total, gone)
