"""Statistics, thresholds and quality measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.seq import log_gamma, poisson_pdf
from ..store import saved

#: Fixed value: the base whose logarithm the cut-off formula takes.
NEAR_E = 2.718281


def library_stats(reads: DataFrame, library: str = "source") -> DataFrame:
    """Reads and mean length, cut to an integer, of each library."""
    return reads.groupBy(library).agg(F.count(F.lit(1)).alias("n_reads"), F.expr("sum(length(seq)) div count(1)").alias("avg_len"))


def average_read_length(stats: DataFrame) -> DataFrame:
    return stats.agg((F.sum(F.col("avg_len") * F.col("n_reads")) / F.sum("n_reads")).alias("avg_read_length"))


def _cumulated(nodes: DataFrame, value: str, descending: bool) -> DataFrame:
    """Distinct values with the running total of all rows that hold them: a row a length, so the one ordered window stays small."""
    by = nodes.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    order = F.desc(value) if descending else F.asc(value)
    return by.select(value, "n", F.sum(F.col(value) * F.col("n")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum(F.col(value) * F.col("n")).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))


def n50(nodes: DataFrame, length: str = "marginal") -> DataFrame:
    """First length, from the smallest, at which the running total is half of all; n50_standard runs from the largest."""
    up = _cumulated(nodes, length, False).where("2 * cum >= total").agg(F.min(length).alias("n50"))
    down = _cumulated(nodes, length, True).where("2 * cum >= total").agg(F.max(length).alias("n50_standard"))
    return up.crossJoin(down)  # one row each


def longest_share(nodes: DataFrame, share: float = 0.05) -> DataFrame:
    """The longest nodes that make up `share` of all marginal length; those of the last length all count."""
    edge = _cumulated(nodes, "marginal", True).where(F.col("cum") - F.col("n") * F.col("marginal") < share * F.col("total")).agg(F.min("marginal").alias("_edge"))
    return nodes.crossJoin(edge).where("marginal >= _edge").drop("_edge")  # one row


def coverage_mean(nodes: DataFrame, share: float = 0.05) -> DataFrame:
    return longest_share(nodes, share).agg((F.sum("kmer_cov") / F.sum("marginal")).alias("coverage_mean"))


def coverage_std(nodes: DataFrame, share: float = 0.05) -> DataFrame:
    """Population deviation of node coverage about the weighted mean."""
    top = longest_share(nodes, share)
    mean = top.agg((F.sum("kmer_cov") / F.sum("marginal")).alias("_m"))
    return top.crossJoin(mean).agg(F.sqrt(F.avg(F.pow(F.col("kmer_cov") / F.col("marginal") - F.col("_m"), 2))).alias("coverage_std"))


def cutoff(mean: Column) -> Column:
    """Where the Poisson densities of true (mean) and erroneous (1 + mean / 100) coverage cross."""
    error = 1 + mean / 100
    return (error - mean) * F.log(F.lit(NEAR_E)) / F.log(error / mean)


def thresholds(rounds: DataFrame, cut: float) -> DataFrame:
    """(r) -> red_line, safe, certain of each round."""
    r = F.col("r")
    return rounds.select("r", (cut * (1 + F.when(r < 6, r / 10).otherwise(1.0))).alias("red_line"), (cut * (0.7 + F.when(r < 4, r / 10).otherwise(1.0))).alias("safe"), (cut * (0.3 + F.when(r < 3, r / 10).otherwise(0.5))).alias("certain"))


@F.pandas_udf(DoubleType())
def _around(starts: pd.Series, log_factorial: pd.Series, mu: pd.Series, multiplicity: pd.Series) -> pd.Series:
    """Sum of the densities around multiplicity m: terms at m - 1, m + 1, m - 2, m + 2 and so on, at m + i alone once no m - i of at least 1 is left.

    The sum ends with the term that differs from the one before (at first the density at m + 1) by at most 1e-6, if the
    next i is 5 or more. Rows that have ended leave the arrays.
    """
    n, lf, mu, m = (x.to_numpy(dtype=np.float64) for x in (starts, log_factorial, mu, multiplicity))
    total, at, term = np.zeros(len(n)), np.arange(len(n)), 0
    density = lambda x: np.exp(n * np.log(x) - x - lf)
    last = density(mu * (m + 1))
    while len(at):
        below = np.maximum(m - 1, 0)  # terms on the lower side
        both = term < 2 * below
        i = np.where(both, term // 2 + 1, term - below + 1)
        lower = both & (term % 2 == 0)
        p = density(mu * np.where(lower, m - i, m + i))
        total[at] += p
        go = (np.abs(p - last) > 1e-6) | (np.where(lower, i, i + 1) < 5)
        at, n, lf, mu, m, last = (x[go] for x in (at, n, lf, mu, m, p))
        term += 1
    return pd.Series(total)


def node_multiplicity(nodes: DataFrame, most: int = 200) -> DataFrame:
    """nodes + expected multiplicity: climb from 1 while the Poisson density of the read starts rises; 0 if it is 0 at 1.

    The density in m rises up to starts / (mean per marginal x marginal) and falls after, so the climb stops at the
    floor or the ceiling of that ratio, whichever is denser. confidence is its density over the sum of those
    around it (infinite where they are nothing), incorrectness the density of what was seen against the peak.
    If no read starts in the longest nodes nothing is known: multiplicity and confidence 0, incorrectness infinite.
    """
    rate = longest_share(nodes).agg((F.sum("read_start_cov") / F.sum("marginal")).alias("_rate"))
    rows = nodes.crossJoin(rate).withColumn("_mu", F.col("_rate") * F.col("marginal"))
    at = lambda m: poisson_pdf(F.col("read_start_cov"), F.col("_mu") * m)
    known = F.coalesce(F.col("_mu") > 0, F.lit(False))
    low = F.greatest(F.floor(F.col("read_start_cov") / F.nullif(F.col("_mu"), F.lit(0.0))), F.lit(1)).cast("double")
    rows = rows.withColumn("_low", low).withColumn("_up", at(F.col("_low") + 1) > at(F.col("_low")))
    rows = rows.withColumn("multiplicity", F.when(~known | (at(F.lit(1.0)) == 0), 0.0).otherwise(F.col("_low") + F.when(F.col("_up"), 1).otherwise(0)))
    rows = rows.withColumn("_around", _around(F.col("read_start_cov").cast("double"), log_gamma(F.col("read_start_cov") + 1.0), F.when(known, F.col("_mu")).otherwise(1.0), F.col("multiplicity")))
    at_m = at(F.col("multiplicity"))
    peak = F.col("_mu") * F.greatest("multiplicity", F.lit(1.0))
    rows = rows.withColumn("confidence", F.when(~known | (at_m == 0), 0.0).when(F.col("_around") == 0, float("inf")).otherwise(at_m / F.nullif(F.col("_around"), F.lit(0.0))))
    seen = poisson_pdf(F.least(F.col("read_start_cov"), peak), peak)
    rows = rows.withColumn("incorrectness", F.when(~known | (seen == 0), float("inf")).otherwise(poisson_pdf(peak, peak) / F.nullif(seen, F.lit(0.0))))
    return saved(rows.drop("_rate", "_mu", "_low", "_up", "_around"), "multiplicity")  # written, for what filters on it would work it out anew for each condition


def reliable_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """Long nodes of sure multiplicity, signed by the strand on which they branch to the right; nodes: marginal, n_right, n_left, confidence, incorrectness."""
    sure = nodes.where((F.col("marginal") >= k) & (F.col("confidence") >= 1000) & (F.col("incorrectness") <= 1000))
    back = sure.withColumns({"node_id": -F.col("node_id"), "n_right": F.col("n_left"), "n_left": F.col("n_right")})
    return sure.unionByName(back).where("n_right >= 2")


def coverage_histogram(nodes: DataFrame, width: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes and their marginal length by coverage, apart for each value of the columns `by`."""
    bins = F.floor(F.col("kmer_cov") / F.col("marginal") / width).cast("long").alias("bin")
    return nodes.groupBy(bins, *by).agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("marginal").alias("total_marginal"))


def confusion(rows: DataFrame) -> DataFrame:
    """rows (truth, found) of 0 and 1 -> counts, sensitivity, specificity and gain; 1.0 where there is nothing to judge."""
    c = lambda t, f: F.count_if((F.col("truth") == t) & (F.col("found") == f))
    n = rows.agg(c(1, 1).alias("tp"), c(0, 0).alias("tn"), c(0, 1).alias("fp"), c(1, 0).alias("fn"))
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / F.when(b != 0, b))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return n.select("*", share(tp, tp + fn).alias("sensitivity"), share(tn, tn + fp).alias("specificity"), share(tp - fp, tp + fn).alias("gain"))
