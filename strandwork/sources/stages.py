"""Stage files: solid k-mers, graphs and library metadata as Parquet folders that another session can load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = {"nodes": "node_id long, seq string, kmer_cov long, read_start_cov long, marginal int", "arcs": "src long, dst long, cov long"}


def write_kmers(counts: DataFrame, path: str, k: int, solid: bool = True) -> None:
    """(code, cov) of solid k-mers, or of all; k is part of the table."""
    rows = counts.where("cov > 1") if solid else counts
    rows.select(F.lit(k).alias("k"), "code", "cov").write.mode("overwrite").parquet(path)


def read_kmers(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(code, cov); a table of another k is refused."""
    rows = spark.read.parquet(path)
    other = rows.where(F.col("k") != k).select("k").first()
    if other is not None:
        raise ValueError(f"the k-mers under {path} have {other[0]} letters, not {k}")
    return rows.select("code", "cov")


def write_graph(nodes: DataFrame, arcs: DataFrame, path: str) -> None:
    for rows, name in ((nodes, "nodes"), (arcs, "arcs")):
        kinds = [c.rsplit(" ", 1) for c in GRAPH[name].split(", ")]
        rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds]).write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    nodes, arcs = (spark.read.schema(GRAPH[name]).parquet(f"{path}/{name}") for name in ("nodes", "arcs"))
    return nodes, arcs


def write_library_metadata(stats: DataFrame, path: str) -> None:
    """A line of JSON for each library: its name, number of reads and mean length."""
    stats.select("source", "n_reads", "avg_len").write.mode("overwrite").json(path)


def read_library_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("source string, n_reads long, avg_len long").json(path)


def read_length(average: float | None, k: int) -> float:
    """The length that thresholds use: the mean, or 150 where it is unknown, at most k or over 500."""
    return 150.0 if average is None or average <= k or average > 500 else average
