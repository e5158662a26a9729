"""The three jobs over read libraries. Each stage keeps its tables in a work folder and is used again as long as nothing that it rests on has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correct as C
from ..operators import graph as G
from ..operators import kmers as K
from ..operators import stats as T
from ..sources import reads as R
from ..sources import stages
from ..store import saved

#: Jobs, and the last stage that each needs.
JOBS = {"graph_construction": "graph", "graph_correction": "clean", "read_correction": "corrected"}
#: Reads of a library, at most: read ids of all libraries are told apart by it.
LIBRARY = 1 << 40


@dataclass(frozen=True)
class Settings:
    """k: letters of a k-mer. cutoff: coverage under which nodes are doubted, estimated if None. The limits bound the searches for bubbles and paths; None is exact."""

    k: int = 31
    cutoff: float | None = None
    bubble_limit: int | None = None
    search_limit: int | None = None


def inputs(spark: SparkSession, paths: list[str]) -> list[list]:
    """Name, size and time of each library's files; contents are not read."""
    files = [[str(x) for x in row] for p in paths for row in spark.read.format("binaryFile").load(p).select(F.lit(p), "path", "length", "modificationTime").orderBy("path").collect()]
    if not files:
        raise ValueError("no library is given")
    return files


def fingerprint(stage: str, *rests_on) -> str:
    return hashlib.sha256(json.dumps([stage, *rests_on]).encode()).hexdigest()[:20]


class Work:
    """A work folder. A stage lies at <folder>/<stage>-<fingerprint>, and is whole once its mark is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), []

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def stage(self, name: str, mark: str, make: Callable[[str], None]) -> str:
        """The stage's path; make(path) fills it where it is not whole. A stage that was cut short is written over."""
        path = f"{self.folder}/{name}-{mark}"
        if not self._exists(f"{path}/whole/_SUCCESS"):
            make(path)
            self.spark.range(1).write.mode("overwrite").parquet(f"{path}/whole")
            self.made.append(name)
        return path


def parameters(nodes: DataFrame, arcs: DataFrame, k: int, average: float | None, cutoff: float | None) -> dict:
    """Read length, mean and deviation of the coverage, and the cut-off, from a graph simplified for that.

    The cut-off is where the densities of true and erroneous coverage cross; where there is no such place (a mean of hardly
    more than 1, or no nodes) it is 1.
    """
    length = stages.read_length(average, k)
    simple = saved(G.prelude(nodes, arcs, k, read_length=length)[0], "simple")
    mean, std = T.coverage_mean(simple).first()[0], T.coverage_std(simple).first()[0]
    if cutoff is None:
        cutoff = simple.sparkSession.range(1).select(T.cutoff(F.lit(float(mean)))).first()[0] if mean is not None and mean > 1.02 else 1.0
    return {"read_length": length, "mean": mean, "std": std, "cutoff": float(cutoff)}


def run(spark: SparkSession, job: str, paths: list[str], folder: str, settings: Settings | None = None, outputs: list[str] | None = None) -> dict:
    """Run a job over the libraries at `paths`; returns the paths of its stages and results, and in `made` the stages that were worked out now.

    Stages: reads (parsed libraries and their lengths), kmers (solid ones), graph, clean (its cleaned form and the
    parameters used) and corrected (a row a read). A fingerprint holds a stage's settings, the files' names, sizes and times,
    and so all that comes before; another k, cut-off or file gives another folder, a limit of a later stage does not.
    graph_construction and graph_correction also give the contigs as FASTA; read_correction writes each library to
    `outputs`, or where default_output() says, with reads under k letters as they were.
    """
    if job not in JOBS:
        raise ValueError(f"{job} is none of {', '.join(JOBS)}")
    settings, k = settings or Settings(), (settings or Settings()).k
    work, result = Work(spark, folder), {}

    def parse(path: str) -> None:
        rows = R.read_libraries(spark, paths)
        rows.withColumn("id", F.col("lib_id").cast("long") * LIBRARY + F.col("read_id")).write.mode("overwrite").parquet(f"{path}/records")
        lengths = spark.read.parquet(f"{path}/records").select(F.col("lib_id").cast("string").alias("source"), "seq")
        stages.write_library_metadata(T.library_stats(lengths), f"{path}/libraries")

    mark = fingerprint("reads", inputs(spark, paths))
    result["reads"] = work.stage("reads", mark, parse)
    records = spark.read.parquet(f"{result['reads']}/records")
    reads = records.select(F.col("id").alias("read_id"), "seq")

    mark = fingerprint("kmers", k, mark)
    result["kmers"] = work.stage("kmers", mark, lambda path: stages.write_kmers(K.kmer_count(reads, k), path + "/solid", k))

    def build(path: str) -> None:
        made = G.build(spark, reads, k, solid=stages.read_kmers(spark, f"{result['kmers']}/solid", k).select("code", "cov"))
        stages.write_graph(made["nodes"], made["arcs"], path)

    mark = fingerprint("graph", mark)
    result["graph"] = last = work.stage("graph", mark, build)

    if job != "graph_construction":

        def clean(path: str) -> None:
            nodes, arcs = stages.read_graph(spark, result["graph"])
            average = T.average_read_length(stages.read_library_metadata(spark, f"{result['reads']}/libraries")).first()[0]
            found = parameters(nodes, arcs, k, average, settings.cutoff)
            nodes, arcs = G.purify(nodes, arcs, k, found["cutoff"], int(found["read_length"]), limit=settings.bubble_limit)
            stages.write_graph(nodes, arcs, path)
            spark.createDataFrame([found], "read_length double, mean double, std double, cutoff double").write.mode("overwrite").json(f"{path}/parameters")

        mark = fingerprint("clean", settings.cutoff, settings.bubble_limit, mark)
        result["clean"] = last = work.stage("clean", mark, clean)

    if job != "read_correction":
        nodes, arcs = stages.read_graph(spark, last)
        lines = G.graph_fasta(nodes, arcs).select(F.concat_ws("\n", "header", R.wrapped(F.col("seq"))).alias("value"))
        result["fasta"] = work.stage("contigs", fingerprint("contigs", mark), lambda path: lines.write.mode("overwrite").text(f"{path}/fasta")) + "/fasta"
        return result | {"made": work.made}

    def correct(path: str) -> None:
        nodes, arcs = stages.read_graph(spark, result["clean"])
        index = saved(G.kmer_index(nodes, k), "index")
        positions = saved(G.read_node_positions(reads, index, k), "positions")
        C.correct(reads, positions, nodes, arcs, k, limit=settings.search_limit).write.mode("overwrite").parquet(f"{path}/reads")

    mark = fingerprint("corrected", settings.search_limit, mark)
    result["corrected"] = work.stage("corrected", mark, correct)
    done = spark.read.parquet(f"{result['corrected']}/reads").select(F.col("read_id").alias("id"), "corrected")
    whole = saved(records.join(done, "id", "left").withColumn("seq", F.coalesce("corrected", "seq")), "written")
    result["outputs"] = outputs or [R.default_output(p) for p in paths]
    for i, (source, target) in enumerate(zip(paths, result["outputs"], strict=True)):
        R.write_reads(whole.where(F.col("lib_id") == i), target, R.file_format(source), "overwrite")
    return result | {"made": work.made}
