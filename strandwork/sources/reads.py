"""Readers and writers of read files: FASTA, FASTQ, SAM and raw, plain or gzip."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import seq as S

FORMATS = ("sam", "raw", "fasta", "fastq")
#: Read ids that each document has to itself.
READS_A_DOC = 1 << 32
#: Documents that a task looks at together, and about as many letters of reads that it hands on at a time.
TEXTS, LETTERS = 1024, 1 << 20


def file_format(path: str) -> str:
    """By the suffix, in any case, with or without .gz; others are refused."""
    m = re.search(r"\.(sam|raw|fasta|fastq)(\.gz)?$", path, re.I)
    if not m:
        raise ValueError(f"the format of {path} is unknown: .sam, .raw, .fasta or .fastq, with or without .gz")
    return m.group(1).lower()


def default_output(path: str) -> str:
    """<base>.corr.<type>"""
    kind = file_format(path)
    return re.sub(rf"\.{kind}(\.gz)?$", "", path, flags=re.I) + f".corr.{kind}"


def _starts(counts: DataFrame) -> DataFrame:
    """(part, start) of (part, n): a row a partition, so the one ordered window is small."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value, part): lines in the file's order, numbered from 0 by their place in their partition and the partition's start."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.select(F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "value")
    starts = _starts(lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    return lines.join(F.broadcast(starts), "part").select((F.col("at") + F.col("start")).alias("n"), "value", "part")  # a row a partition


def _fasta(lines: DataFrame) -> DataFrame:
    """Records of lines: a header is a line that begins with >, other > are text. What stands before the first header is no record."""
    marked = lines.withColumn("head", F.col("value").startswith(">").cast("int"))
    starts = _starts(marked.groupBy("part").agg(F.sum("head").alias("n")))
    within = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("record", F.sum("head").over(within)).join(F.broadcast(starts), "part").withColumn("record", F.col("record") + F.col("start"))
    rows = marked.where("record > 0").groupBy("record").agg(F.max(F.when(F.col("head") == 1, F.col("value"))).alias("title"), F.sort_array(F.collect_list(F.when(F.col("head") == 0, F.struct("n", "value")))).alias("x"))
    seq = F.regexp_replace(F.array_join("x.value", ""), r"\s", "")
    return rows.select(F.col("record").alias("n"), F.concat(F.regexp_replace("title", "\r$", ""), F.lit("\n")).alias("pre"), seq.alias("seq"), F.lit("\n").alias("post"), F.lit(None).cast("string").alias("qual"))


def read_reads(spark: SparkSession, path: str, lib_id: int = 0) -> DataFrame:
    """(lib_id, read_id, pre, seq, post, qual) in file order; sequences in upper case; empty records are skipped."""
    kind = file_format(path)
    if kind == "fasta":
        rows = _fasta(_numbered_lines(spark, path))
    elif kind == "fastq":
        lines = _numbered_lines(spark, path)
        rec = lines.groupBy(F.expr("n div 4").alias("n")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("value"))).alias(f"l{i}") for i in range(4)])
        bad = F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("l0", F.lit(""))))
        rec = rec.where("not (coalesce(l0, '') = '' and l1 is null)").withColumn("l0", F.when(F.col("l0").startswith("@"), F.col("l0")).otherwise(bad))
        rows = rec.select("n", F.concat("l0", F.lit("\n")).alias("pre"), F.coalesce("l1", F.lit("")).alias("seq"), F.concat(F.lit("\n"), F.coalesce("l2", F.lit("+")), F.lit("\n"), F.coalesce("l3", F.lit("")), F.lit("\n")).alias("post"), F.col("l3").alias("qual"))
    elif kind == "sam":
        lines = _numbered_lines(spark, path).where("not startswith(value, '@') and trim(value) <> ''")
        g = lambda i: F.regexp_extract("value", r"^((?:\S+\s+){9})(\S+)(.*)$", i)
        rows = lines.select("n", g(1).alias("pre"), g(2).alias("seq"), F.concat(g(3), F.lit("\n")).alias("post"), F.get(F.split("value", r"\s+"), 10).alias("qual"))
    else:
        rows = _numbered_lines(spark, path).select("n", F.lit("").alias("pre"), F.trim("value").alias("seq"), F.lit("\n").alias("post"), F.lit(None).cast("string").alias("qual"))
    rows = rows.withColumn("seq", F.upper("seq")).where("seq <> ''")
    return rows.select(F.lit(lib_id).alias("lib_id"), F.col("n").alias("read_id"), "pre", "seq", "post", "qual")


def read_libraries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All libraries in order, told apart by lib_id."""
    out = None
    for i, path in enumerate(paths):
        one = read_reads(spark, path, i)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no library is given")
    return out


def wrapped(seq, width: int = 70):
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def write_reads(reads: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    """Records in read order: as they were around the sequence, FASTA wrapped at 70."""
    if kind not in FORMATS:
        raise ValueError(kind)
    body = F.concat("pre", wrapped(F.col("seq")) if kind == "fasta" else F.col("seq"), F.regexp_replace("post", "\n$", ""))
    reads.orderBy("lib_id", "read_id").select(body.alias("value")).write.mode(mode).text(path)


def _cut_reads(batches, length: int, step: int):
    wide = LETTERS // step * step
    for batch in batches:
        ids, texts = batch.column(0), batch.column(2)
        for at in range(0, batch.num_rows, TEXTS):
            rows, parts, held = [], [], 0
            for row in range(at, min(at + TEXTS, batch.num_rows)):
                s = S.dna_bytes(texts[row].as_buffer()) if texts[row].is_valid else b""
                for tile in range(0, len(s), wide):
                    cut = [s[i : i + length] for i in range(tile, min(tile + wide, len(s)), step)]
                    rows.append((row, tile // step, len(cut)))
                    parts += cut
                    held += len(cut)
                    if held * length >= LETTERS:
                        yield _read_rows(ids, batch.column(1), rows, parts)
                        rows, parts, held = [], [], 0
            if parts:
                yield _read_rows(ids, batch.column(1), rows, parts)


def _read_rows(ids, sources, rows: list, parts: list[bytes]):
    row, first, n = np.array(rows).T
    run = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + first[run]
    taken = pa.array(row[run])
    read_id = pc.add_checked(pc.multiply_checked(ids.take(taken), READS_A_DOC), pa.array(nth))
    return pa.RecordBatch.from_arrays([read_id, sources.take(taken), pa.array(parts, pa.binary()).cast(pa.string())], names=["read_id", "source", "seq"])


def documents_as_reads(spark: SparkSession, sf_dir: str, length: int = 100, step: int = 50) -> DataFrame:
    """(read_id, source, seq): documents projected onto DNA and cut into overlapping reads; every document, whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return docs.mapInArrow(partial(_cut_reads, length=length, step=step), "read_id long, source string, seq string")


def _projected(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            texts = [S.dna_bytes(x.as_buffer()) if x.is_valid else None for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["ref_id", "seq"])


def documents_as_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, seq): whole documents projected onto DNA."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ref_id"), F.col("text").cast("string"))
    return docs.mapInArrow(_projected, StructType([docs.schema["ref_id"], StructField("seq", StringType())]))
