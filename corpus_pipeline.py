"""documents -> toxicity -> line dedup -> SimHash near-dedup -> best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of docs, extra ones of any name included. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.llm import lines, packing, simhash, toxicity
from strandwork.llm.common import fresh, stored, table
from strandwork.llm.queries import MAX_TRAIN, SITES, _path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go; it is fitted on documents and labels under sf_dir.

    Rows of null key, null or empty text and repeated rows are judged by their text alone.
    """
    model = toxicity.train_from_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MAX_TRAIN)
    return toxicity.reject_toxic(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on SITES sites or more stay at their first place only; documents of which nothing is left go.

    n_chars follows the text where lines went. Null and empty texts lose no line and stay.
    """
    total, gone = fresh(docs.columns, "n_lines"), fresh(docs.columns, "n_removed")
    cut = lines.remove_boilerplate(docs, SITES, counts=(total, gone))
    left = cut.where((F.col(gone) == 0) | (F.length(F.trim("text")) > 0))
    chars = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return left.select(*[chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that of the smallest doc_id, a null one being the last. Null and blank texts are one class."""
    return simhash.keep_one(docs, 4)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 1024 tokens. A null or empty text is its end id alone."""
    return packing.pack(docs, _path("byte_bpe_50k.json"), 1024, 2)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash_dedup", drop_near_copies), ("best_fit_packing", pack_sequences)]

#: Toxicity and fingerprints have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
