"""The cleaning pipeline: documents in, packed training sequences out.

Each stage works on what its predecessor kept and returns the columns of documents, but for the last, which returns the
packed pieces with their token ids. `run` writes every stage as Parquet in the shared folder and reads it again.

In every stage but the last, other columns pass through whatever their names, an empty table gives none, and nulls in lang, source,
doc_id or n_chars do not matter but where a stage says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relictum.llm import decontam, packing, quality, shared, simhash, suffix


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their group's thresholds reject go: null, blank and very short texts too. Null lang and source are
    groups of their own; repeated rows are judged alike."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest doc_id (a null one only if all are); of equal rows,
    one. Null and blank texts are near-duplicates of each other."""
    return simhash.dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words or of 400 bytes go; so does a document of which nothing is left. Null texts stay; repeated rows
    count as documents, so both lose what they share. n_chars is that of the input."""
    return suffix.dedup(docs, words=suffix.STAGE_WORDS).where("text is null or trim(text) <> ''")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null texts hold none."""
    return decontam.clean(docs, shared.read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids, one row each; other columns are left behind. A null text is its end id alone, repeated rows
    are packed each, and an empty table gives no piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("packing", packed),
]

#: SimHash classes, quantile sketches and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
