"""Tables that cut lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset and everything runs in one process, as in tests, a temporary folder of
    our own; on a cluster an error, as no other machine would see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="relictum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/relictum/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a lost executor never recomputes what lies before."""
    spark = df.sparkSession
    at = path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.written_at)


def place(spark: SparkSession, at: str) -> tuple:
    """The file system that holds a path, and the path, as Spark's own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, at: str) -> None:
    files, path = place(spark, at)
    files.delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked(df: DataFrame, kept: list[str], made: list[str]) -> tuple[DataFrame, list]:
    """df with its columns beside `kept` under names that clash with nothing, and the columns that bring their names back.
    A column that a result of that name (`made`) replaces is left out."""
    others = [c for c in df.columns if c not in kept and c not in made]
    hidden = [f"extra{i}_" for i in range(len(others))]
    return df.select(*[F.col(f"`{c}`") for c in kept if c in df.columns], *[F.col(f"`{c}`").alias(h) for c, h in zip(others, hidden)]), [F.col(h).alias(c) for c, h in zip(others, hidden)]


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name += "_"
    return name


def row_id():
    """An id for a row of documents that stands nulls and repeated doc_ids: equal only for equal (doc_id, text)."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))
