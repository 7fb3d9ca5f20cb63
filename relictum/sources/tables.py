"""Taxonomy dumps, accession maps, count files and result tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTEGER = r"^\s*([-+]?[0-9]+)"


def _dump(spark: SparkSession, path: str) -> tuple[DataFrame, list[Column]]:
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> ''")
    return rows, [F.get(F.split(F.regexp_replace("value", "[\t\r\n]", ""), r"\|"), F.lit(i)) for i in range(4)]


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, name): scientific names, the first of a taxid."""
    rows, v = _dump(spark, path)
    own = rows.where(v[3] == "scientific name").select("line", F.try_to_number(v[0], F.lit("999999999")).cast("int").alias("taxid"), v[1].alias("name"))
    return own.groupBy("taxid").agg(F.min_by("name", "line").alias("name"))


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, parent, rank), the first line of a taxid."""
    rows, v = _dump(spark, path)
    own = rows.select("line", v[0].try_cast("int").alias("taxid"), v[1].try_cast("int").alias("parent"), v[2].alias("rank")).where("taxid is not null and parent is not null")
    return own.groupBy("taxid").agg(F.min_by(F.struct("parent", "rank"), "line").alias("x")).select("taxid", "x.parent", "x.rank")


def read_acc2tax(spark: SparkSession, path: str, refs: DataFrame | None = None) -> DataFrame:
    """(rname, taxid): second and third column after a header line, the last line of a name; only the names in refs, if given."""
    rows = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where("trim(value) <> '' and line > 0")
    v = F.split(F.trim("value"), r"\s+")
    own = rows.select("line", F.get(v, F.lit(1)).alias("rname"), F.get(v, F.lit(2)).try_cast("int").alias("taxid")).where("taxid is not null")
    if refs is not None:
        own = own.join(refs.select("rname", "tid"), "rname")
        return own.groupBy("rname", "tid").agg(F.max_by("taxid", "line").alias("taxid"))
    return own.groupBy("rname").agg(F.max_by("taxid", "line").alias("taxid"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(label): the first word of each line that is no comment."""
    first = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    return spark.read.text(path).where("trim(value) <> '' and value not like '#%'").select(first.alias("label")).distinct()


def encode_matrices(rows: list[tuple[int, int, list[float], list[float]]], positions: int) -> bytes:
    """The binary exchange format: L, then id, nreads and 2 * 16 * L floats for each id, ascending; ids without reads are left out."""
    out = [struct.pack("<i", positions)]
    for i, n, fw, bw in sorted(rows):
        if n:
            if n >= 1 << 31:
                raise OverflowError("number of reads beyond 32 bits")
            out.append(struct.pack(f"<ii{32 * positions}f", i, n, *fw, *bw))
    return gzip.compress(b"".join(out))


def decode_matrices(content: bytes) -> Iterator[tuple[int, int, list[float], list[float]]]:
    raw = gzip.decompress(content)
    (positions,) = struct.unpack_from("<i", raw)
    step = struct.Struct(f"<ii{32 * positions}f")
    for at in range(4, len(raw) - step.size + 1, step.size):
        i, n, *cells = step.unpack_from(raw, at)
        yield i, n, cells[: 16 * positions], cells[16 * positions :]


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(id, nal, fw, bw) of files in the binary exchange format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(decode_matrices(content.as_py()))
                if rows:
                    i, n, fw, bw = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(n, pa.int64()), pa.array(fw, pa.list_(pa.float64())), pa.array(bw, pa.list_(pa.float64()))], names=["id", "nal", "fw", "bw"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id int, nal long, fw array<double>, bw array<double>")


def write_matrices(rows: DataFrame, path: str, positions: int) -> None:
    """One local file in the binary exchange format, written by the driver as rows arrive in id order. Parquet is the table format."""
    with gzip.open(path, "wb") as f:
        f.write(struct.pack("<i", positions))
        for r in rows.where("nal > 0").orderBy("id").toLocalIterator(prefetchPartitions=True):
            f.write(struct.pack(f"<ii{32 * positions}f", r.id, r.nal, *r.fw, *r.bw))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(id, rlen, cnt) of a length file, sparse (id, then len:cnt ..) or flat (id, len, cnt); repeated ids add up."""
    rows = spark.read.text(path).where("value rlike '^[0-9]+\t'").select(F.split("value", "\t").alias("v"))
    sparse = rows.where("v[1] like '%:%'").select(F.col("v")[0].cast("int").alias("id"), F.explode(F.slice("v", F.lit(2), F.size("v"))).alias("x")).where("x like '%:%'")
    sparse = sparse.select("id", F.substring_index("x", ":", 1).cast("int").alias("rlen"), F.substring_index("x", ":", -1).cast("long").alias("cnt"))
    flat = rows.where("v[1] not like '%:%' and size(v) >= 3").select(F.col("v")[0].cast("int").alias("id"), F.col("v")[1].cast("int").alias("rlen"), F.col("v")[2].cast("long").alias("cnt"))
    return sparse.unionByName(flat).groupBy("id", "rlen").agg(F.sum("cnt").alias("cnt"))


def lengths_text(rows: DataFrame, sparse: bool = True) -> DataFrame:
    """(id, value): lines of a length file."""
    if not sparse:
        return rows.select("id", F.concat_ws("\t", "id", "rlen", "cnt").alias("value"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("rlen", "cnt"))), lambda x: F.concat_ws(":", x["rlen"].cast("string"), x["cnt"].cast("string")))
    return rows.where("cnt > 0").groupBy("id").agg(cells.alias("x")).select("id", F.concat_ws("\t", F.col("id").cast("string"), F.array_join("x", "\t")).alias("value"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, nreads, mean and var of len and gc, and of dust and nspec where the file has them); other lines are skipped."""
    v = F.split("value", "\t")
    pairs = [f"{m}_{x}" for x in ("len", "gc", "dust", "nspec") for m in ("mean", "var")]
    rows = spark.read.text(path).select(F.get(v, F.lit(0)).try_cast("int").alias("taxid"), F.get(v, F.lit(1)).try_cast("long").alias("nreads"), *[F.get(v, F.lit(i + 2)).try_cast("double").alias(p) for i, p in enumerate(pairs)])
    return rows.where("taxid is not null and nreads is not null and var_gc is not null")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header, as text."""
    return spark.read.csv(path, sep="\t", header=True)


def read_fits(spark: SparkSession, path: str) -> DataFrame:
    """A table of fits with whatever columns its header names: taxid and ncall as whole numbers, all others as doubles."""
    rows = read_table(spark, path)
    if "taxid" not in rows.columns:
        raise ValueError("a table of fits has a column taxid")
    kind = {"taxid": "int", "ncall": "long"}
    number = lambda c: F.col(f"`{c}`").try_cast("double").try_cast(kind[c]) if c in kind else F.col(f"`{c}`").try_cast("double")
    return rows.select(*[number(c).alias(c) for c in rows.columns]).where("taxid is not null")


def write_table(rows: DataFrame, path: str, order: list[str]) -> None:
    """A tab-separated file set with a header, sorted; doubles with six decimals, nulls as NA."""
    shown = [F.when(F.col(c).isNull(), F.lit("NA")).otherwise(F.format_string("%f", c) if t == "double" else F.col(c).cast("string")).alias(c) for c, t in rows.dtypes]
    rows.orderBy(*order).select(*shown).write.csv(path, sep="\t", header=True, compression="gzip", quote="")
