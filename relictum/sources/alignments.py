"""Alignments from SAM text and BAM files, and writers. CRAM needs codecs that are not here.

Columns: aln_idx, qname, flag, tid, rname, pos (0-based), mapq, cigar, mtid, seq, qual (array), md, nm, as_score."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "aln_idx long, qname string, flag int, tid int, rname string, pos int, mapq int, cigar string, mtid int, seq string, qual array<int>, md string, nm int, as_score int"
NT16, CIGAR = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a number that follows their order in the file."""
    return spark.read.text(path).withColumn("aln_idx", F.monotonically_increasing_id())


def header(spark: SparkSession, path: str) -> list[str]:
    """Header lines of a SAM file. Headers are small; they come to the driver."""
    rows = lines(spark, path).where("value like '@%'").orderBy("aln_idx").collect()
    return [r.value for r in rows]


def references(head: list[str]) -> list[tuple[int, str, int]]:
    """(tid, name, length) of the @SQ lines in their order."""
    out = []
    for line in head:
        if line.startswith("@SQ"):
            tags = dict(x.split(":", 1) for x in line.split("\t")[1:])
            out.append((len(out), tags["SN"], int(tags.get("LN", 0))))
    return out


def check_order(head: list[str], ignore: bool = False) -> None:
    """Input must be grouped by read name: the first line is @HD and says so."""
    if not ignore and not (head and head[0].startswith("@HD") and "SO:queryname" in head[0]):
        raise ValueError("input is not sorted by read name")


def refs_frame(spark: SparkSession, head: list[str]) -> DataFrame:
    return spark.createDataFrame(references(head), "tid int, rname string, len int")


def read_sam(spark: SparkSession, path: str, ignore_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(alignments, refs) of a SAM text file (compressed or not)."""
    head = header(spark, path)
    check_order(head, ignore_order)
    refs = refs_frame(spark, head)
    v = F.split("value", "\t")
    tag = lambda name: F.get(F.filter(v, lambda x: x.startswith(name)), F.lit(0))
    number = lambda name: F.substring_index(tag(name), ":", -1).try_cast("int")
    rows = lines(spark, path).where("value not like '@%' and value <> ''").select(
        "aln_idx", F.get(v, F.lit(0)).alias("qname"), F.get(v, F.lit(1)).try_cast("int").alias("flag"), F.get(v, F.lit(2)).alias("rname"), (F.get(v, F.lit(3)).try_cast("int") - 1).alias("pos"), F.get(v, F.lit(4)).try_cast("int").alias("mapq"), F.get(v, F.lit(5)).alias("cigar"),
        F.when(v[6] == "=", v[2]).otherwise(v[6]).alias("mname"), F.get(v, F.lit(9)).alias("seq"), F.get(v, F.lit(10)).alias("q"), F.substring(tag("MD:Z:"), 6, 1 << 30).alias("md"),
        number("NM:i:").alias("nm"), number("AS:i:").alias("as_score"),
    )
    rows = rows.withColumn("qual", F.when(F.col("q") == "*", F.array_repeat(F.lit(255), F.length("seq"))).otherwise(F.transform(F.split("q", ""), lambda c: F.ascii(c) - 33)))
    own = refs.select("tid", "rname")
    rows = rows.join(own, "rname", "left").join(own.select(F.col("tid").alias("mtid"), F.col("rname").alias("mname")), "mname", "left")
    known = F.when(F.col("tid").isNull() & (F.col("rname") != "*"), F.raise_error(F.concat(F.lit("no @SQ for "), F.col("rname"))).cast("int")).otherwise(F.coalesce("tid", F.lit(-1)))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return rows.withColumn("tid", known).withColumn("mtid", F.coalesce("mtid", F.lit(-1))).select(*names), refs


def decode_header(raw: bytes) -> tuple[list[str], list[tuple[int, str, int]], int]:
    """Header lines, references and the place of the first record of a decompressed BAM file."""
    if raw[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    (size,) = struct.unpack_from("<i", raw, 4)
    head = raw[8 : 8 + size].rstrip(b"\0").decode().splitlines()
    at = 8 + size
    (count,) = struct.unpack_from("<i", raw, at)
    at += 4
    refs = []
    for tid in range(count):
        (n,) = struct.unpack_from("<i", raw, at)
        refs.append((tid, raw[at + 4 : at + 3 + n].decode(), struct.unpack_from("<i", raw, at + 4 + n)[0]))
        at += 8 + n
    return head, refs, at


def decode_records(raw: bytes, at: int, refs: list[tuple[int, str, int]]) -> Iterator[tuple]:
    """Rows of SCHEMA from decompressed BAM records."""
    index = 0
    sizes = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    while at < len(raw):
        (size,) = struct.unpack_from("<i", raw, at)
        tid, pos, name_n, mapq, _, ops, flag, n, mtid, _, _ = struct.unpack_from("<iiBBHHHiiii", raw, at + 4)
        p = at + 36
        name = raw[p : p + name_n - 1].decode()
        p += name_n
        cigar = "".join(f"{c >> 4}{CIGAR[c & 15]}" for c in struct.unpack_from(f"<{ops}I", raw, p)) or "*"
        p += 4 * ops
        packed = raw[p : p + (n + 1) // 2]
        seq = "".join(NT16[b >> 4] + NT16[b & 15] for b in packed)[:n]
        p += len(packed)
        qual = list(raw[p : p + n])
        p += n
        tags: dict[str, object] = {}
        end = at + 4 + size
        while p < end:
            tag, kind = raw[p : p + 2].decode(), chr(raw[p + 2])
            p += 3
            if kind in "ZH":
                stop = raw.index(b"\0", p)
                tags[tag] = raw[p:stop].decode()
                p = stop + 1
            elif kind == "A":
                tags[tag] = chr(raw[p])
                p += 1
            elif kind == "B":
                sub, (count,) = chr(raw[p]), struct.unpack_from("<i", raw, p + 1)
                p += 5 + count * struct.calcsize(sizes[sub])
            else:
                (tags[tag],) = struct.unpack_from("<" + sizes[kind], raw, p)
                p += struct.calcsize(sizes[kind])
        yield index, name, flag, tid, refs[tid][1] if tid >= 0 else "*", pos, mapq, cigar, mtid, seq, qual, tags.get("MD"), tags.get("NM"), tags.get("AS")
        index += 1
        at = end


def read_bam(spark: SparkSession, path: str, ignore_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """(alignments, refs) of BAM files. BGZF is gzip in members. A file is one task; large inputs should come as several files.

    aln_idx numbers records by the file's place among the sorted paths, then by their place in the file. All files must name
    the same references in the same order."""
    files = spark.read.format("binaryFile").load(path)
    place = {r.path: i for i, r in enumerate(files.select("path").orderBy("path").collect())}  # a path for each file

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                head, refs, _ = decode_header(gzip.decompress(content.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(["\n".join(head)]), pa.array([[r[1] for r in refs]]), pa.array([[r[2] for r in refs]], pa.list_(pa.int32()))], names=["head", "names", "sizes"])

    first = files.orderBy("path").limit(1).select("content").mapInArrow(heads, "head string, names array<string>, sizes array<int>").first()
    check_order(first.head.splitlines(), ignore_order)
    refs = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(zip(first.names, first.sizes))], "tid int, rname string, len int")
    expected = list(zip(first.names, first.sizes))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = gzip.decompress(content.as_py())
                _, own, at = decode_header(raw)
                if [x[1:] for x in own] != expected:
                    raise ValueError(f"{path} has other references than the first file")
                held, before = [], place[path] << 40
                for row in decode_records(raw, at, own):
                    held.append((before + row[0], *row[1:]))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

    return files.select("path", "content").mapInArrow(records, SCHEMA), refs


def sam_lines(rows: DataFrame) -> DataFrame:
    """Alignments as SAM text lines (value), without a header."""
    tags = [F.when(F.col(c).isNotNull(), F.concat(F.lit(t), F.col(c).cast("string"))) for c, t in (("md", "MD:Z:"), ("nm", "NM:i:"), ("as_score", "AS:i:"))]
    qual = F.array_join(F.transform("qual", lambda q: F.char(q + 33)), "")
    return rows.select("aln_idx", F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", qual, *tags).alias("value"))


def subset_header(head: list[str], kept: list[str]) -> list[str]:
    """A header with only the references named, in the order given; all its other lines stay, in their places."""
    lines = {dict(x.split(":", 1) for x in line.split("\t")[1:])["SN"]: line for line in head if line.startswith("@SQ")}
    lost = [name for name in kept if name not in lines]
    if lost:
        raise ValueError(f"no @SQ line for {lost[0]}")
    first = next((i for i, line in enumerate(head) if line.startswith("@SQ")), len(head))
    return [*(x for x in head[:first]), *(lines[name] for name in kept), *(x for x in head[first:] if not x.startswith("@SQ"))]


def write_sam(rows: DataFrame, path: str, head: list[str], compression: str = "none") -> None:
    """SAM text in input order: the header as the first line of the first part, then range-sorted parts."""
    top = rows.sparkSession.createDataFrame([(-1, "\n".join(head))], "aln_idx long, value string")
    out = sam_lines(rows)
    (top.unionByName(out) if head else out).orderBy("aln_idx").select("value").write.option("compression", compression).text(path)
