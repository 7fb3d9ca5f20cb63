"""Token-id output in a compressed binary format, and its reader (op10).

Documents are dealt by ascending doc_id into parts; a part's ids are cut into blocks of coder.BLOCK ids, each coded from a
fresh model and closed by checksums, so any block can be read alone and a damaged one is found. A block holds:

    magic 4s, version u16, reserved u16, ids u32, pieces u32, crc32 of its ids (little-endian u32) u32,
    for each piece: doc_id i64, flags u32 (1: doc_id is null), place in the part u64 of the document, of its first id u64, ids u32,
    payload length u32, payload, crc32 of all before u32

Blocks are rows of a Parquet table (part, block, n, data) in the shared folder: executors can write nothing else there.

Defined results: null text is empty, so the document is its end id alone; null doc_ids come first; rows of equal doc_id
follow each other, those of equal text too; other columns are ignored; an empty table gives an empty file set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import coder, shared
from relictum.llm.tokens import encoder, groups

VOCABULARY, END = "word_bpe_49k.json", 1
HEAD, PIECE = struct.Struct("<4sHHIII"), struct.Struct("<qIQQI")
MAGIC, VERSION = b"RLTK", 2


def write_block(ids: np.ndarray, pieces: list[tuple], payload: bytes) -> bytes:
    """pieces: (doc_id or None, document's number in the part, place of its first id in the part, ids)."""
    raw = HEAD.pack(MAGIC, VERSION, 0, len(ids), len(pieces), zlib.crc32(ids.astype("<u4").tobytes()))
    raw += b"".join(PIECE.pack(doc or 0, doc is None, number, at, n) for doc, number, at, n in pieces)
    raw += struct.pack("<I", len(payload)) + payload
    return raw + struct.pack("<I", zlib.crc32(raw))


def read_head(raw: bytes) -> tuple[int, int, list[tuple], bytes]:
    """Number of ids, their crc32, pieces and payload; ValueError for a damaged block."""
    if len(raw) < HEAD.size + 8 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
        raise ValueError("block checksum does not match")
    magic, version, _, n, count, crc = HEAD.unpack_from(raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    pieces = []
    for i in range(count):
        doc, flags, number, at, m = PIECE.unpack_from(raw, HEAD.size + i * PIECE.size)
        pieces.append((None if flags & 1 else doc, number, at, m))
    low = HEAD.size + count * PIECE.size
    return n, crc, pieces, raw[low + 4 : low + 4 + struct.unpack_from("<I", raw, low)[0]]


def read_blocks(raws: list[bytes]) -> list[tuple[np.ndarray, list[tuple]]]:
    """(ids, pieces) of each block, checked against its checksums."""
    heads = [read_head(r) for r in raws]
    out = []
    for (n, crc, pieces, _), ids in zip(heads, coder.decode([h[3] for h in heads], [h[0] for h in heads]), strict=True):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("ids do not match their checksum")
        out.append((ids, pieces))
    return out


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, folder: str | None = None) -> None:
    """docs(doc_id, text) -> a table of blocks at path, in ascending doc_id order by (part, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, folder).batch, TaskContext.get().partitionId()
        ready: list[tuple[np.ndarray, list]] = []
        held: list[np.ndarray] = []
        pieces: list[tuple] = []
        room, number, total, block = coder.BLOCK, 0, 0, 0

        def flush():
            nonlocal ready, block
            raws = [write_block(ids, own, data) for (ids, own), data in zip(ready, coder.encode([x[0] for x in ready]), strict=True)]
            arrays = [pa.array([part] * len(raws), pa.int32()), pa.array(range(block, block + len(raws)), pa.int32()), pa.array([len(x[0]) for x in ready], pa.int64()), pa.array(raws, pa.binary())]
            block += len(raws)
            ready = []
            return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "n", "data"])

        for batch in batches:
            ids_of = (ids for own in groups(batch.column(1).to_pylist()) for ids in encode(own))
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(end))
                while len(ids):
                    own, ids = ids[:room], ids[room:]
                    held.append(own)
                    pieces.append((doc, number, total, len(own)))
                    room -= len(own)
                    total += len(own)
                    if room == 0:
                        ready.append((np.concatenate(held), pieces))
                        held, pieces, room = [], [], coder.BLOCK
                        if len(ready) == coder.LANES:
                            yield flush()
                number += 1
        if held:
            ready.append((np.concatenate(held), pieces))
        if ready:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(run, "part int, block int, n long, data binary").write.option("compression", "none").parquet(path)


def combine(crcs: list[int], lengths: list[int]) -> int:
    """crc32 of a concatenation, from the parts' crc32 and byte lengths. Bytes move a CRC on by what zeros would, xor what they are
    alone beside zeros."""
    out = crcs[0]
    for crc, n in zip(crcs[1:], lengths[1:], strict=True):
        zeros = bytes(n)
        out = zlib.crc32(zeros, out) ^ zlib.crc32(zeros) ^ crc
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written pieces: part, number, doc_id, at (in the part), n, ids (little-endian u32 as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, raws = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(parts), coder.LANES):
                own = [x.as_py() for x in raws[low : low + coder.LANES]]
                rows = []
                for part, (ids, pieces) in zip(parts[low : low + coder.LANES], read_blocks(own), strict=True):
                    data, start = ids.astype("<u4").tobytes(), 0
                    for doc, number, at, n in pieces:
                        rows.append((part, number, doc, at, n, data[4 * start : 4 * (start + n)]))
                        start += n
                columns = zip(*rows, strict=True)
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "number", "doc_id", "at", "n", "ids"])

    return spark.read.schema("part int, block int, n long, data binary").parquet(path).select("part", "data").mapInArrow(run, "part int, number long, doc_id long, at long, n long, ids binary")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at path."""
    sizes = spark.read.schema("part int, block int, n long, data binary").parquet(path).groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row for each part
    starts, total = [], 0
    for part, n in sorted(map(tuple, sizes)):
        starts.append((part, total))
        total += n
    place = spark.createDataFrame(starts, "part int, before long")
    pieces = read(spark, path).select("part", "number", "doc_id", "at", "n", F.crc32("ids").alias("crc"))
    docs = pieces.groupBy("part", "number").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("own"))
    joined = docs.join(place, "part").select("doc_id", (F.col("before") + F.col("own")[0]["at"]).alias("start"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(2).offsets.to_numpy()
            first = first - first[0]
            _, sizes, crcs = (x.to_numpy() for x in batch.column(2).flatten().flatten())
            n, crc = np.add.reduceat(sizes, first[:-1]), crcs[first[:-1]]
            for i in np.flatnonzero(np.diff(first) > 1):
                own = slice(first[i], first[i + 1])
                crc[i] = combine(crcs[own].tolist(), (4 * sizes[own]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.path(spark, "token-ids")
    write(shared.read(spark, sf_dir, "documents"), path)
    return documents(spark, path)
