"""Bounded-space online packing of token ids into sequences (op2 and the pipeline's last stage).

A partition keeps OPEN windows open. What a document has beyond whole sequences goes, best fit, into the open window it
leaves fullest; when it fits none, it is cut to fill the fullest window, which is emitted. At the end the leftovers are
merged: their pieces are cut into full sequences, and the last rest into sequences of powers of two, so nothing is padded.
No shuffle: a partition packs what it reads, holding one document and OPEN windows.

Defined results: null text is empty, so the document is its end id alone; repeated rows are packed each; extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from relictum.llm import shared
from relictum.llm.tokens import encoder, groups

SIZE, OPEN, END = 1024, 64, 0
VOCABULARY = "byte_bpe_50k.json"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
TYPES = [pa.int64()] * 7


class Packer:
    """pieces come out as (doc_id, start, ids, doc_tokens, sequence number, offset)."""

    def __init__(self, size: int = SIZE, windows: int = OPEN):
        self.size, self.windows = size, windows
        self.open: list[tuple[int, list]] = []  # (used, pieces)
        self.made = 0

    def emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, self.made, at
            at += len(ids)
        self.made += 1

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[tuple]:
        total, size = len(ids), self.size
        at = total - total % size
        for low in range(0, at, size):
            yield from self.emit([(doc, low, ids[low : low + size], total)])
        while at < total:
            left = total - at
            fit = [(used, i) for i, (used, _) in enumerate(self.open) if used + left <= size]
            if fit:
                used, i = max(fit)
                take = left
            elif len(self.open) < self.windows:
                used, i, take = 0, len(self.open), left
                self.open.append((0, []))
            else:
                used, i = max((used, i) for i, (used, _) in enumerate(self.open))
                take = size - used
            pieces = self.open[i][1]
            pieces.append((doc, at, ids[at : at + take].copy(), total))
            self.open[i] = (used + take, pieces)
            at += take
            if used + take == size:
                self.open.pop(i)
                yield from self.emit(pieces)

    def finish(self) -> Iterator[tuple]:
        """The leftovers, fullest first, as full sequences and then as powers of two."""
        pieces = [p for _, own in sorted(self.open, key=lambda x: -x[0]) for p in own]
        left = sum(len(p[2]) for p in pieces)
        own: list = []
        room = goal(left, self.size)
        for doc, start, ids, total in pieces:
            while len(ids):
                own.append((doc, start, ids[:room], total))
                start, room, left, ids = start + len(own[-1][2]), room - len(own[-1][2]), left - len(own[-1][2]), ids[room:]
                if room == 0:
                    yield from self.emit(own)
                    own, room = [], goal(left, self.size)
        self.open = []


def goal(left: int, size: int) -> int:
    return min(size, 1 << max(0, left.bit_length() - 1))


def pack(docs: DataFrame, size: int = SIZE, windows: int = OPEN, vocabulary: str = VOCABULARY, end: int = END, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> one row for each piece, with its ids; pieces of a sequence follow one another by offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        encode, packer = encoder(vocabulary, folder).batch, Packer(size, windows)
        out: list[tuple] = []
        held = 0

        def batch_of():
            doc, start, ids, total, seq, off = zip(*out, strict=True)
            ids = [np.ascontiguousarray(x, "<u4") for x in ids]
            columns = [doc, start, [len(x) for x in ids], [zlib.crc32(x) for x in ids], total, [first + s for s in seq], off]
            arrays = [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, names=NAMES + ["ids"] * with_ids)

        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, ids in zip(docs, (ids for own in groups(texts) for ids in encode(own)), strict=True):
                for piece in packer.add(doc, np.append(ids, np.uint32(end))):
                    out.append(piece)
                    held += len(piece[2])
                    if held > 1_000_000:
                        yield batch_of()
                        out, held = [], 0
        out.extend(packer.finish())
        if out:
            yield batch_of()

    schema = ", ".join(f"{c} long" for c in NAMES) + (", ids array<int>" if with_ids else "")
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.read(spark, sf_dir, "documents"), with_ids=False)
