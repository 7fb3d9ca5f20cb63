"""The Spark side of the repeated-window search: from segments to the removed stretches of each document.

1. `segment_rows`: one Arrow pass over the texts gives the segments (see windows.py), a few tens of bytes each.
2. `repeated_keys`: partial aggregation by key; keys of total weight 1 cannot repeat and go no further.
3. `candidates`: segments of the other keys. Both sides of this join are plain tables, so AQE can split a hot key.
4. `representatives`: one row for each distinct segment text; a hot passage shrinks to its distinct surroundings here.
   Segments that exist only as whole copies are done; only the others fetch their text.
5. Keys of up to HOT segments go to one task each, to the operator's own worker. Beyond that the windows of the distinct
   segments are counted one by one by a 128-bit hash with partial aggregation, so no task ever holds a hot key.
6. `spans`: found window ranges go back to all copies of a segment and are united by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm import shared
from relictum.llm.windows import BYTE_CODE, grams, mix, prefix, segments, texts_of, union, word_codes, word_spans

#: A key with more segments than this is dealt by window instead of by key.
HOT = 1000

SEGMENT = "key long, digest long, rid long, start int, n int, weight int"
PIECE = "key long, digest long, n int, data binary"
MARK = "key long, digest long, froms array<int>, tos array<int>"


def units_of(text: np.ndarray, unit: str):
    """The document's units as 64-bit values, and for words their spans."""
    if unit == "byte":
        return BYTE_CODE[text], None
    spans = word_spans(text)
    return word_codes(text, *spans), spans


def segment_rows(docs: DataFrame, unit: str, width: int, k: int) -> DataFrame:
    """docs(rid, text) -> SEGMENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at = texts_of(batch.column(1))
            rids = batch.column(0).to_numpy(zero_copy_only=False)
            rows, held = [], 0
            for i in range(len(rids)):
                if at[i + 1] - at[i] < width:  # neither a window of bytes nor of words
                    continue
                found = segments(units_of(text[at[i] : at[i + 1]], unit)[0], width, k)
                if len(found[0]):
                    rows.append((*found, np.full(len(found[0]), rids[i])))
                    held += len(found[0])
                if held > 200_000:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)

    def pack(rows):
        key, digest, start, n, weight, rid = (np.concatenate(x) for x in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(rid.astype(np.int64)), *(pa.array(x.astype(np.int32)) for x in (start, n, weight))], names=["key", "digest", "rid", "start", "n", "weight"])

    return docs.select("rid", "text").mapInArrow(run, SEGMENT)


def repeated_keys(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("key")
        .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("copies"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        .where("weight >= 2")
        .select("key", (F.col("low") != F.col("high")).alias("several"), (F.col("copies") > HOT).alias("hot"))
    )


def candidates(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.select("key", "digest", "rid", "start", "n").join(keys, "key")


def pieces(docs: DataFrame, wanted: DataFrame, unit: str, width: int, to_rows: Callable, schema: str) -> DataFrame:
    """Texts of the wanted representatives (key, digest, rid, start, n), through to_rows(list of (key, digest, n, bytes)).

    docs keeps all its columns, so that its shuffle by rid is the one that `applied` reads too."""
    by_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "digest", "start", "n")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at = texts_of(batch.column("text"))
            lists = batch.column("want")
            flat = lists.flatten()
            key, digest, start, n = (flat.field(x).to_numpy() for x in ("key", "digest", "start", "n"))
            ends = np.cumsum(lists.value_lengths().to_numpy())
            got, held, low = [], 0, 0
            for i, high in enumerate(ends):
                own = text[at[i] : at[i + 1]]
                raw = own.tobytes()
                if unit == "word":
                    s, e = word_spans(own)
                for j in range(low, high):
                    if unit == "byte":
                        data = raw[start[j] : start[j] + n[j] + width - 1]
                    else:
                        words = range(start[j], start[j] + n[j] + width - 1)
                        data = b" ".join([raw[s[w] : e[w]] for w in words])
                    got.append((int(key[j]), int(digest[j]), int(n[j]), data))
                    held += len(data)
                    if held > 4_000_000:
                        yield from to_rows(got)
                        got, held = [], 0
                low = high
            if got:
                yield from to_rows(got)

    return docs.join(by_doc, "rid").select(*[c for c in docs.columns if c != "rid"], "want").mapInArrow(run, schema)


def plain_rows(got):
    key, digest, n, data = zip(*got, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.int64()), pa.array(n, pa.int32()), pa.array(data, pa.binary())], names=["key", "digest", "n", "data"])


def window_rows(unit: str, width: int):
    """Every window of the given segments by a 128-bit hash."""

    def make(got):
        out = []
        for key, digest, n, data in got:
            units = units_of(np.frombuffer(data, np.uint8), unit)[0]
            one, two = grams(prefix(units), width), grams(prefix(mix(units + np.uint64(77))), width)
            out.append((np.full(n, key), np.full(n, digest), np.arange(n, dtype=np.int32), one.view(np.int64), two.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["key", "digest", "at", "h1", "h2"])

    return make


def by_key(rows: DataFrame, worker: Callable[[list[bytes], list[int]], list[np.ndarray]], block: int) -> DataFrame:
    """Runs worker on the segments of whole keys, about `block` bytes at a time. It gets the texts and their numbers of
    windows and returns a flag for each window that stands twice or more among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] == held[-1][:2]:  # equal rows of documents share a rid; one of them is enough
                    continue
                if size > block and row[0] != held[-1][0]:
                    yield from marked(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield from marked(held)

    def marked(held):
        flags = worker([x[3] for x in held], [x[2] for x in held])
        out = []
        for (key, digest, _, _), flag in zip(held, flags, strict=True):
            step = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
            if len(step):
                out.append((key, digest, step[::2].tolist(), step[1::2].tolist()))
        if out:
            key, digest, froms, tos = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(digest, pa.int64()), pa.array(froms, pa.list_(pa.int32())), pa.array(tos, pa.list_(pa.int32()))], names=["key", "digest", "froms", "tos"])

    return rows.repartition("key").sortWithinPartitions("key", "digest").mapInArrow(run, MARK)


def marks(docs: DataFrame, found: DataFrame, unit: str, width: int, worker: Callable, block: int) -> DataFrame:
    """Ranges of repeated windows in each distinct candidate segment: MARK."""
    reps = found.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "start", "n")).alias("rep"), F.first("several").alias("several"), F.first("hot").alias("hot"))
    reps = reps.select("key", "digest", "copies", "several", "hot", "rep.rid", "rep.start", "rep.n")
    whole = reps.where("copies >= 2").select("key", "digest", F.array(F.lit(0)).alias("froms"), F.array("n").alias("tos"))
    need = reps.where("several or copies = 1")
    cold = by_key(pieces(docs, need.where("not hot"), unit, width, plain_rows, PIECE), worker, block)
    windows = pieces(docs, need.where("hot"), unit, width, window_rows(unit, width), "key long, digest long, at int, h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "digest", "at")).alias("one"), F.max(F.struct("key", "digest", "at")).alias("two")).where("c >= 2").select("h1", "h2")
    hot = windows.join(twice, ["h1", "h2"]).groupBy("key", "digest").agg(F.array_sort(F.collect_list("at")).alias("froms"))
    hot = hot.select("key", "digest", "froms", F.transform("froms", lambda x: x + 1).alias("tos"))
    return whole.unionByName(cold).unionByName(hot)


def spans(found: DataFrame, marked: DataFrame) -> DataFrame:
    """By rid: ranges of window starts that are repeated (not yet united)."""
    rows = found.select("key", "digest", "rid", "start").join(marked, ["key", "digest"])
    return rows.groupBy("rid").agg(F.collect_list(F.struct("start", "froms", "tos")).alias("spans"))


def removed(value: dict | None | list, width: int, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Units to remove as sorted maximal runs, from a document's spans."""
    if not value:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    froms = np.concatenate([np.asarray(x["froms"], np.int64) + x["start"] for x in value])
    tos = np.concatenate([np.asarray(x["tos"], np.int64) + x["start"] for x in value])
    return union(froms, tos + width - 1)


def applied(docs: DataFrame, found_spans: DataFrame, width: int, unit: str, finish: Callable, schema: str, columns: list[str], removed: Callable = removed) -> DataFrame:
    """finish(text bytes, removed starts, removed ends) -> tuple of the values that follow `columns` in schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, at = texts_of(batch.column("text"))
            value = batch.column("spans").to_pylist()
            out = [finish(text[at[i] : at[i + 1]], *removed(value[i], width, text[at[i] : at[i + 1]])) for i in range(batch.num_rows)]
            made = [pa.array(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, *(f"_{i}" for i in range(len(made)))])

    return docs.join(found_spans, "rid", "left").select(*[c for c in docs.columns if c != "rid"], "spans").mapInArrow(run, schema)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", shared.row_id())
