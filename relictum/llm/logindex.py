"""Substring dedup on words with a log-structured fingerprint index (op8).

The index is a folder of immutable runs and a manifest that lists them. A run is what one batch added: its segments' fingerprints,
sorted by key, and their totals by key, in buckets of the key. `add` writes a batch as a run and merge-joins its totals with
those of the runs before it, bucket by bucket, without a shuffle; what they share, or the batch repeats, is a candidate key.
Candidates come from these joins alone. Whenever FANOUT runs of one level stand, they are merged into one of the next level and
deleted, so that a batch meets few runs. An index can be opened again by its path, by another session too, and fed with batches
as they come; the query feeds the corpus in BATCHES batches and then cleans all of it.

Segments of candidate keys are verified on their words, window by window. Two things rest on hashes: copies of a whole segment
are known by two 64-bit hashes of their words, and windows of a key with more than HOT segments by two others.

Defined results: null or blank text has no words; words are compared unchanged, as bytes; documents of fewer than `width`
words keep everything; repeated rows (even with equal doc_id) count as separate documents; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import repeats, shared
from relictum.llm.windows import grams, prefix, word_codes, word_spans

WIDTH, K, BATCHES = 35, 8, 2
#: Runs of one level that are merged into one.
FANOUT = 4
#: Bytes of text verified at once.
BLOCK = 2_000_000
#: A key with more segments than this is dealt by window instead of by key. Verifying is cheap, so a task can hold more than
#: a suffix array's could: about 20,000 times 60 words, 8 MB of text.
HOT = 20_000

TOTALS = "key long, weight long, copies long, low long, high long"


@dataclass(frozen=True)
class Run:
    level: int
    rows: str
    totals: str
    buckets: int


class FingerprintIndex:
    """Runs of segments, and the keys known to repeat, in a folder. Without a path, a new index in the shared folder."""

    def __init__(self, spark: SparkSession, width: int = WIDTH, k: int = K, path: str | None = None):
        self.spark, self.width, self.k = spark, width, k
        self.path = path or shared.path(spark, "index")
        self.version, self.runs, self.known = 0, [], []
        files, pattern = shared.place(spark, f"{self.path}/manifest-*/_SUCCESS")
        found = sorted(str(x.getPath().getParent()) for x in files.globStatus(pattern) or [])
        if found:
            state = json.loads(spark.read.text(found[-1]).first().value)
            if (state["width"], state["k"]) != (width, k):
                raise ValueError("the index was made with another width or key length")
            self.version, self.runs, self.known = state["version"], [Run(**r) for r in state["runs"]], state["known"]

    def save(self) -> None:
        """The next manifest. The one before stays until this one is complete, so a lost driver leaves a whole index."""
        self.version += 1
        state = {"width": self.width, "k": self.k, "version": self.version, "runs": [asdict(r) for r in self.runs], "known": self.known}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version:08d}")
        if self.version > 1:
            shared.remove(self.spark, f"{self.path}/manifest-{self.version - 1:08d}")

    def totals(self, run: Run) -> DataFrame:
        """A run's totals as a table in buckets; its name in the catalog is that of its folder."""
        name = run.totals.rsplit("/", 1)[-1]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"create table {name} ({TOTALS.replace(' long', ' bigint')}) using parquet options (path '{run.totals}') clustered by (key) sorted by (key) into {run.buckets} buckets")
        return self.spark.table(name)

    def write(self, rows: DataFrame, level: int, totals: DataFrame | None = None) -> Run:
        """rows(SEGMENT) as a run. totals: of all keys, if known already."""
        at = f"{self.path}/rows-{uuid.uuid4().hex}"
        rows.repartition("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(at)
        own = totals if totals is not None else summed(self.segments(at))
        name, buckets = f"relictum_totals_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own.repartition(buckets, "key").write.option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        return Run(level, at, f"{self.path}/{name}", buckets)

    def segments(self, at: str) -> DataFrame:
        return self.spark.read.schema(repeats.SEGMENT).parquet(at)

    def add(self, batch: DataFrame) -> DataFrame:
        """batch(rid, text) becomes a run. Returns the keys of the batch that stand in an older run too, or twice in the batch."""
        run = self.write(repeats.segment_rows(batch, "word", self.width, self.k), 0)
        own, there = self.totals(run).select("key", "weight"), F.col("weight") >= 2
        for i, old in enumerate(self.runs):
            own = own.join(self.totals(old).select("key", F.lit(True).alias(f"old{i}")), "key", "left")
            there = there | F.coalesce(f"old{i}", F.lit(False))
        at = f"{self.path}/known-{uuid.uuid4().hex}"
        own.where(there).select("key").write.option("compression", "zstd").parquet(at)
        self.runs.append(run)
        self.known.append(at)
        self.save()
        while group := next((g for g in ([r for r in self.runs if r.level == n] for n in {r.level for r in self.runs}) if len(g) >= FANOUT), None):
            self.merge(group)
        return self.keys_at(at)

    def keys_at(self, at: str) -> DataFrame:
        return self.spark.read.schema("key long").parquet(at)

    def compact(self) -> None:
        """All runs become one."""
        if len(self.runs) > 1:
            self.merge(self.runs)

    def merge(self, group: list[Run]) -> None:
        """The runs of the group become one, sorted; their files are deleted once the manifest no longer lists them."""
        rows = reduce(DataFrame.unionByName, [self.segments(r.rows) for r in group])
        made = self.write(rows, 1 + max(r.level for r in group), joined([self.totals(r) for r in group]))
        self.runs = [r for r in self.runs if r not in group] + [made]
        self.save()
        for r in group:
            self.spark.sql(f"drop table if exists {r.totals.rsplit('/', 1)[-1]}")
            shared.remove(self.spark, r.rows)
            shared.remove(self.spark, r.totals)

    def candidates(self) -> DataFrame:
        """Segments of all runs whose key repeats, with what is known of the key."""
        rows = reduce(DataFrame.unionByName, [self.segments(r.rows) for r in self.runs])
        return shared.table(repeats.candidates(rows, self.keys()), "candidates")

    def keys(self) -> DataFrame:
        """What the joins found, with the totals of those keys."""
        known = reduce(DataFrame.unionByName, map(self.keys_at, self.known)).distinct()
        sums = joined([self.totals(r).join(known, "key", "left_semi") for r in self.runs])
        return shared.table(sums.select("key", (F.col("low") != F.col("high")).alias("several"), (F.col("copies") > HOT).alias("hot")), "keys")


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("copies"), F.min("digest").alias("low"), F.max("digest").alias("high"))


def joined(parts: list[DataFrame]) -> DataFrame:
    """Totals of several runs by key, by merge joins of their buckets. (Not a union and an aggregation: Spark 4.1 takes the union of
    bucketed scans for grouped by key, then reads them without their buckets.)"""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.select("key", *[F.col(c).alias(f"{c}_") for c in ("weight", "copies", "low", "high")]), "key", "full")
        sums = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in ("weight", "copies")]
        return both.select("key", *sums, F.least("low", "low_").alias("low"), F.greatest("high", "high_").alias("high"))

    return reduce(two, parts)


def repeated_words(width: int):
    """A worker for repeats.by_key: sorts window hashes, then verifies equal ones on the words."""

    def work(texts: list[bytes], counts: list[int]) -> list[np.ndarray]:
        hashes, where, ends, at = [], [], [], 0
        for text, n in zip(texts, counts, strict=True):
            raw = np.frombuffer(text, np.uint8)
            s, e = word_spans(raw)
            hashes.append(grams(prefix(word_codes(raw, s, e)), width)[:n])
            where.append(s[:n] + at)
            ends.append(e[width - 1 : width - 1 + n] + at)
            at += len(text)
        every, start, end = map(np.concatenate, (hashes, where, ends))
        order = np.argsort(every, kind="stable")
        one, two = order[:-1], order[1:]
        pair = np.flatnonzero((every[one] == every[two]) & (end[one] - start[one] == end[two] - start[two]))
        whole = b"".join(texts)
        same = np.fromiter((whole[start[one[p]] : end[one[p]]] == whole[start[two[p]] : end[two[p]]] for p in pair), bool, len(pair))
        hit = np.zeros(len(every), bool)
        hit[one[pair[same]]] = True
        hit[two[pair[same]]] = True
        return np.split(hit, np.cumsum(counts)[:-1])

    return work


def find(docs: DataFrame, width: int = WIDTH, k: int = K, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """docs with a rid first, and the spans of words to remove by rid."""
    columns = docs.columns
    docs = repeats.keyed(docs).select("rid", *columns)
    narrow = docs.select("rid", "text")
    index = FingerprintIndex(docs.sparkSession, width, k)
    for i in range(batches):
        index.add(narrow.where(F.pmod("rid", F.lit(batches)) == i))
    index.compact()
    found = index.candidates()
    return docs, repeats.spans(found, repeats.marks(docs, found, "word", width, repeated_words(width), BLOCK))


def kept_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, bytes]:
    """Number of words, and the words left, joined by one space."""
    s, e = word_spans(text)
    raw = text.tobytes()
    edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(s)]
    out = []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if a < b:
            out.append(b" ".join(raw[s[a] : e[b - 1]].split()))  # bytes split at the same six bytes
    return len(s), b" ".join(out)


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The operator: text becomes its kept words joined by one space where something was removed, else it stays."""
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row_"))
    keyed, spans = find(packed, width)

    def finish(text, starts, ends):
        return (kept_words(text, starts, ends)[1].decode() if len(starts) else None,)

    kept = ["doc_id", "text", "row_"]
    schema = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in kept)
    done = repeats.applied(keyed, spans, width, "word", finish, f"{schema}, cut_ string", kept)
    shown = {"doc_id": F.col("doc_id"), "text": F.coalesce("cut_", "text")} | {c: F.col(f"row_.c{i}") for i, c in enumerate(others)}
    return done.select(*[shown[c].alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = find(shared.read(spark, sf_dir, "documents").select("doc_id", "text"))

    def finish(text, starts, ends):
        n, left = kept_words(text, starts, ends)
        return n, int((ends - starts).sum()), hashlib.sha256(left).hexdigest()

    return repeats.applied(docs, spans, WIDTH, "word", finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", ["doc_id"])
