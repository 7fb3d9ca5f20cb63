"""Substring dedup on bytes with a two-stage suffix array (op6).

Suffixes of a block are of two types: smaller or larger than their successor. Only the smaller ones are sorted directly;
the larger ones are induced by one scan over the first-byte buckets. Adjacent entries of the array are then compared, and
windows of `width` bytes with an equal neighbour are repeated. Blocks hold whole keys (see repeats.py), so equal windows
are always in one block. Sorting stops at `width` bytes: suffixes equal that far may stand in any order.

The operator and the query also find repeated windows of words, by a suffix array of words over window starts only.

Defined results: null text counts as empty; texts shorter than `width` keep everything; repeated rows (even with equal
doc_id) count as separate documents, so both lose what they share; extra columns do not matter; an empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import repeats, shared
from relictum.llm.windows import union, word_spans

WIDTH, K = 400, 64
#: The pipeline's stage: also passages of so many words, whatever their bytes.
STAGE_WORDS, WORDS_K = 50, 8
#: Bytes of text in one suffix array.
BLOCK = 1_000_000


def in_order(text: bytes, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` bytes that follow: by the first 24 bytes at once, then what they leave equal. Places equal
    as far as that may stand in any order."""
    raw = np.frombuffer(text + bytes(24), np.uint8)
    words = np.ndarray((len(text) + 17,), ">u8", raw.data, strides=(1,))
    keys = [words[places + at].astype(np.uint64) for at in (16, 8, 0)]
    order = np.lexsort(keys)
    out = places[order]
    tie = np.ones(max(0, len(out) - 1), bool)
    for key in keys:
        own = key[order]
        tie &= own[1:] == own[:-1]
    if depth <= 24 or not tie.any():
        return out
    edge = np.flatnonzero(np.diff(np.concatenate([[False], tie, [False]]).astype(np.int8)))
    listed = out.tolist()
    for a, b in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist()):
        if b - a == 2:
            p, q = listed[a], listed[a + 1]
            if text[p + 24 : p + depth] > text[q + 24 : q + depth]:
                listed[a], listed[a + 1] = q, p
        else:
            listed[a:b] = sorted(listed[a:b], key=lambda p: text[p + 24 : p + depth])
    return np.array(listed, np.int64)


def two_stage(text: bytes, depth: int) -> np.ndarray:
    """Suffix array of text, in order of the first `depth` bytes at least."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is smaller than its successor if the first unequal byte rises; the last suffix is larger than the empty one.
    differs = np.flatnonzero(t[1:] != t[:-1])
    smaller = np.zeros(n, bool)
    if len(differs):
        nxt = np.searchsorted(differs, np.arange(differs[-1] + 1))
        smaller[: differs[-1] + 1] = (t[1:] > t[:-1])[differs[nxt]]
    direct = in_order(text, np.flatnonzero(smaller), depth)
    first = t[direct] if len(direct) else np.zeros(0, np.uint8)
    cut = np.searchsorted(first, np.arange(257))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        # Larger suffixes of this bucket come before the smaller ones; equal bytes before them induce within the bucket.
        front = np.concatenate(larger[c]) if larger[c] else np.zeros(0, np.int64)
        own = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[t[front] == c]
            own.append(front)
        bucket = np.concatenate([*own, direct[cut[c] : cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        ch = t[before]
        rises = ch > c
        before, ch = before[rises], ch[rises]
        order = np.argsort(ch, kind="stable")
        before, ch = before[order], ch[order]
        edge = np.flatnonzero(np.diff(ch)) + 1
        for part, letter in zip(np.split(before, edge), ch[np.concatenate([[0], edge])] if len(ch) else (), strict=False):
            larger[letter].append(part)
    return np.concatenate(out)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes a and b agree on `depth` bytes, pair by pair, 8 bytes at a time; pairs that differ drop out."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text) + 1,), np.uint64, padded.data, strides=(1,))
    same = np.zeros(len(a), bool)
    live = np.arange(len(a))
    for at in range(0, depth, 8):
        at = min(at, depth - 8)
        live = live[words[a[live] + at] == words[b[live] + at]]
    same[live] = True
    return same


def repeated_bytes(width: int):
    """A worker for repeats.by_key."""

    def work(texts: list[bytes], counts: list[int]) -> list[np.ndarray]:
        text = b"".join(texts)
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        window = np.zeros(len(text), bool)
        for s, n in zip(starts, counts, strict=True):
            window[s : s + n] = True
        array = two_stage(text, width)
        array = array[window[array]]  # windows only: what runs over a segment's end is no window
        same = common(np.frombuffer(text, np.uint8), array[:-1], array[1:], width)
        hit = np.zeros(len(text), bool)
        hit[array[:-1][same]] = True
        hit[array[1:][same]] = True
        return [hit[s : s + n] for s, n in zip(starts, counts, strict=True)]

    return work


def repeated_words(width: int):
    """A worker for repeats.by_key: a suffix array of words, sparse (window starts only), sorted by `width` words."""

    def work(texts: list[bytes], counts: list[int]) -> list[np.ndarray]:
        number: dict[bytes, int] = {}
        ids = [np.array([number.setdefault(w, len(number)) for w in x.split()], ">u4").tobytes() for x in texts]  # split at the bytes of word_spans
        text, depth = b"".join(ids), 4 * width
        starts = np.cumsum([0, *map(len, ids)])[:-1]
        places = np.concatenate([s + 4 * np.arange(n) for s, n in zip(starts, counts, strict=True)])
        array = in_order(text, places, depth)
        same = common(np.frombuffer(text, np.uint8), array[:-1], array[1:], depth)
        hit = np.zeros(len(text), bool)
        hit[array[:-1][same]] = True
        hit[array[1:][same]] = True
        return [hit[s : s + 4 * n : 4] for s, n in zip(starts, counts, strict=True)]

    return work


def find(docs: DataFrame, width: int = WIDTH, k: int = K, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """docs with a rid first, and the spans to remove by rid."""
    columns = docs.columns
    docs = repeats.keyed(docs).select("rid", *columns)
    return docs, units_found(docs, "byte", width, k, repeated_bytes(width), block)


def units_found(docs: DataFrame, unit: str, width: int, k: int, worker, block: int = BLOCK) -> DataFrame:
    """The spans to remove by rid: windows of `width` units that stand twice or more."""
    rows = shared.table(repeats.segment_rows(docs, unit, width, k), "segments")
    keys = shared.table(repeats.repeated_keys(rows), "keys")
    found = shared.table(repeats.candidates(rows, keys), "candidates")
    return repeats.spans(found, repeats.marks(docs, found, unit, width, worker, block))


def keep(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """What is left of a text."""
    mask = np.zeros(len(text) + 1, np.int32)
    np.add.at(mask, starts, 1)
    np.add.at(mask, ends, -1)
    return text[np.cumsum(mask[:-1]) == 0].tobytes()


def both_spans(by_byte: DataFrame, by_word: DataFrame) -> DataFrame:
    """Spans of bytes and of words together by rid; starts of words become negative."""
    tagged = F.transform("spans", lambda x: F.struct((-1 - x["start"]).alias("start"), x["froms"].alias("froms"), x["tos"].alias("tos")))
    both = by_byte.unionByName(by_word.select("rid", tagged.alias("spans")))
    return both.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def parted(value, width: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes, and of words, from the spans of both kinds."""
    value = value or []
    by_word = [{**x, "start": -1 - x["start"]} for x in value if x["start"] < 0]
    return *repeats.removed([x for x in value if x["start"] >= 0], width), *repeats.removed(by_word, words)


def both_removed(words: int):
    """repeats.removed for spans of both kinds. Bytes to remove as sorted maximal runs."""

    def removed(value, width: int, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, first, last = parted(value, width, words)
        if len(first):
            s, e = word_spans(text)
            starts, ends = union(np.concatenate([starts, s[first]]), np.concatenate([ends, e[last - 1]]))
        return starts, ends

    return removed


def dedup(docs: DataFrame, width: int = WIDTH, words: int = 0) -> DataFrame:
    """The operator: the same columns, with repeated bytes taken out of text. A cut may fall inside a character; the
    broken bytes of that character are dropped too. Texts without a repeat, null included, stay as they are.

    words: repeated windows of so many words, however short, go as well; both kinds are counted on the texts as they come."""
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("row_"))
    keyed, spans = find(packed, width)
    if words:
        spans = both_spans(spans, units_found(keyed, "word", words, WORDS_K, repeated_words(words)))

    def finish(text, starts, ends):
        return (keep(text, starts, ends).decode("utf-8", "ignore") if len(starts) else None,)

    kept = ["doc_id", "text", "row_"]
    schema = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in kept)
    removed = both_removed(words) if words else repeats.removed
    done = repeats.applied(keyed, spans, width, "byte", finish, f"{schema}, cut_ string", kept, removed)
    shown = {"doc_id": F.col("doc_id"), "text": F.coalesce("cut_", "text")} | {c: F.col(f"row_.c{i}") for i, c in enumerate(others)}
    return done.select(*[shown[c].alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's 400-byte strings, and beside them n_passage_words: words of each text in repeated windows of 50 words,
    which `dedup(words=50)` takes out too. Most passages of 51 to 65 words are shorter than 400 bytes."""
    docs = repeats.keyed(shared.read(spark, sf_dir, "documents").select("doc_id", "text")).select("rid", "doc_id", "text")
    by_byte = units_found(docs, "byte", WIDTH, K, repeated_bytes(WIDTH))
    by_word = units_found(docs, "word", STAGE_WORDS, WORDS_K, repeated_words(STAGE_WORDS))

    def finish(text, starts, ends, words):
        return len(text), int((ends - starts).sum()), len(starts), hashlib.sha256(keep(text, starts, ends) if len(starts) else text.tobytes()).hexdigest(), words

    def removed(value, width, text):
        starts, ends, first, last = parted(value, width, STAGE_WORDS)
        return starts, ends, int((last - first).sum())

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"
    return repeats.applied(docs, both_spans(by_byte, by_word), WIDTH, "byte", finish, schema, ["doc_id"], removed)
