"""Log-bilinear language model trained by noise-contrastive estimation, for scoring documents (op4).

Token counts cover all training documents. Every token of LEAST occurrences or more is a word of the model, so the vocabulary
grows with the corpus (to WORDS, a bound on memory). The commonest words are classes of their own, the others stand by frequency
in groups of GROUP, each of which is a class, and all rarer tokens share one. A word's probability is that of its class times its
share within the class: under the model for words of a group, under the counts for rarer tokens, so that probabilities are
normalised over all known tokens and one unknown. Both factors are log-bilinear: the sum of position-weighted vectors of the
tokens before predicts the next one's vector, and scores are dot products. The class factor sees the CONTEXT classes before (groups
and rarer tokens as one), the word factor the REACH words before.

Training: every partition passes once over all its training tokens from common starting values, in numpy, with noise drawn from
the counts and shared by a minibatch; the partitions' parameters are averaged by their token numbers. Scoring: batched matrix
products, a softmax over all classes once for each distinct context of a block, and one over its group for each word of a group.

Counts: words are counted by a 64-bit hash. Those of the COMMON commonest words travel to every task (a bound on memory);
each document's other words are joined with the counts.

Defined results: null or blank text is the end token alone; a null doc_id trains; repeated rows count each time and give a
row each; other columns are ignored; without training documents score and base agree; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import shared
from relictum.llm.windows import texts_of, word_codes, word_spans

FOLDS, HELD = 7, 2
#: Single words among the classes, vector length, context, noise samples and rows of a minibatch, learning rate.
CLASSES, DIM, CONTEXT, NOISE, ROWS, RATE = 256, 16, 3, 32, 1024, 0.1
#: Of the word factor: least count of a word, most words, words of a group, words before, rows of a minibatch, learning rate.
LEAST, WORDS, GROUP, REACH, WORD_ROWS, WORD_RATE = 12, 65_536, 128, 5, 256, 0.15
#: Words whose counts every task holds; bytes of text handled at once.
COMMON, BLOCK = 400_000, 4_000_000
#: The end token's code. Words hash to it with a chance of 2**-64.
END = np.uint64(0)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def blocks(batch_text) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, codes of the tokens, tokens of each row with its end) for rows of about BLOCK bytes."""
    text, at = texts_of(batch_text)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + BLOCK, "right")) - 1)
        own = LOWERED[text[at[low] : at[high]]]
        edges = at[low : high + 1] - at[low]
        # A line feed between documents keeps their words apart.
        shift = np.arange(high - low)
        padded = np.full(len(own) + high - low, 10, np.uint8)
        padded[np.arange(len(own)) + np.repeat(shift, np.diff(edges))] = own
        starts, ends = word_spans(padded)
        codes = word_codes(padded, starts, ends)
        per_doc = np.diff(np.searchsorted(starts, edges + np.arange(high - low + 1)))
        # Put the end token behind each document.
        tokens = np.insert(codes, np.cumsum(per_doc), END)
        yield low, high, tokens, per_doc + 1
        low = high


def counted(docs: DataFrame) -> DataFrame:
    """docs(text) -> code, c over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, tokens, _ in blocks(batch.column(0)):
                code, c = np.unique(tokens, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(c)], names=["code", "c"])

    return docs.select("text").mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Counts of common tokens, the classes, and the words of the groups.

    Of a token: cls, its class (0: rarer tokens); near, its class as a context (0: groups too); word, its number as a word (0: none).
    Words of group g are those of numbers first[g] to first[g + 1]; the group's class is `singles` + g."""

    def __init__(self, code: np.ndarray, c: np.ndarray, total: int, distinct: int, classes: int = CLASSES, words: int = WORDS, least: int = LEAST):
        order = np.argsort(code)
        self.code, self.c = code[order], c[order]
        self.total, self.distinct = total, distinct
        ranked = np.lexsort((self.code, -self.c))
        top = ranked[: classes - 1]
        rest = ranked[classes - 1 : max(words, classes - 1)]
        rest = rest[self.c[rest] >= least]
        self.singles = len(top) + 1
        self.cls, self.near, self.word = (np.zeros(len(code), np.int32) for _ in range(3))
        self.cls[top] = self.near[top] = np.arange(1, len(top) + 1)
        self.cls[rest] = self.singles + np.arange(len(rest)) // GROUP
        ranked = np.concatenate([top, rest])
        self.word[ranked] = np.arange(1, len(ranked) + 1)
        self.words = len(ranked) + 1
        self.first = np.append(np.arange(self.singles, self.words, GROUP), self.words)
        weight = (self.c[ranked] + 1) / (total + distinct + 1)
        grouped = np.add.reduceat(weight[len(top) :], np.arange(0, len(rest), GROUP)) if len(rest) else np.zeros(0)
        share = np.concatenate([weight[: len(top)], grouped])
        self.share = np.concatenate([[max(1e-12, 1 - share.sum())], share])
        self.n = len(self.share)
        # Each word's share of its group.
        self.within = np.ones(self.words)
        self.within[self.singles :] = weight[len(top) :] / np.repeat(grouped, np.diff(self.first))

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cls, near, word and count of each token (count -1: not a common one), looked up once for each distinct token, and its number."""
        uniq, back = np.unique(tokens, return_inverse=True)
        if not len(self.code):
            none = np.zeros(len(tokens), np.int32)
            return none, none, none, np.full(len(tokens), -1), back
        at = np.minimum(np.searchsorted(self.code, uniq), len(self.code) - 1)
        there = self.code[at] == uniq
        return *(np.where(there, x[at], 0).astype(np.int32)[back] for x in (self.cls, self.near, self.word)), np.where(there, self.c[at], -1)[back], back


def contexts(cls: np.ndarray, lengths: np.ndarray, n: int, reach: int = CONTEXT) -> np.ndarray:
    """(tokens, reach) classes or words before each token, nearest first; n stands before a document's start."""
    within = np.arange(len(cls)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(cls), reach), n, np.int64)
    for j in range(reach):
        out[j + 1 :, j] = cls[: len(cls) - j - 1]
        out[within <= j, j] = n
    return out


def start(vocabulary: Vocabulary) -> list[np.ndarray]:
    """Starting values of the class factor (context vectors, position weights, target vectors, biases: log shares of the classes),
    then of the word factor (the same; biases: log shares within the group)."""
    rng = np.random.default_rng(11)
    n, words = vocabulary.n, vocabulary.words
    return [
        rng.normal(0, 0.1, (n + 1, DIM)).astype(np.float32),
        np.full((CONTEXT, DIM), 1 / CONTEXT, np.float32),
        rng.normal(0, 0.1, (n, DIM)).astype(np.float32),
        np.log(vocabulary.share).astype(np.float32),
        rng.normal(0, 0.1, (words + 1, DIM)).astype(np.float32),
        np.full((REACH, DIM), 1 / REACH, np.float32),
        rng.normal(0, 0.1, (words, DIM)).astype(np.float32),
        np.log(vocabulary.within).astype(np.float32),
    ]


def flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def unflat(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    cuts = np.cumsum([p.size for p in like])[:-1]
    return [v.reshape(p.shape).astype(np.float32) for v, p in zip(np.split(values, cuts), like, strict=True)]


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The rows of each number from 0 to n - 1, added up."""
    return np.stack([np.bincount(at, rows[:, d], n) for d in range(DIM)], 1).astype(np.float32)


class Trainer:
    """Adagrad on the noise-contrastive loss of weighted (context, target) rows, for the class factor."""

    def __init__(self, parts: list[np.ndarray], share: np.ndarray, seed: int):
        self.parts = [p.copy() for p in parts[:4]]
        self.past = [np.full(p.shape, 1e-7, np.float32) for p in self.parts]
        self.rng = np.random.default_rng(seed)
        self.sum = np.cumsum(share) / share.sum()
        self.noise = np.log(NOISE * share / share.sum()).astype(np.float32)

    def step(self, context: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        vectors, place, out, bias = self.parts
        own = vectors[context]  # (rows, CONTEXT, DIM)
        guess = (own * place).sum(1)
        drawn = np.minimum(np.searchsorted(self.sum, self.rng.random(NOISE)), len(bias) - 1)
        noise = out[drawn]
        s = np.einsum("rd,rd->r", guess, out[target]) + bias[target] - self.noise[target]
        z = guess @ noise.T + (bias[drawn] - self.noise[drawn])
        w = (weight / weight.sum()).astype(np.float32)
        gs = (1 / (1 + np.exp(-s)) - 1) * w
        gz = (1 / (1 + np.exp(-z))) * w[:, None]
        g_guess = gs[:, None] * out[target] + gz @ noise
        both = np.concatenate([target, drawn])
        g_out = summed(both, np.concatenate([gs[:, None] * guess, gz.T @ guess]), len(out))
        g_bias = np.bincount(both, np.concatenate([gs, gz.sum(0)]), len(bias)).astype(np.float32)
        g_vectors = summed(context.ravel(), (g_guess[:, None, :] * place).reshape(-1, DIM), len(vectors))
        g_place = np.einsum("rjd,rd->jd", own, g_guess)
        for p, past, g in zip(self.parts, self.past, (g_vectors, g_place, g_out, g_bias), strict=True):
            past += g * g
            p -= RATE * g / np.sqrt(past)

    def learn(self, cls: np.ndarray, lengths: np.ndarray, n: int, near: np.ndarray | None = None) -> None:
        """All tokens of a block; equal (context, target) rows are one row with their number as weight. near: the classes as
        contexts, if they differ."""
        code = contexts(cls if near is None else near, lengths, n) @ ((n + 1) ** np.arange(CONTEXT)) * n + cls
        code, weight = np.unique(code, return_counts=True)
        order = self.rng.permutation(len(code))
        code, weight = code[order], weight[order]
        for at in range(0, len(code), ROWS):
            own = code[at : at + ROWS]
            target, left = own % n, own // n
            context = np.stack([left // (n + 1) ** j % (n + 1) for j in range(CONTEXT)], 1)
            self.step(context, target, weight[at : at + ROWS])


class WordTrainer:
    """Adagrad on the noise-contrastive loss of the words of each group, by minibatches of one group. The noise of a minibatch is
    drawn from the group's shares and shared by its rows. Context vectors move once for a round of minibatches, one of each group."""

    def __init__(self, parts: list[np.ndarray], vocabulary: Vocabulary, seed: int):
        self.parts = [p.copy() for p in parts]
        self.past = [np.full(p.shape, 1e-7, np.float32) for p in parts]
        self.vocabulary, self.rng = vocabulary, np.random.default_rng(seed)
        # Shares of all groups in one line, each of length 1.
        within = vocabulary.within[vocabulary.singles :]
        group = np.arange(len(within)) // GROUP
        total = np.cumsum(within)
        self.sum = group + np.minimum(total - np.concatenate([[0], total])[group * GROUP], 1)
        self.noise = np.log(NOISE * vocabulary.within).astype(np.float32)

    def learn(self, word: np.ndarray, cls: np.ndarray, lengths: np.ndarray) -> None:
        v = self.vocabulary
        every = np.flatnonzero(cls >= v.singles)
        every = every[self.rng.permutation(len(every))]
        every = every[np.argsort(cls[every], kind="stable")]
        group = cls[every] - v.singles
        place = np.arange(len(every)) - np.searchsorted(group, group)
        rounds = np.argsort(place // WORD_ROWS, kind="stable")
        every, group, turn = every[rounds], group[rounds], (place // WORD_ROWS)[rounds]
        before = contexts(word, lengths, v.words, REACH)
        edges = np.flatnonzero(np.diff(turn, prepend=-1, append=turn[-1] + 1 if len(turn) else 0))
        for low, high in zip(edges, edges[1:]):
            self.round(before[every[low:high]], word[every[low:high]], group[low:high])

    def round(self, context: np.ndarray, target: np.ndarray, group: np.ndarray) -> None:
        vectors, place, out, bias = self.parts
        own = vectors[context]  # (rows, REACH, DIM)
        guess = np.einsum("rjd,jd->rd", own, place)
        back = np.empty_like(guess)
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        drawn = np.searchsorted(self.sum, group[edges[:-1], None] + self.rng.random((len(edges) - 1, NOISE)))
        drawn = np.minimum(drawn + self.vocabulary.singles, self.vocabulary.first[group[edges[:-1]] + 1][:, None] - 1)
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            g, t, d = guess[low:high], target[low:high], drawn[i]
            own_out, noise = out[t], out[d]
            up = 1 / (1 + np.exp(np.einsum("rd,rd->r", g, own_out) + (bias[t] - self.noise[t])))
            down = 1 / (1 + np.exp(self.noise[d] - bias[d] - g @ noise.T))
            up, down = up / np.float32(high - low), down / np.float32(high - low)
            back[low:high] = up[:, None] * own_out - down @ noise
            # Equal words of the minibatch move together.
            a, b = self.vocabulary.first[group[low]], self.vocabulary.first[group[low] + 1]
            mine = np.zeros((b - a, high - low), np.float32)
            mine[t - a, np.arange(high - low)] = up
            some = mine @ g
            np.subtract.at(some, d - a, down.T @ g)
            both = np.bincount(t - a, up, b - a)
            both -= np.bincount(d - a, down.sum(0), b - a)
            self.move(2, slice(a, b), some)
            self.move(3, slice(a, b), both.astype(np.float32))
        # Each row's pull counts alike, whatever the size of its minibatch.
        flat = context.ravel()
        size = np.bincount(flat, minlength=len(vectors))
        used = np.flatnonzero(size)
        spread = (back[:, None, :] * place).reshape(-1, DIM)
        number = np.empty(len(vectors), np.int64)
        number[used] = np.arange(len(used))
        number = number[flat]
        self.move(0, used, summed(number, spread, len(used)))
        self.move(1, slice(None), np.einsum("rjd,rd->jd", own, back) / len(edges))

    def move(self, which: int, at, gradient: np.ndarray) -> None:
        self.past[which][at] += gradient * gradient
        self.parts[which][at] += WORD_RATE * gradient / np.sqrt(self.past[which][at])


#: Parameters that travel as one row, and the shares of partitions that are averaged first.
CHUNK, FAN = 1 << 15, 64


def trained(docs: DataFrame, vocabulary, parts: list[np.ndarray]) -> list[np.ndarray]:
    """The partitions' parameters, averaged chunk by chunk. Only the averages come to the driver."""
    first = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        seed, seen = TaskContext.get().partitionId(), 0
        trainer, second = Trainer(first.value, words.share, seed), WordTrainer(first.value[4:], words, seed)
        for batch in batches:
            for _, _, tokens, lengths in blocks(batch.column(0)):
                cls, near, word, _, _ = words.find(tokens)
                trainer.learn(cls, lengths, words.n, near)
                second.learn(word, cls, lengths)
                seen += len(tokens)
        if seen:
            values = flat(trainer.parts + second.parts)
            cut = range(0, len(values), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array([seed % FAN] * len(cut), pa.int32()), pa.array([values[at : at + CHUNK].astype("<f4").tobytes() for at in cut]), pa.array([seen] * len(cut), pa.int64())], names=["i", "s", "v", "w"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for i, _, v, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(v, "<f4") * np.float64(w)
                held = sums.setdefault(i, [np.zeros(len(own)), 0])
                held[0] += own
                held[1] += w
        if sums:
            weight = [w for _, w in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([(v / w).astype("<f4").tobytes() for v, w in sums.values()]), pa.array(weight, pa.int64())], names=["i", "s", "v", "w"])

    # Means of means by weight: first within each of FAN shares of the partitions, so that no task reads them all.
    schema = "i int, s int, v binary, w long"
    rows = docs.select("text").mapInArrow(run, schema).repartition("i", "s").mapInArrow(mean, schema).repartition("i").mapInArrow(mean, schema).select("i", "v").collect()
    if not rows:
        return parts
    return unflat(np.concatenate([np.frombuffer(r.v, "<f4") for r in sorted(rows)]), parts)


def log_shares(context: np.ndarray, parts: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Predicted vectors and log normalisers of distinct contexts (codes); n: what stands before a document's start."""
    vectors, place, out, bias = parts
    guess, norm = np.empty((len(context), DIM), np.float32), np.empty(len(context), np.float32)
    for at in range(0, len(context), 4096):
        own = np.stack([context[at : at + 4096] // (n + 1) ** j % (n + 1) for j in range(CONTEXT)], 1)
        g = (vectors[own] * place).sum(1)
        s = g @ out.T + bias
        top = s.max(1)
        guess[at : at + 4096], norm[at : at + 4096] = g, top + np.log(np.exp(s - top[:, None]).sum(1))
    return guess, norm


def within_shares(word: np.ndarray, cls: np.ndarray, lengths: np.ndarray, parts: list[np.ndarray], vocabulary: Vocabulary) -> np.ndarray:
    """log of each token's share of its group under the model; 0 for tokens of no group."""
    vectors, place, out, bias = parts
    gain = np.zeros(len(word), np.float32)
    every = np.flatnonzero(cls >= vocabulary.singles)
    every = every[np.argsort(cls[every], kind="stable")]
    group = cls[every] - vocabulary.singles
    guess = 0
    for j, before in enumerate(contexts(word, lengths, vocabulary.words, REACH).T):
        guess += (vectors * place[j]).take(before[every], axis=0)
    edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for low, high in zip(edges, edges[1:]):
        a, b = vocabulary.first[group[low]], vocabulary.first[group[low] + 1]
        for at in range(low, high, 8192):
            rows = every[at : min(high, at + 8192)]
            s = guess[at : at + len(rows)] @ out[a:b].T
            s += bias[a:b]
            np.minimum(s, 80, out=s)
            own = s[np.arange(len(rows)), word[rows] - a]
            gain[rows] = own - np.log(np.exp(s, out=s) @ np.ones(b - a, np.float32))
    return gain


def scored(docs: DataFrame, vocabulary, model) -> DataFrame:
    """docs(doc_id, text) -> id_, doc_id, n_tokens, n_known and logs over common tokens, model's gain, and the other tokens."""
    schema = "id_ long, doc_id long, n_tokens long, known long, logs double, gain double, code array<long>, tf array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = vocabulary.value, model.value
        n, made = words.n, TaskContext.get().partitionId() << 33
        base, inner = np.log(words.share), np.log(words.within)
        for batch in batches:
            for low, high, tokens, lengths in blocks(batch.column(1)):
                cls, near, word, c, back = words.find(tokens)
                context, where = np.unique(contexts(near, lengths, n) @ ((n + 1) ** np.arange(CONTEXT)), return_inverse=True)
                guess, norm = log_shares(context, parts[:4], n)
                gain = np.empty(len(cls))
                for at in range(0, len(cls), 1 << 16):
                    one, w = cls[at : at + (1 << 16)], where[at : at + (1 << 16)]
                    gain[at : at + (1 << 16)] = np.einsum("rd,rd->r", guess[w], parts[2][one]) + parts[3][one] - norm[w] - base[one]
                gain += within_shares(word, cls, lengths, parts[4:], words) - np.where(cls >= words.singles, inner[word], 0)
                first = np.cumsum(lengths) - lengths
                doc = np.repeat(np.arange(len(lengths)), lengths)
                other = np.flatnonzero(c < 0)
                pair, tf = np.unique(doc[other] * (int(back.max(initial=0)) + 1) + back[other], return_counts=True)
                size = int(back.max(initial=0)) + 1
                code = np.zeros(size, np.uint64)
                code[back] = tokens
                cuts = np.searchsorted(pair // size, np.arange(len(lengths) + 1)).astype(np.int32)
                m = high - low
                arrays = [
                    pa.array(np.arange(made, made + m)),
                    batch.column(0).slice(low, m),
                    pa.array(lengths.astype(np.int64)),
                    pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                    pa.array(np.add.reduceat(np.log10(np.maximum(c, 0) + 1.0), first)),
                    pa.array(np.add.reduceat(gain, first) / math.log(10)),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(code[pair % size].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(tf.astype(np.int32))),
                ]
                made += m
                yield pa.RecordBatch.from_arrays(arrays, names=["id_", "doc_id", "n_tokens", "known", "logs", "gain", "code", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class LanguageModel:
    """Counts, vocabulary and parameters, fitted on docs(text)."""

    def __init__(self, docs: DataFrame, common: int = COMMON, classes: int = CLASSES):
        spark = docs.sparkSession
        self.counts = shared.table(counted(docs), "counts")
        total, self.distinct = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.total = int(total)
        # The lowest count that at most `common` tokens reach, from a histogram over quarter powers of two.
        bins = self.counts.groupBy(F.floor(F.log2("c") * 4).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("b")).collect()
        least, seen = None, 0
        for b, n in bins:
            seen += n
            if seen > common:
                break
            least = b
        rows = self.counts.where(F.floor(F.log2("c") * 4) >= least).toArrow() if least is not None else pa.table({"code": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
        vocabulary = Vocabulary(rows["code"].to_numpy().view(np.uint64), rows["c"].to_numpy(), self.total, self.distinct, classes)
        self.vocabulary = spark.sparkContext.broadcast(vocabulary)
        self.parts = trained(docs, self.vocabulary, start(vocabulary))
        self.model = spark.sparkContext.broadcast(self.parts)

    def score(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text) -> doc_id, n_tokens, n_known, base_score, score."""
        rows = shared.table(scored(docs, self.vocabulary, self.model), "scored")
        others = rows.select("id_", F.explode(F.arrays_zip("code", "tf")).alias("x")).select("id_", "x.code", "x.tf")
        joined = others.join(self.counts, "code").groupBy("id_").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more_logs"))
        all_rows = rows.drop("code", "tf").join(joined, "id_", "left")
        base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(self.total + self.distinct + 1))
        return all_rows.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = LanguageModel(docs.where(~held_out(F.col("doc_id"))))
    rows = model.score(docs)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
