"""Stages of the pipeline against plain Python, where the operators' own contracts do not cover them."""

import collections
import random
import re

import pytest

from relictum.llm import repeats, simhash, suffix

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def without_repeats(texts, words, width):
    """What is left when every window of `words` words or `width` bytes that stands twice is taken out."""
    raw = [(t or "").encode() for t in texts]
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)] for b in raw]
    by_word = collections.Counter(tuple(b[s:e] for s, e in x[p : p + words]) for b, x in zip(raw, spans) for p in range(len(x) - words + 1))
    by_byte = collections.Counter(b[p : p + width] for b in raw for p in range(len(b) - width + 1))
    out = []
    for t, b, x in zip(texts, raw, spans):
        gone = bytearray(len(b))
        for p in range(len(x) - words + 1):
            if by_word[tuple(b[s:e] for s, e in x[p : p + words])] > 1:
                gone[x[p][0] : x[p + words - 1][1]] = b"\1" * (x[p + words - 1][1] - x[p][0])
        for p in range(len(b) - width + 1):
            if by_byte[b[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        out.append(bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else t)
    return out


@pytest.mark.parametrize("hot", [1000, 1])
def test_passages_of_over_50_words_go(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = random.Random(3)
    fresh = lambda n, k=6: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, k))) for _ in range(n))
    one, two, short, letters, long = fresh(51), fresh(60), fresh(49), fresh(51, 1), "z" * 500
    assert len(one) < 400 and len(two) < 400 and len(letters) < 110
    texts = [fresh(80) + " " + p + " " + fresh(70) for p in (one, one, two, two.replace(" ", "\n"), short, short, letters, letters)]
    texts += [fresh(20) + long, long + fresh(20), None, "", "é " * 300, one, fresh(9) + " " + two + " é" + fresh(200)]
    got = dict(suffix.dedup(frame(spark, texts), words=suffix.STAGE_WORDS).select("doc_id", "text").collect())
    assert got == dict(enumerate(without_repeats(texts, 50, 400)))
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, frame(spark, texts), "").collect()}
    assert one not in left[0] and one not in left[1] and 13 not in left and short in left[4] and letters not in left[6] and left[10] is None


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def planted(rng, n):
    """Isolated pairs of similarity from 0.7 to 0.95, by runs of words replaced at the end."""
    out = []
    for _ in range(n):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 300))]
        k = round((len(own) - 4) * (1 - (2 * (j := rng.uniform(0.7, 0.95)) / (1 + j))))
        out.append((" ".join(own), " ".join(own[: len(own) - k] + [f"v{rng.randrange(10**6)}" for _ in range(k)])))
    return out


def test_near_copies_are_those_of_exact_similarity(spark):
    rng = random.Random(11)
    texts = [t for pair in planted(rng, 600) for t in pair]
    head = "menu " * 400
    texts += [head + " ".join(f"x{i}{k}" for k in range(40)) for i in range(3)]  # one repeated word, otherwise different
    similarity = lambda a, b: len(a & b) / len(a | b)
    pairs = [similarity(shingles(a), shingles(b)) for a, b in zip(texts[0:1200:2], texts[1:1200:2])]
    left = {r.doc_id for r in simhash.dedup(frame(spark, texts)).collect()}
    assert left >= set(range(0, 1200, 2)) | {1200, 1201, 1202}
    gone = [2 * i + 1 not in left for i in range(600)]
    assert not any(g for g, j in zip(gone, pairs) if j < 0.8)
    near = [g for g, j in zip(gone, pairs) if 0.8 <= j <= 0.9]
    assert len(near) > 150 and sum(near) > 0.98 * len(near) and all(g for g, j in zip(gone, pairs) if j > 0.9)
