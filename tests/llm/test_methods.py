"""The operators' methods against brute force: clusters of near copies, densities, the model's probabilities, the index over
sessions, words of repeated passages, and the whole pipeline."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from relictum.llm import coder, html, lbl, logindex, packing, quality, repeats, simhash, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def fresh(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def shingles(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(texts):
    """Smallest number of each text's class, by all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def edited(rng, base, edits):
    out = base.split()
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"v{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("rows", [512, 16])
def test_a_large_group_of_near_copies(spark, monkeypatch, rows):
    """Copies of one text that are near to it, but mostly not to each other."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    rng = random.Random(5)
    base = fresh(rng, 150)
    texts = [base] + [edited(rng, base, rng.randint(1, 9)) for _ in range(240)] + [fresh(rng, 150) for _ in range(20)] + [base, base.upper(), None, "", " \n"]
    texts.remove(base)  # the centre comes once less
    want = classes(texts)
    left = sorted(r.doc_id for r in simhash.dedup(frame(spark, texts)).collect())
    assert left == sorted(set(want)) and 40 < len(left) < 200


def test_links_of_blocks():
    rng = random.Random(6)
    base = fresh(rng, 60)
    texts = [edited(rng, base, rng.randint(0, 4)) for _ in range(40)]
    sets = [np.unique(simhash.hashes(t, 5)) for t in texts]
    prints = np.stack([simhash.majority(s, 4) for s in sets])
    sizes, values = np.array([len(s) for s in sets]), np.concatenate(sets).view(np.int64)
    for side in (np.zeros(40, int), np.arange(40) % 2):
        a, b = simhash.meeting(side, np.arange(40), prints, sizes, values, 256)
        got = simhash.unite(np.arange(40), a, b)
        near = [(i, j) for i, j in itertools.combinations(range(40), 2) if (side[i] != side[j] or side.max() == 0) and 9 * len(set(sets[i]) & set(sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))]
        want = simhash.unite(np.arange(40), np.array([i for i, _ in near]), np.array([j for _, j in near]))
        assert got.tolist() == want.tolist() and len(a) == 40 - len(set(want.tolist()))


def test_pivots_spare_searches_but_no_links():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, (3, 4), np.uint64)
    items, group = [], []
    for g in range(3):
        for _ in range(120):
            flip = np.zeros(256, np.uint8)
            flip[rng.choice(256, rng.integers(0, 70), replace=False)] = 1
            items.append(centre[g] ^ np.packbits(flip).view(np.uint64))
            group.append(g)
    items, group = np.stack(items), np.array(group)
    label, near, covered = simhash.searched(group, items, 40)
    d = np.bitwise_count(items[:, None] ^ items[None]).sum(2, dtype=np.int64)
    a, b = np.nonzero((d <= 40) & (group[:, None] == group[None]))
    assert label.tolist() == simhash.unite(np.arange(360), a, b).tolist()
    assert all(d[i, near[i]] <= 40 for i in range(360)) and covered.any() and not covered.all()


ARTICLE = "<p>" + "Some words of a story stand here, and more of them follow. " * 4 + "</p><p>" + "A second paragraph, with commas, and long enough too. " * 3 + "</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "with-sidebar", "no-sidebar", "post share-enabled", "search-results-article", "entry-content related-post", "col side", "comments", "sidebar"])
def test_a_class_alone_never_empties_a_page(name):
    got = html.extract(f"<html><body><nav><a href=/>Home</a></nav><div class='{name}'>{ARTICLE}</div><footer>f</footer></body></html>")
    assert got.startswith("Some words") and got.endswith("long enough too.") and got.count("\n") == 1


def test_what_stands_beside_the_article_goes():
    side, talk = "<p>" + "Other things of no matter stand in here. " * 3 + "</p>", "<p>" + "I liked this story, it was a nice one to read. " * 9 + "</p>"
    for outer in (f"<div class='left-sidebar'>{side}</div>", f"<div id='comments'>{talk}</div>", f"<section><h3>3 Comments</h3><div>{talk}</div></section>", "<div class='cookie-notice'>We use cookies.</div>", f"<header><p>{side}</p></header>"):
        got = html.extract(f"<body><div class=menu><a href=a>a</a></div>{outer}<div id=wrap><h1>Title</h1><div class=txt>{ARTICLE}</div></div>{outer}</body>")
        assert got.split("\n")[0] == "Title" and got.endswith("long enough too.") and got.count("\n") == 2
    assert "a long tail" in html.extract(f"<body><main><div>{ARTICLE}</div><p>a long tail</p></main></body>")


def test_density_by_its_definition():
    page = f"<body><div><ul><li><a href=x>one link</a><li><a href=y>another</a></ul></div><div><div>{ARTICLE}</div><p>tail <a href=z>link</a></p></div></body>"
    tree = html.Tree(page)
    n = len(tree.tag)
    below = lambda i: [j for j in range(n) if i in above(j)]

    def above(j):
        out = []
        while j >= 0:
            out.append(j)
            j = tree.parent[j]
        return out

    chars = [sum(len(t.strip()) for at, _, t in tree.texts if i in above(at)) for i in range(n)]
    links = [sum(len(t.strip()) for at, _, t in tree.texts if i in above(at) and any(tree.tag[k] == "a" for k in above(at)[: above(at).index(i) + 1])) for i in range(n)]
    tags = [len(below(i)) - 1 for i in range(n)]
    link_tags = [sum(tree.tag[j] == "a" for j in below(i)) for i in range(n)]
    body = tree.tag.index("body")
    dense = [html.density(chars[i], links[i], tags[i], link_tags[i], chars[body], links[body]) for i in range(n)]
    sums = [sum(dense[j] for j in range(n) if tree.parent[j] == i) or dense[i] for i in range(n)]
    best = max(range(n), key=lambda i: sums[i])
    assert tree.tag[best] == "div" and html.core(tree, chars, sums) == best
    assert html.extract(page).startswith("Some words")


def test_deep_pages_take_linear_time():
    import time

    start = time.process_time()
    for page in ("<div>" * 40000 + "x" + "</i></zz>" * 4000, "<i><div>" + "<b>" * 40000 + "x" + "</i>" * 4000 + "<p>y" * 4000, "<header>" * 20000 + "x", "<h2>comments</h2>" * 5000 + "<div>" * 5000):
        html.extract(page)
    assert time.process_time() - start < 6


def test_the_index_lives_on(spark):
    rng = random.Random(8)
    passages = [fresh(rng, 40) for _ in range(3)]
    batches = [[fresh(rng, 30) + " " + passages[i % 3] + " " + fresh(rng, 20) if rng.random() < 0.6 else fresh(rng, 60) for i in range(12)] for _ in range(6)]
    docs = spark.createDataFrame([(i, b, t) for i, (b, t) in enumerate((b, t) for b, own in enumerate(batches) for t in own)], "rid long, batch int, text string")
    index = logindex.FingerprintIndex(spark)
    for b in range(6):
        index = logindex.FingerprintIndex(spark, path=index.path)  # as another session would
        index.add(docs.where(F.col("batch") == b).select("rid", "text"))
    assert len(index.runs) < 6 and sorted(r.level for r in index.runs) == [0, 0, 1]
    assert all(not logindex.shared.place(spark, "x")[0].exists(logindex.shared.place(spark, f"{index.path}/manifest-{n:08d}")[1]) for n in range(1, index.version))
    keys = collections.Counter()
    for r in docs.collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        found = logindex.repeats.segments(repeats.units_of(raw, "word")[0], logindex.WIDTH, logindex.K)
        for key, weight in zip(found[0].view(np.int64).tolist(), found[4].tolist()):
            keys[key] += weight
    want = {k for k, n in keys.items() if n >= 2}
    assert {r.key for r in index.keys().collect()} == want and len(want) >= 3
    index.compact()
    assert len(index.runs) == 1 and {r.key for r in logindex.FingerprintIndex(spark, path=index.path).keys().collect()} == want
    with pytest.raises(ValueError):
        logindex.FingerprintIndex(spark, width=9, path=index.path)


def test_words_of_repeated_passages(spark, tmp_path):
    rng = random.Random(9)
    one, two = fresh(rng, 52), fresh(rng, 49)
    texts = [fresh(rng, 30) + " " + p + " " + fresh(rng, 30) for p in (one, one.replace(" ", "\n"), two, two)] + [None, "", one, "w " * 300]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    words = [WORD.findall(t or "") for t in texts]
    often = collections.Counter(tuple(w[i : i + 50]) for w in words for i in range(len(w) - 49))
    want = {}
    for i, w in enumerate(words):
        gone = set()
        for k in range(len(w) - 49):
            if often[tuple(w[k : k + 50])] > 1:
                gone |= set(range(k, k + 50))
        want[i] = len(gone)
    got = {r.doc_id: r.n_passage_words for r in suffix.query(spark, str(tmp_path)).collect()}
    assert got == want and want[0] == 52 and want[2] == 0 and want[7] == 300


def test_ids_beyond_16_bits_are_refused_at_writing():
    with pytest.raises(ValueError, match="16 bits"):
        coder.encode([np.array([3, 1 << 16], np.uint32)])


def test_an_id_takes_one_step_of_the_model(monkeypatch):
    """And blocks of any length, new ids to the last symbol, runs and alternations come back whole; few ids are coded in few bits."""
    steps = []
    expect = coder.Model.expect
    monkeypatch.setattr(coder.Model, "expect", lambda model: (steps.append(1), expect(model))[1])
    rng = np.random.default_rng(4)
    blocks = [rng.permutation(65536)[: coder.BLOCK], np.arange(coder.BLOCK) % 2, np.full(1500, 65535), np.array([0]), rng.integers(0, 300, 1500)]
    blocks += [rng.integers(0, int(rng.choice([2, 50, 2000, 65536])), int(n)) for n in rng.integers(1, coder.BLOCK, 30)]
    raws = coder.encode(blocks)
    assert len(steps) == coder.BLOCK
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(raws, list(map(len, blocks))), strict=True))
    assert len(steps) == 2 * coder.BLOCK
    assert len(raws[1]) < 16 and len(raws[2]) < 16 and 8 * len(raws[4]) < 11 * 1500


def test_shares_of_the_mix_stay_within_their_fields():
    rng = np.random.default_rng(5)
    for row in coder._rows().tolist():
        for round in range(6):
            for came in rng.choice([round % 5, *range(5)], 500, p=[0.8, *[0.04] * 5]).tolist():
                row += -(row >> coder.SHIFT & coder._GIVEN) + int(coder._CAME[came])
                fields = [row >> 16 * i & coder._FIELD for i in range(3)]
                assert row >> 48 == 0 and min(fields) > 30 and sum(fields) < (1 << coder.MIX) - 128


def test_new_words_are_split_as_the_tokenizer_splits_them():
    rng = random.Random(5)
    bits = ["a", "B", "é", "Ö", "ß", "1", "23", "'s", "'", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", ",", ".", "!!", "#%", "—", "日本", "İ", "ǅ", "ﬁ", "é", " ", "\x1c", "×", "word", " the", "\r\n", "ΑΣ", "𝒳", "٣", "\x7f", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["x" * 5000, "a\n\n", "a\n", "\n\na"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = tokens.Encoder(name)
        assert [x.tolist() for x in e.batch(texts)] == [x.ids for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def small_model(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(lbl, "GROUP", 4)
    code = np.arange(1, 31, dtype=np.uint64)
    c = np.sort(rng.integers(2, 90, 30))[::-1]
    v = lbl.Vocabulary(code, c, int(c.sum()), 30, classes=6, words=24, least=5)
    parts = [p + rng.normal(0, 0.4, p.shape).astype(np.float32) for p in lbl.start(v)]
    return v, parts, rng


def test_probabilities_of_the_model_sum_to_one(monkeypatch):
    """Of all known tokens and one unknown, in any context, by plain loops; and the scorer's numbers are those."""
    v, parts, rng = small_model(monkeypatch)
    assert v.singles == 6 and v.n > 8 and v.words == 25

    def probability(token, before):
        cls, near, word, c, _ = (x[0] for x in v.find(np.array([token], np.uint64)))
        past = [v.find(np.array([t], np.uint64)) for t in before]
        q, place, out, bias = parts[:4]
        guess = sum(q[past[-1 - j][1][0] if j < len(past) else v.n] * place[j] for j in range(lbl.CONTEXT))
        e = np.exp(out @ guess + bias)
        p = e[cls] / e.sum()
        if cls >= v.singles:
            q, place, out, bias = parts[4:]
            guess = sum(q[past[-1 - j][2][0] if j < len(past) else v.words] * place[j] for j in range(lbl.REACH))
            a, b = v.first[cls - v.singles], v.first[cls - v.singles + 1]
            e = np.exp(out[a:b] @ guess + bias[a:b])
            p *= e[word - a] / e.sum()
        elif cls == 0:
            p *= (max(c, 0) + 1) / (v.total + v.distinct + 1) / v.share[0]
        return float(p)

    for _ in range(20):
        before = rng.integers(1, 32, rng.integers(0, 8)).astype(np.uint64).tolist()
        total = sum(probability(t, before) for t in [*range(1, 31), 99])
        assert total == pytest.approx(1, abs=1e-4)
    text = rng.integers(1, 33, 40).astype(np.uint64)
    lengths = np.array([25, 15])
    cls, near, word, c, _ = v.find(text)
    context, where = np.unique(lbl.contexts(near, lengths, v.n) @ ((v.n + 1) ** np.arange(lbl.CONTEXT)), return_inverse=True)
    guess, norm = lbl.log_shares(context, parts[:4], v.n)
    got = (guess[where] * parts[2][cls]).sum(1) + parts[3][cls] - norm[where] + lbl.within_shares(word, cls, lengths, parts[4:], v)
    got += np.where(cls == 0, np.log((np.maximum(c, 0) + 1) / (v.total + v.distinct + 1) / v.share[0]), 0)
    want = [math.log(probability(int(t), text[(0 if i < 25 else 25) : i].tolist())) for i, t in enumerate(text)]
    assert got.tolist() == pytest.approx(want, abs=1e-3)


def test_the_vocabulary_grows_and_gains_on_held_out_documents(spark):
    """On the documents themselves: several hundredths of log10 a token over the unigrams, more with more documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gains, words = [], []
    for share in (4, 1):
        own = docs.where(F.pmod("doc_id", F.lit(share)) == 0)
        model = lbl.LanguageModel(own.where(~lbl.held_out(F.col("doc_id"))))
        r = model.score(docs.where(lbl.held_out(F.col("doc_id")))).agg(F.sum(F.col("score") - F.col("base_score")).alias("g"), F.sum("n_tokens").alias("n")).first()
        gains.append(r.g / r.n)
        words.append(model.vocabulary.value.words)
    assert words[1] > 1.5 * words[0] and gains[1] > gains[0] > 0 and gains[1] > 0.05


def test_the_word_trainer_learns_what_the_context_tells():
    code = np.arange(1, 41, dtype=np.uint64)
    v = lbl.Vocabulary(code, np.full(40, 1000), 40_000, 40, classes=2, words=40)
    rng = np.random.default_rng(3)
    kind = np.repeat(rng.integers(0, 2, 1500), 20)  # two languages, of 20 words each
    token = (1 + rng.integers(0, 20, len(kind)) + 20 * kind).astype(np.uint64)
    lengths = np.full(1500, 20)
    t = lbl.WordTrainer(lbl.start(v)[4:], v, 0)
    cls, _, word, _, _ = v.find(token)
    before = lbl.within_shares(word, cls, lengths, t.parts, v).sum()
    for _ in range(4):
        t.learn(word, cls, lengths)
    assert (lbl.within_shares(word, cls, lengths, t.parts, v).sum() - before) / len(token) > 0.4  # of log 2


def test_quality_verdicts_repeat(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (sorted((r.doc_id, r.kept) for r in quality.judged(docs.repartition(n)).select("doc_id", "kept").collect()) for n in (1, 5))
    assert one == two and 0.5 < sum(k for _, k in one) / len(one) < 1


def benchmark_hit(text, items):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = words(text)
    for item in map(words, items):
        size = min(10, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        if any(tuple(own[i : i + size]) in windows for i in range(len(own) - size + 1) if windows):
            return True
    return False


def test_pipeline_by_plain_python(spark, tmp_path):
    """run() on planted documents: what the rules reject, near copies, passages of 51 to 65 words, benchmark windows, packing."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_stages import without_repeats

    rng = random.Random(12)
    texts = [fresh(rng, rng.randint(80, 160)) for _ in range(60)]
    passages = [fresh(rng, n) for n in (51, 55, 60, 65)]
    texts += [fresh(rng, 90) + " " + p + " " + fresh(rng, 90) for p in passages for _ in range(3)]
    for i in range(12):
        base = texts[i].split()
        n = round((len(base) - 4) * (1 - 2 * (j := rng.uniform(0.81, 0.9)) / (1 + j))) - 1
        texts.append(" ".join(base[: len(base) - n] + [f"q{rng.randrange(10**6)}" for _ in range(n)]))
    items = [fresh(rng, 14) for _ in range(5)]
    texts += [fresh(rng, 60) + " " + " ".join(x.split()[2:13]) + " " + fresh(rng, 60) for x in items]
    texts += ["a b c", None, "", "one two three four five " * 40, texts[3], texts[4].upper()]
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    verdict = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    own = [(i, t) for i, t in enumerate(texts) if i in verdict]
    assert not {len(texts) - 6, len(texts) - 5, len(texts) - 4, len(texts) - 3} & verdict and len(own) > len(texts) - 12
    roots = classes([t for _, t in own])
    own = [x for k, x in enumerate(own) if roots[k] == k]
    assert len(own) <= len(verdict) - 12
    cut = without_repeats([t for _, t in own], 50, 400)
    own = [(i, t) for (i, _), t in zip(own, cut) if t is None or t.strip()]
    assert not any(p in t for p in passages for _, t in own)
    own = [(i, t) for i, t in own if not benchmark_hit(t, items)]
    assert not set(range(len(texts) - 11, len(texts) - 6)) & {i for i, _ in own}
    t = tokens.encoder(packing.VOCABULARY).tokenizer
    want = {i: t.encode(x, add_special_tokens=False).ids + [packing.END] for i, x in own}
    pieces = collections.defaultdict(list)
    for r in pipeline.run(spark, str(tmp_path)).collect():
        pieces[r.doc_id].append((r.start, list(r.ids)))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()} == want
    assert set(range(60)) - {3, 4} <= want.keys() | {k for k in range(12)}


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    frame(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_averages_of_parameters_travel_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(lbl, "CHUNK", 1 << 10)
    docs = spark.createDataFrame([(i, fresh(random.Random(i % 7), 30)) for i in range(60)], "doc_id long, text string").repartition(3)
    one = lbl.LanguageModel(docs)
    monkeypatch.setattr(lbl, "CHUNK", 1 << 20)
    two = lbl.LanguageModel(docs)
    assert [p.shape for p in one.parts] == [p.shape for p in lbl.start(one.vocabulary.value)]
    assert all(np.isfinite(p).all() for p in two.parts)
