"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from relictum.llm import coder, decontam, graph, html, lbl, logindex, packing, quality, repeats, shared, simhash, suffix, tokenstore, urlfilter
from relictum.llm.tokens import Encoder, encoder

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(300), text(90)
    near = base.split()
    near[50] = "Changed"
    rows = [base, base, " ".join(near), text(20) + " " + passage + "\n" + text(30), passage + " " + text(5), None, "", "  \t\n", "x", "a b", "a" * 1500, "é" * 450, "ab" * 500, "one two three\n" * 60, text(4000), base.upper()]
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (None, "a null id " + passage), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string")


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    docs.write.parquet(f"{path}/documents.parquet")
    items = [(0, " ".join(corpus()[4][1].split()[10:35])), (1, "A b"), (2, None), (3, "..."), (4, "no such words stand in any document at all, none of them")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(0, "http://User@A.example.com:80/x?y", "<p>x"), (1, None, None), (2, "nothing", ""), (3, "https://b.example.com", "<div>y</div>"), (3, "https://b.example.com", "<div>y</div>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, docs, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    return path


def same(df, want):
    assert collections.Counter(tuple(r) for r in df.collect()) == collections.Counter(want)


def test_empty_tables(spark, empty):
    for q in (simhash, packing, decontam, lbl, urlfilter, suffix, html, logindex, quality, tokenstore):
        assert q.query(spark, empty).count() == 0, q.__name__


def covered(units, width, count):
    mask = [False] * len(units)
    for p in range(len(units) - width + 1):
        if count[tuple(units[p : p + width])] > 1:
            mask[p : p + width] = [True] * width
    return mask


@pytest.mark.parametrize("hot", [1000, 1])
def test_suffix(spark, folder, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [(i, (t or "").encode()) for i, t in corpus()]
    count = collections.Counter(tuple(b[p : p + 400]) for _, b in rows for p in range(len(b) - 399))
    want = []
    for i, b in rows:
        m = covered(b, 400, count)
        left = bytes(x for x, gone in zip(b, m) if not gone)
        want.append((i, len(b), sum(m), sum(1 for k, x in enumerate(m) if x and (k == 0 or not m[k - 1])), hashlib.sha256(left).hexdigest()))
    same(suffix.query(spark, folder).drop("n_passage_words"), want)  # that column: test_methods.py


def test_suffix_array():
    rng = random.Random(1)
    for text in (b"", b"a", b"banana", b"aaaa", b"abab" * 20, bytes(rng.choice(b"ab") for _ in range(500)), bytes(rng.randrange(256) for _ in range(300))):
        assert suffix.two_stage(text, 600).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("hot", [1000, 1])
def test_log_index(spark, folder, monkeypatch, hot):
    monkeypatch.setattr(logindex, "HOT", hot)
    rows = [(i, WORD.findall(t or "")) for i, t in corpus()]
    count = collections.Counter(tuple(w[p : p + 35]) for _, w in rows for p in range(len(w) - 34))
    want = []
    for i, w in rows:
        m = covered(w, 35, count)
        want.append((i, len(w), sum(m), hashlib.sha256(" ".join(x for x, gone in zip(w, m) if not gone).encode()).hexdigest()))
    same(logindex.query(spark, folder), want)


def test_incremental_index(spark, docs):
    own = repeats.keyed(docs.drop("rid")).select("rid", "text", "doc_id")
    index = logindex.FingerprintIndex(spark)
    assert index.add(own.where("doc_id = 0")).count() == 0
    assert index.add(own.where("doc_id = 2")).count() > 0
    assert index.add(own.where("doc_id = 9")).count() == 0
    index.compact()
    assert len(index.runs) == 1 and index.keys().count() > 0


def print_of(t):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, folder):
    rows = [(i, print_of(t)) for i, t in corpus()]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min(label[k] for k, (_, g) in enumerate(rows) if (f ^ g).bit_count() <= 4) for _, f in rows]
    least = {c: min((i for k, (i, _) in enumerate(rows) if label[k] == c and i is not None), default=None) for c in set(label)}
    same(simhash.query(spark, folder), [(i, f"{f:016x}", least[label[k]]) for k, (i, f) in enumerate(rows)])


def test_bk_trees():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    items = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)) for c in centre])
    group = np.repeat([1, 2, 3], 100)
    got = simhash.forest(group, items[:, None], 4)
    want = np.arange(300)
    for _ in range(40):
        for i in range(300):
            near = (np.bitwise_count(items ^ items[i]) <= 4) & (group == group[i])
            want[i] = want[near].min()
    assert got.tolist() == want.tolist()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    root = {}
    find = lambda a: a if root.setdefault(a, a) == a else find(root[a])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {a: find(a) for a, b in edges for a in (a, b) if any(x != y and a in (x, y) for x, y in edges)}


def test_dedup_keeps_one(docs):
    left = simhash.dedup(docs).select("doc_id", "rid").collect()
    ids = [r.doc_id for r in left]
    assert {0, 4, 5, 8}.issubset(ids) and not {1, 2} & set(ids) and ids.count(3) == 1 and all(r.rid == "extra" for r in left)


def test_packing(spark, docs):
    pieces = packing.pack(docs.repartition(2)).collect()
    t = Encoder(packing.VOCABULARY).tokenizer
    want = collections.Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in corpus())
    got, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
        seqs[p.sequence_id].append(p)
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    for own in seqs.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    for (i, ids), n in want.items():
        if sum(1 for j, _ in want.elements() if j == i) == 1:
            assert [x for p in sorted(got[i], key=lambda p: p.start) for x in p.ids] == list(ids)


def test_encoders():
    odd = ["İ ΣΑΣ  don't  ﬁ é ́ a\tb\x1cb\x85c 12 <|x|> \U0001f600 ", "  a", "a ", "a\r\n b", "a\n\n \nb0 0 10", "<|endoftext|> x", "w" * 100 + " y", ""]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = Encoder(name)
        for texts in (odd, odd[::-1]):
            assert [x.tolist() for x in e.batch(texts)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_decontamination(spark, folder):
    gap = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = [(r.item_id, gap.findall(lower(r.text))) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    wins = collections.defaultdict(set)
    for i, w in items:
        for p in range(len(w) - min(10, len(w)) + 1 if w else 0):
            wins[tuple(w[p : p + 10])].add(str(i))
    want = []
    for i, t in corpus():
        w, hit, found = gap.findall(lower(t)), set(), set()
        for win, own in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= own
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert any(x[-1] for x in want)
    same(decontam.query(spark, folder), want)


def test_quality(spark, folder, docs):
    got = collections.Counter(tuple(r)[:7] for r in quality.query(spark, folder).collect())
    want = collections.Counter()
    for i, t in corpus():
        w, x = WORD.findall(t or ""), t or ""
        ls = [s for s in x.split("\n") if WORD.search(s)]
        c = collections.Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
        n = sum(covered(w, 5, c))
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(ls) - len(set(ls)), n, len(w) < 10 or 100 * n > 20 * len(w)] += 1
    assert got == want
    assert quality.keep(docs).columns == docs.columns


def test_junk_goes(spark):
    rng = random.Random(2)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80))
    rows = [(i, clean(), "en", "s") for i in range(400)] + [(1000 + i, clean().replace(" ", "### "), "en", "s") for i in range(20)] + [(2000, clean().replace(" ", "$$$ "), None, None)]
    got = {r.doc_id for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    assert got == set(range(400))


def test_language_model(spark, folder):
    rows = [(i, WORD.findall(lower(t)) + ["\n"]) for i, t in corpus()]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c = collections.Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
    got = lbl.query(spark, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    code = np.arange(1, 6, dtype=np.uint64)
    v = lbl.Vocabulary(code, np.array([50, 40, 30, 20, 10]), 150, 5, 4)
    cls = np.tile([1, 2, 3], 2000)
    t = lbl.Trainer(lbl.start(v), v.share, 0)
    for _ in range(30):
        t.learn(cls, np.array([len(cls)]), v.n)
    ctx = np.arange((v.n + 1) ** lbl.CONTEXT)
    guess, norm = lbl.log_shares(ctx, t.parts, v.n)
    p = np.exp(guess @ t.parts[2].T + t.parts[3] - norm[:, None])
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    after_one = 1 + 3 * (v.n + 1) + 2 * (v.n + 1) ** 2
    assert p[after_one].argmax() == 2 and p[after_one, 2] > 0.8
    assert rng is not None


def test_held_out_gain(spark, tmp_path):
    rng = random.Random(4)
    chain = {w: rng.sample(range(30), 3) for w in range(30)}
    rows = []
    for i in range(400):
        w, out = rng.randrange(30), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(chain[w])
        rows.append((i, " ".join(out)))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    r = lbl.query(spark, str(tmp_path)).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_urls(spark):
    captures = spark.createDataFrame([(1, "http://a.x.com/p", "2024-01-05"), (2, "http://a.x.com/p", "2024-02-05"), (3, "http://x.com:8/", "2024-03-05"), (4, "ftp://u:p@A.X.com.", "2024-03-01"), (5, None, "2024-01-05"), (6, "http://x.com", None)], "id int, url string, f string").select("id", "url", F.to_date("f").alias("fetched"))
    changes = spark.createDataFrame([("x.com", "spam", "2024-02-01", True), ("X.com", "spam", "2024-03-01", False), ("a.x.com", "adult", "2024-01-05", True), ("a.x.com", "adult", "2024-01-06", False), ("a.x.com", "adult", "2024-03-01", True), (None, "spam", "2024-01-01", True)], "domain string, category string, d string, added boolean").select("domain", "category", F.to_date("d").alias("day"), "added")
    got = {r.id: (r.n_active, r.categories, r.blocked) for r in urlfilter.matched(captures, changes).collect()}
    assert got == {1: (1, "adult", True), 2: (1, "spam", True), 3: (0, "", False), 4: (1, "adult", True), 5: (0, "", False), 6: (0, "", False)}


def test_html(spark, folder):
    page = """<!doctype html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><nav><a href=/>Home</a></nav><div class="sidebar"><p>side text</p></div>
    <article><header><h1>Head &amp; tail</h1></header><p>First <b>bold</b>
      line<br>goes on.<p>Second &eacute; &#x41; line that is rather long, with commas.<ul><li>one<li>two</ul><div class="comments"><p>Nice!</p></div><form><p>Mail</p></form></article><footer>(c)</footer></body></html>"""
    assert html.extract(page) == "Head & tail\nFirst bold line goes on.\nSecond é A line that is rather long, with commas.\none\ntwo"
    plain = "<body><div id='menu'><a href=a>a</a> <a href=b>b</a></div><div><h2>Title</h2><p>" + "Some words stand here. " * 20 + "</p><p>End.</p></div></body>"
    assert html.extract(plain).startswith("Title\nSome words") and html.extract(plain).endswith("\nEnd.")
    assert [html.extract(x) for x in (None, "", "<", "<p", "a < b", "<!-- x", "<p>" * 3000)] == ["", "", "<", "", "a < b", "", ""]
    assert [(r.page_id, r.text, r.n_chars) for r in html.query(spark, folder).orderBy("page_id").collect()] == [(0, "x", 1), (1, "", 0), (2, "", 0), (3, "y", 1), (3, "y", 1)]


def test_coder():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 49408, n) for n in (1, 2, 500, 37)] + [np.zeros(300, int), np.full(100, 65535), np.arange(400) * 7 % 300]
    raws = coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, coder.decode(raws, list(map(len, blocks)))))
    assert len(raws[4]) < 60


def test_token_files(spark, folder):
    t = encoder(tokenstore.VOCABULARY).tokenizer
    rows = sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0))
    got = collections.defaultdict(list)
    for r in tokenstore.query(spark, folder).collect():
        got[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    at = 0
    for key in dict.fromkeys(i for i, _ in rows):
        ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in rows if i == key]
        own = sorted(got[key])
        assert sorted((n, c) for _, n, c in own) == sorted((len(x), zlib.crc32(x.tobytes())) for x in ids)
        for s, n, _ in own:
            assert s == at
            at += n


def test_damaged_blocks_are_found():
    ids = np.arange(100, dtype=np.uint32)
    raw = tokenstore.write_block(ids, [(5, 0, 0, 60), (None, 1, 60, 40)], coder.encode([ids])[0])
    got, pieces = tokenstore.read_blocks([raw])[0]
    assert np.array_equal(got, ids) and pieces == [(5, 0, 0, 60), (None, 1, 60, 40)]
    with pytest.raises(ValueError):
        tokenstore.read_blocks([raw[:40] + bytes([raw[40] ^ 1]) + raw[41:]])
    parts = [b"abc", b"", b"defgh" * 99]
    assert tokenstore.combine([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_pipeline(spark, docs, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "ids"}.issubset(out.columns)
    assert out.count() > 0
    now = docs.drop("rid")
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]


CLASH = ["rid", "rid_", "row_", "w", "l", "h", "x", "m", "at", "found", "items", "symbols", "n_words", "kept", "host", "domain", "suffix_", "key", "spans", "cut_", "want"]


def test_clashing_names(spark, docs, folder):
    own = docs.drop("rid").limit(6)
    for c in CLASH:
        own = own.withColumn(c, F.lit("mine"))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    for out in (quality.keep(own), simhash.dedup(own), suffix.dedup(own), logindex.dedup(own), decontam.clean(own, items)):
        assert out.columns == own.columns and {r[c] for r in out.collect() for c in CLASH} <= {"mine"}
    assert decontam.report(own, items).count() == own.count() == quality.judged(own).count()
    pages = own.select("*", F.lit("http://a.b").alias("url"), F.lit("2024-01-01").cast("date").alias("fetched"), F.lit("<p>x").alias("html"))
    changes = spark.createDataFrame([("b", "spam", "2023-01-01", True)], "domain string, category string, d string, added boolean").select("domain", "category", F.to_date("d").alias("day"), "added")
    assert urlfilter.matched(pages, changes).where("blocked").count() == html.extracted(pages.drop("text")).where("text = 'x'").count() == own.count()


def test_shared_folder_is_the_sessions(spark):
    assert shared.folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
