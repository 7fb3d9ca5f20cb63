"""Queries over whole texts read every letter."""

import re

import pytest

from relictum.functions import seq
from relictum.plans import queries

LONG = "acgtta" * 30 + "g" * 90 + "catgcatg" * 40


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    texts = [LONG, "xx " + LONG[::-1] + " é", "acg" * 25, "ttttttttttcc", "acgt", None, "Tag " * 20 + "c" * 300, "gatc" * 4000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def reads(spark, folder):
    rows = {r.doc_id: re.sub("[^ACGT]", "", (r.text or "").upper()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    return {i: s for i, s in rows.items() if len(s) >= 10}


def dust(s):
    """The score by its definition: the largest of all windows of 64 triplets."""
    t = [s[i : i + 3] for i in range(len(s) - 2)]
    best = 0.0
    for at in range(max(1, len(t) - 63)):
        w = t[at : at + 64]
        best = max(best, 200.0 * sum(n * (n - 1) / 2 for n in map(w.count, set(w))) / (len(w) * (len(w) - 1)))
    return int(best + 0.5)


def test_whole_reads(spark, folder):
    own = reads(spark, folder)
    assert max(map(len, own.values())) == 16000
    of = lambda name, c: {r.id: r[c] for r in queries.QUERIES[f"{name}_whole"](spark, folder).collect()}
    assert of("revcomp", "rc") == {i: s[::-1].translate(str.maketrans("ACGT", "TGCA")) for i, s in own.items()}
    assert of("gc_content", "gc") == {i: round(sum(c in "GC" for c in s) / len(s), 6) for i, s in own.items()}
    ref = {i: s[:3].replace("T", "C") + s[3:] if i % 2 == 0 else s for i, s in own.items()}
    assert of("aligned_reference", "ref") == ref
    assert of("pmd_score", "pmd") == pytest.approx({i: seq.pmd_of(s, ref[i]) for i, s in own.items()}, abs=2e-5)
    want = {i: dust(s) for i, s in own.items()}
    assert of("dust_any_length", "dust") == of("dust_score", "dust") == want and len(set(want.values())) > 3
    assert queries.QUERIES["dust_filter_whole"](spark, folder).first().n == sum(x <= 4 for x in want.values())


def test_ends_of_whole_reads(spark, folder):
    """The 3' counts come from the text's end, not from letter 60."""
    own, want = reads(spark, folder), {}
    for i, s in own.items():
        ref, turn = s[:3].replace("T", "C") + s[3:] if i % 2 == 0 else s, str.maketrans("ACGT", "TGCA")
        s, ref = (s[::-1].translate(turn), ref[::-1].translate(turn)) if i % 3 == 0 else (s, ref)
        for p in range(5):
            for end, k in (("5p", p), ("3p", len(s) - 1 - p)):
                key = (i % 7, end, p, ref[k] + s[k])
                want[key] = want.get(key, 0.0) + 1
    assert {(r.taxon, r.end, r.pos, r.sub): r.w for r in queries.QUERIES["substitution_matrix_whole"](spark, folder).collect()} == want


def test_rows_only_fits_read_whole_texts(spark, folder, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.commands, "dfit", lambda rows, **_: seen.append(rows) or rows)
    monkeypatch.setattr(queries.commands, "regression", lambda rows, *_: seen.append(rows.withColumnRenamed("id", "taxid")) or rows)
    for name in ("dfit_params", "bootstrap_ci", "regression_fit"):
        queries.QUERIES[name](spark, folder)
    want = sorted(map(tuple, queries.QUERIES["substitution_matrix_whole"](spark, folder).collect()))
    assert all(sorted(map(tuple, rows.collect())) == want for rows in seen) and len(seen) == 3


def test_every_query_over_sequences_has_a_whole_one():
    own = {n: q.removeprefix(f"with recursive {queries.PROXY}\n") for n, q in queries.SQL.items() if not n.endswith("_whole")}
    over = {n for n, q in own.items() if re.search(r"\b(from|join) (sq|mm)\b", q) and not re.search(r"\bmm (as )?\(|\) mm\b|\bmm as\b", q)}
    assert over == {n for n in own if f"{n}_whole" in queries.QUERIES} and len(over) == 19
    assert "[1:60]" not in queries.WHOLE
