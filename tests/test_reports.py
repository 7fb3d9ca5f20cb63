"""Report layouts, labels, companions, text matrices and fits of single matrices; faults of lca, moved taxids and BAM numbering."""

import gzip
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from relictum.functions import fit
from relictum.operators import taxonomy as tax
from relictum.plans import commands, reports
from relictum.sources import alignments, tables

HEAD = ["@HD\tVN:1.6\tSO:queryname", "@SQ\tSN:ref1\tLN:1000", "@SQ\tSN:ref2\tLN:1000"]
ALIGNED = "aln_idx long, qname string, flag int, tid int, rname string, pos int, mapq int, cigar string, mtid int, seq string, qual array<int>, md string, nm int, as_score int"


def row(i, name, tid, n=40, nm=0, seq=None, flag=0):
    bases = seq if seq is not None else "ACGT" * (n // 4)
    return i, name, flag, tid, f"ref{tid + 1}", 0, 60, f"{len(bases)}M", -1, bases, [40] * len(bases), str(len(bases)), nm, 10


@pytest.fixture(scope="module")
def taxonomy(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "family"), (3, 2, "species"), (4, 2, "species")], "taxid int, parent int, rank string")
    names = spark.createDataFrame([(1, "root"), (2, "fam"), (3, "one"), (4, "two")], "taxid int, name string")
    return nodes, names, spark.createDataFrame([(0, 3), (1, 4)], "tid int, taxid int")


def run(spark, taxonomy, rows, **options):
    nodes, names, ref2tax = taxonomy
    return commands.lca(spark.createDataFrame(rows, ALIGNED), ref2tax, nodes, names, min_length=30, rank="family", **options)


def test_family_holds_only_what_passed(spark, taxonomy):
    out = run(spark, taxonomy, [row(0, "a", 0), row(1, "a", 1, nm=9), row(2, "a", 7), row(3, "b", 0), row(4, "b", 1)], max_edit=3)
    assert sorted(r.aln_idx for r in out.family.collect()) == [0, 3, 4]
    assert {(r.taxid, r.name, r.nreads) for r in out.species.collect()} == {(3, "one", 1)}
    assert [(r.tid, r.n) for r in out.missing.collect()] == [(7, 1)]


def test_max_reads_counts_reads_that_are_left(spark, taxonomy):
    out = run(spark, taxonomy, [row(0, "short", 0, n=20), row(1, "gone", 7), row(2, "a", 0), row(3, "b", 0), row(4, "c", 1)], max_reads=2)
    assert sorted(r.qname for r in out.reads.collect()) == ["a", "b"]


def test_sequences_of_no_length_are_an_error(spark, taxonomy):
    for seq in ("", "*", None):
        with pytest.raises(Exception, match="length zero"):
            run(spark, taxonomy, [row(0, "a", 0), (1, "b", 0, 0, "ref1", 0, 60, "*", -1, seq, [], "0", 0, 1)]).reads.collect()


def test_moved_nodes_keep_what_had_the_number(spark):
    nodes = spark.createDataFrame([(5, 1, "genus"), (6, 1, "species"), (7, 5, "species"), (8, 1, "tribe")], "taxid int, parent int, rank string")
    got = {(r.taxid, r.parent, r.rank) for r in tax.moved_nodes(nodes, {5: 6, 8: 9}).collect()}
    assert got == {(6, 1, "species"), (7, 6, "species"), (9, 1, "tribe")}


def bam(path, names, reads):
    head = "\n".join([HEAD[0], *[f"@SQ\tSN:{n}\tLN:1000" for n in names]]) + "\n"
    raw = b"BAM\1" + struct.pack("<i", len(head)) + head.encode() + struct.pack("<i", len(names))
    for n in names:
        raw += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for q in reads:
        body = struct.pack("<iiBBHHHiiii", 0, 4, len(q) + 1, 60, 0, 1, 0, 5, -1, -1, 0) + q.encode() + b"\0" + struct.pack("<I", 5 << 4) + bytes([0x12, 0x48, 0xF0]) + bytes([30] * 5)
        raw += struct.pack("<i", len(body)) + body
    path.write_bytes(gzip.compress(raw))


def test_records_of_several_bam_files_have_own_numbers(spark, tmp_path):
    bam(tmp_path / "a.bam", ["r1"], ["x", "y"])
    bam(tmp_path / "b.bam", ["r1"], ["z"])
    rows, _ = alignments.read_bam(spark, str(tmp_path))
    got = {r.qname: r.aln_idx for r in rows.collect()}
    assert len(set(got.values())) == 3 and got["x"] < got["y"] < got["z"]
    bam(tmp_path / "c.bam", ["r2"], ["w"])
    with pytest.raises(Exception, match="other references"):
        alignments.read_bam(spark, str(tmp_path))[0].collect()


def test_lca_lines(spark, taxonomy, tmp_path):
    out = run(spark, taxonomy, [row(0, "a", 0), row(1, "b", 0), row(2, "b", 1)])
    reports.write_lines(reports.lca_lines(out.reads), f"{tmp_path}/x", ["qname"], ["#command", reports.LCA_HEAD])
    got = [r.value for r in spark.read.text(f"{tmp_path}/x").collect()]
    assert got[:2] == ["#command", reports.LCA_HEAD]
    assert got[2] == "a\t" + "ACGT" * 10 + '\t40\t1\t1\t13\t0.500000\t3:"one":"species"\t3:"one":"species";2:"fam":"family";1:"root":"no rank"' or got[2].split("\t")[7:] == ['3:"one":"species"', '3:"one":"species";2:"fam":"family";1:"root":"no rank"']
    nodes, names, _ = taxonomy
    line = reports.lca_stats_lines(out.stats, names.join(nodes.select("taxid", "rank"), "taxid")).orderBy("taxid").first().value.split("\t")
    assert len(line) == len(reports.LCA_STATS_HEAD.split("\t")) and line[-2:] == ['"fam"', '"family"']


def test_fit_layouts(spark):
    kn = spark.createDataFrame([(7, [30.0, 12.0, 6.0, 28.0, 11.0, 7.0], [100.0] * 5 + [0.0], [400.0] * 6)], "taxid int, k array<double>, n array<double>, total array<double>")
    fitted = fits = fit.fit(kn, nopt=1, nbootstrap=4)
    assert len(reports.fit_table(fits, 3).columns) == 11 + 12
    one, two = reports.fit_table(fitted, 3, 1), reports.fit_table(fitted, 3, 2)
    assert one.columns[-12:] == [f"{e}{h}{i}" for e in ("fw", "bw") for i in range(3) for h in ("dx", "dxConf")]
    r = two.first()
    assert (r.fwK0, r.fwN1, r.bwK1, r.bwN2, r.bwf2, r.bwdxConf2) == (30.0, 100.0, 11.0, 0.0, 0.0, 0.0) and r.fwf0 == 0.3
    boots = reports.bootstrap_table(fitted).orderBy("run").collect()
    assert [b.run for b in boots] == [0, 1, 2, 3] and r.A_b == pytest.approx(np.mean([b.A for b in boots]))
    with pytest.raises(ValueError):
        reports.fit_table(fitted, 3, 3)


def test_labels_names_and_companions(spark, tmp_path):
    refs = spark.createDataFrame([(0, "ref1"), (5, "ref2")], "tid int, rname string")
    kept = spark.createDataFrame([(0,), (12,), (5,)], "id int")
    rows = spark.createDataFrame([("12",), ("13",), ("global",), ("ref2",), ("ref1x",), (None,)], "label string")
    assert sorted(r.label for r in commands.by_label(rows, kept, refs).collect()) == ["12", "global", "ref2"]
    names = spark.createDataFrame([(12, "twelve")], "taxid int, name string")
    assert commands.named(kept.where("id = 12"), names).first().name == "twelve"
    with pytest.raises(Exception, match="no name for"):
        commands.named(kept, names).collect()
    for n in ("a.bdamage.gz", "a.stat", "a.rlens.gz", "a.rlens"):
        (tmp_path / n).write_text("x")
    assert reports.companions(spark, f"{tmp_path}/a.bdamage.gz") == {"stat": f"{tmp_path}/a.stat", "rlens": f"{tmp_path}/a.rlens.gz"}
    assert reports.companions(spark, f"{tmp_path}/a.bdamage.gz", stat="own")["stat"] == "own" and reports.companion_names("a.txt") == {}


def matrix(tmp_path, key="3"):
    lines = ["#taxid\tdirection\tposition\t" + "\t".join(a + b for a in "ACGT" for b in "ACGT")]
    for end in ("5'", "3'"):
        for p in range(6):
            cells = [1000.0] * 16
            hit = round(1000 * (0.3 * 0.6**p + 0.01))
            cells[4:8] = [0, 1000 - hit, 0, hit] if end == "5'" else [0, 990, 0, 10]
            cells[8:12] = [10, 0, 990, 0] if end == "5'" else [hit, 0, 1000 - hit, 0]
            lines.append("\t".join([key, end, str(p), *map(str, cells)]))
    (tmp_path / f"m{key}.txt").write_text("\n".join(lines) + "\n")
    return f"{tmp_path}/m{key}.txt"


def test_single_matrix(spark, tmp_path):
    rows = reports.read_mismatches(spark, matrix(tmp_path))
    assert rows.count() == 12 and rows.where("end = '5p' and pos = 0").first().CT == 310
    kn = {(r.end, r.pos): (r.k, r.n) for r in reports.single_counts(rows).collect()}
    assert kn["5p", 0] == (310, 1000) == kn["3p", 0]
    s = reports.summaries(rows).first()
    assert (s.n_sum, s.n_min, s.n_max, s.k_sum, s.k_sum_fwd, s.n_first_rev) == (12000, 1000, 1000, 2 * sum(s.k_fwd), sum(s.k_fwd), 1000) and s.f_fwd[0] == 0.31
    got = reports.map_fit(reports.summaries(rows)).first()
    assert got.A == pytest.approx(0.3, abs=0.02) and got.q == pytest.approx(0.4, abs=0.05) and got.c == pytest.approx(0.01, abs=0.01) and got.phi <= 1e5
    assert got.significance == pytest.approx(got.A / got.std) and got.dx[0] == pytest.approx(got.A + got.c)
    held = reports.map_fit(reports.summaries(rows), True).first()
    assert held.phi < got.phi and math.isfinite(reports.log_prior(np.array([0.1, 0.2, 0.1, 100.0])))
    both = rows.unionByName(reports.read_mismatches(spark, matrix(tmp_path, "4")))
    with pytest.raises(Exception, match="more than one key"):
        reports.single_counts(both).collect()


def test_regression_models(spark, tmp_path):
    wide = reports.read_mismatches(spark, matrix(tmp_path))
    subs = [a + b for a in "ACGT" for b in "ACGT"]
    counts = wide.select(F.lit(1).cast("long").alias("id"), "end", "pos", F.explode(F.map_from_arrays(F.array(*map(F.lit, subs)), F.array(*subs))).alias("sub", "w"))
    for model, groups in ((0, 2), (1, 8), (2, 1), (3, 4)):
        got = commands.regressions(counts, model, 3).collect()
        assert len({(r.llh, r.llh_linear, r.refbase, r.end if model < 2 else "") for r in got}) == groups
        assert all(r.llh >= r.llh_linear - 1e-6 for r in got)
        total = {}
        for r in got:
            key = (r.end, r.pos, r.refbase)
            total[key] = total.get(key, 0) + r.f
        assert all(v == pytest.approx(1) for v in total.values())
        ct = {r.pos: r.f for r in got if r.sub == "CT" and r.end == "5p"}
        assert ct[0] > ct[3] and (model % 2 == 0 or ct[0] == pytest.approx(0.31, abs=0.03))
    with pytest.raises(ValueError):
        commands.regressions(counts, 4)


def test_statistics_headers_and_fits(spark, tmp_path):
    stats = spark.createDataFrame([(0, 4, 40.0, 2.5, 0.5, 0.25), (3, 1, 30.0, 0.0, 0.4, 0.0)], "id int, nreads long, mean_len double, var_len double, mean_gc double, var_gc double")
    lines = lambda *a: {r.id: r.value for r in reports.stats_lines(stats, *a).collect()}
    assert lines(2)[3] == "3\t1\t30.000000\t0.000000\t0.400000\t0.000000\tNA\tNA" and lines()[0].startswith("global\t4\t")
    refs = spark.createDataFrame([(0, "ref1"), (3, "ref4")], "tid int, rname string")
    assert {x.split("\t")[0] for x in lines(1, refs).values()} == {"ref1", "ref4"}
    head = [*HEAD, "@RG\tID:x", "@CO\tnote"]
    assert alignments.subset_header(head, ["ref2"]) == [HEAD[0], HEAD[2], "@RG\tID:x", "@CO\tnote"]
    with pytest.raises(ValueError):
        alignments.subset_header(head, ["ref9"])
    (tmp_path / "f.tsv").write_text("taxid\tA\tncall\tfwK0\n7\t0.25\t31\t12\nx\t1\t2\t3\n")
    r = tables.read_fits(spark, f"{tmp_path}/f.tsv").collect()
    assert [tuple(x) for x in r] == [(7, 0.25, 31, 12.0)]
    with pytest.raises(ValueError, match="positions"):
        commands.printed(None, None, positions=6, held=5)
