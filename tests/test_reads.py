"""Commands on small SAM texts with known results, and functions on literals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relictum.functions import fit, seq
from relictum.operators import damage, rollup, select
from relictum.operators import taxonomy as tax
from relictum.operators.filters import AlignmentFilter, best_as, first_reads
from relictum.plans import commands
from relictum.sources import alignments, tables

HEAD = ["@HD\tVN:1.6\tSO:queryname", "@SQ\tSN:ref1\tLN:1000", "@SQ\tSN:ref2\tLN:1000", "@SQ\tSN:ref3\tLN:1000"]
NODES = "1,1,no rank 2,1,domain 3,2,lineage 4,3,kingdom 5,4,phylum 6,5,class 7,6,order 8,7,family 9,8,genus 10,9,species 11,10,subspecies 12,10,subspecies 13,10,subspecies 200,1,domain"


def line(read, ref, bases="T" * 30, md="30", cigar="30M", score=None, flag=0):
    tags = [f"MD:Z:{md}"] + ([f"AS:i:{score}"] if score is not None else [])
    return "\t".join([read, str(flag), ref, "1", "60", cigar, "*", "0", "0", bases, "I" * len(bases), *tags])


SAM2 = [line("read1", "ref1", md="0C29"), line("read1", "ref2"), line("read1", "ref3")]
SAM3 = [line("read1", "ref1", md="0C29"), line("read1", "ref2", md="0C29"), line("read2", "ref1", "A" * 30)]
SINGLE = [line("best1", r, score=s) for r, s in (("ref1", 50), ("ref2", 10), ("ref3", 20), ("ref1", 30), ("ref2", 40))]
TIE = [line("tie1", r, "A" * 30, score=s) for r, s in (("ref1", 60), ("ref2", 60), ("ref3", 60), ("ref1", 60), ("ref2", 20))]


@pytest.fixture
def sam(spark, tmp_path):
    def make(rows, head=HEAD):
        path = tmp_path / f"x{random.random()}.sam"
        path.write_text("\n".join([*head, *rows]) + "\n")
        return alignments.read_sam(spark, str(path))

    return make


@pytest.fixture
def nodes(spark):
    rows = [x.split(",") for x in NODES.replace("no rank", "no_rank").split()]
    return spark.createDataFrame([(int(a), int(b), c.replace("_", " ")) for a, b, c in rows], "taxid int, parent int, rank string")


@pytest.fixture
def names(spark):
    text = "root d__Eukaryota d__Viruses d__Bacteria d__Archaea l__Eukaryota l__Viruses l__Monodnaviria l__Duplodnaviria l__Bacteria l__Bacteria".split()
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(text)], "taxid int, name string")


@pytest.fixture
def ref2tax(spark):
    return spark.createDataFrame([(0, 11), (1, 12), (2, 13)], "tid int, taxid int")


def cells(d):
    return {(r.id, r.end, r.pos, r["sub"]): r.w for r in d.counts.collect()}


def test_order_is_checked(sam):
    with pytest.raises(ValueError):
        sam(SAM2, ["@HD\tVN:1.6\tSO:unsorted", *HEAD[1:]])


def test_by_reference(sam):
    rows, _ = sam(SAM2)
    d = commands.getdamage(rows, 1, where=AlignmentFilter(min_length=0))
    assert sorted((r.id, r.nreads, r.mean_len, r.var_len, r.mean_gc) for r in d.stats.collect()) == [(i, 1, 30.0, 0.0, 0.0) for i in range(3)]
    assert sorted(map(tuple, d.lengths.collect())) == [(i, 30, 1) for i in range(3)]
    got = cells(d)
    assert got[0, "5p", 0, "CT"] == 1 and (0, "5p", 0, "TT") not in got
    assert all(got[0, "5p", p, "TT"] == 1 for p in range(1, 5)) and all(got[0, "3p", p, "TT"] == 1 for p in range(5))


def test_global_counts(sam):
    rows, _ = sam(SAM3)
    d = commands.getdamage(rows, 0, where=AlignmentFilter(min_length=0))
    got = cells(d)
    assert (got[0, "5p", 0, "CT"], got[0, "5p", 0, "AA"]) == (2, 1)
    assert d.matrices(5).first().nal == 3


def test_taxid_mode_and_dust(sam, ref2tax):
    rows, _ = sam(SAM2)
    d = commands.getdamage(rows, 2, where=AlignmentFilter(min_length=0, max_dust=0), ref2tax=ref2tax)
    assert d.stats.count() == 0 and d.counts.count() == 0


@pytest.mark.parametrize(("rows", "n", "node", "naln"), [(SINGLE, 1, 11, 1), (TIE, 4, 10, 4)])
def test_best_score(sam, nodes, names, ref2tax, rows, n, node, naln):
    own, _ = sam(rows)
    assert commands.getdamage(own, 0, where=AlignmentFilter(min_length=0), best=True).stats.first().nreads == n
    got = commands.lca(own, ref2tax, nodes, names, best=True).reads.first()
    assert (got.lca, got.naln) == (node, naln)


def test_lca(sam, nodes, names, ref2tax):
    rows, _ = sam(SAM3)
    out = commands.lca(rows, ref2tax, nodes, names, weight_type=1)
    got = {r.qname: r for r in out.reads.collect()}
    assert (got["read1"].naln, got["read1"].lca, got["read2"].lca, got["read2"].lca_rank) == (2, 10, 11, "subspecies")
    assert got["read1"].taxa_path.startswith('10:"l__Bacteria":"species";9:') and got["read1"].dustscore == 100 and got["read1"].nspec == 1
    assert sorted((r.taxid, r.nreads) for r in out.stats.collect()) == [(10, 1), (11, 1)]
    assert cells(out.damage)[11, "5p", 0, "CT"] == 0.5
    assert out.used.count() == 3 and out.missing.count() == 0 and out.family.count() == 3


def test_reverse_strand(sam):
    rows, _ = sam([line("r", "ref1", "A" * 29 + "G", md="29A0", flag=16)])
    got = cells(commands.getdamage(rows, 0, where=AlignmentFilter(min_length=0)))
    assert got[0, "5p", 0, "TC"] == 1 and got[0, "3p", 0, "TT"] == 1


def test_reference_rebuilt():
    assert seq.reference_of("TTTT", "4M", "0C3") == "CTTT"
    assert seq.reference_of("ACGTACGT", "2S6M", "6") == "........"
    assert seq.reference_of("ACGTACGT", "2S6M", "6", compat=False) == "..GTACGT"
    assert seq.reference_of("ACGTACGT", "6M2S", "6") == "ACGTAC.."
    assert seq.reference_of("ACGTAC", "2M2I2M", "4") == "AC..AC"
    assert seq.reference_of("ACGT", "2M1D2M", "2^A0C1") == "ACCT"
    assert seq.reference_of("ACGT", "4=", "4") is None and seq.reference_of("ACGT", "4M", None) is None and seq.reference_of("ACGT", "3M", "3") is None


def test_dust(spark):
    rng = random.Random(3)
    reads = ["T" * 30, "AAAA", "AAA", "A", "", "ACGTACGT", *["".join(rng.choice("ACGTN") for _ in range(n)) for n in (10, 40, 66)]]
    assert [seq.dust_of(x) for x in reads[:6]] == pytest.approx([100, 100, 0, 0, 0, 13.3333], abs=1e-4)
    assert seq.dust_of("ACGT", 2) == -1 and seq.dust_of("A" * 607) == 100
    assert seq.dust_of("ACGNNNTACGT") == seq.dust_of("ACGTACGT")
    rows = spark.createDataFrame([(x,) for x in reads], "s string").select("s", seq.dust_short("s").alias("a"), seq.dust("s").alias("b")).collect()
    assert all(r.a == pytest.approx(seq.dust_of(r.s)) == pytest.approx(r.b) for r in rows)


def test_pmd(spark):
    read, ref = "TACGTTGCA", "CACGTTGCG"
    row = spark.createDataFrame([(read, ref, [40] * 9)], "r string, f string, q array<int>").select(seq.pmd("r", "f").alias("a"), seq.pmd("r", "f", "q").alias("b"), seq.pmd("r", "f", "q", True).alias("c")).first()
    assert row.a == pytest.approx(seq.pmd_of(read, ref)) == pytest.approx(row.b) and row.c != row.a
    assert seq.pmd_of("T", "C") == pytest.approx(3.12266, abs=1e-4) and seq.pmd_of("C", "C") == pytest.approx(-0.247512, abs=1e-4)


def test_gc_and_cigar(spark):
    row = spark.createDataFrame([("GCNNAT", "10M2I5=3S2X")], "s string, c string").select(seq.gc("s"), seq.matched_bases("c"), seq.revcomp("s"), seq.gc(F.lit("NN"))).first()
    assert tuple(row) == (0.5, 17, "ATNNGC", 0.0)


def test_moments(spark):
    tree = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (2, 1, 1), (3, 3, 0), (3, 1, 1)], "taxid int, anc int, dist int")
    stats = spark.createDataFrame([(1, 1, 10.0, 0.0), (2, 2, 20.0, 4.0), (3, 3, 30.0, 9.0)], "taxid int, nreads long, mean_x double, var_x double")
    compat = {r.taxid: r for r in rollup.moments(stats, tree, ["x"], True).collect()}
    exact = {r.taxid: r for r in rollup.moments(stats, tree, ["x"]).collect()}
    assert compat[1].mean_x == pytest.approx(23.3333, abs=1e-4) and exact[1].mean_x == pytest.approx(23.3333, abs=1e-4) and compat[1].var_x == pytest.approx(58.5333, abs=1e-4)
    two = stats.where("taxid < 3").withColumn("nreads", F.lit(1).cast("long")).withColumn("mean_x", F.col("taxid") * 10.0).withColumn("var_x", F.lit(0.0))
    assert {r.taxid: r.var_x for r in rollup.moments(two, tree, ["x"], True).collect()}[1] == 0
    assert {r.taxid: r.var_x for r in rollup.moments(two, tree, ["x"]).collect()}[1] == pytest.approx(50)


def test_aggregate_and_filter(sam, nodes, names, ref2tax):
    rows, _ = sam(SAM3)
    out = commands.lca(rows, ref2tax, nodes, names)
    report, lengths = commands.aggregate(out.stats, nodes, names, out.damage.nreads.withColumnRenamed("id", "taxid"), out.damage.lengths.withColumnRenamed("id", "taxid"))
    by = {r.taxid: r for r in report.collect()}
    assert (by[1].nreads, by[1].nalign, by[10].nreads, by[11].nreads) == (2, 3, 2, 1)
    sums = {r.taxid: r.n for r in lengths.groupBy("taxid").agg(F.sum("cnt").alias("n")).collect()}
    assert all(sums[t] == r.nalign for t, r in by.items() if t in sums)
    m = out.damage.matrices(5)
    kept = commands.filter_damage({"matrices": m, "lengths": out.damage.lengths}, m.sparkSession.createDataFrame([(10,)], "id int"), tax.closure(nodes))
    assert sorted(r.id for r in kept["matrices"].collect()) == [11, 12] and kept["lengths"].count() == 2
    printed = commands.printed(out.damage.counts, out.damage.nreads)
    assert printed.count() == 20 and all(abs(sum(r[f"T{x}"] for x in "ACGT") - (r["TT"] > 0)) < 1e-9 for r in printed.collect())
    assert damage.unfolded(m).join(out.damage.counts, ["id", "end", "pos", "sub", "w"]).count() == out.damage.counts.count()


def test_extract(sam):
    own = [line("read1", "ref1"), line("read2", "ref1"), line("read2", "ref2"), *[line("read3", f"ref{i}") for i in (1, 2, 3)]]
    rows, refs = sam(own)
    s = rows.sparkSession
    three = s.createDataFrame([("read3",)], "qname string")
    assert select.by_read(rows, three).count() == 3 and select.by_read(rows, three, True).count() == 3
    c = refs.where("rname = 'ref3'")
    assert select.by_reference(rows, c).count() == 1 and select.by_reference(rows, c, False).count() == 3
    assert [r.qname for r in select.unmatched(s.createDataFrame([("x",), ("read1",)], "qname string"), rows).collect()] == ["x"]
    kept, head = select.compressed(rows.where("tid <> 1"), refs, 30)
    assert [(r.tid, r.rname) for r in head.orderBy("tid").collect()] == [(0, "ref1"), (1, "ref3")] and kept.count() == 4
    assert first_reads(rows, 2).count() == 3
    with pytest.raises(Exception, match="cannot resolve"):
        select.resolve(s.createDataFrame([("nope",)], "label string"), refs).collect()


def test_files(spark, tmp_path, sam):
    rows, _ = sam(SAM2)
    d = commands.getdamage(rows, 1, where=AlignmentFilter(min_length=0))
    m = d.matrices(5)
    tables.write_matrices(m, str(tmp_path / "a.gz"), 5)
    assert sorted(map(tuple, tables.read_matrices(spark, str(tmp_path / "a.gz")).collect())) == sorted(map(tuple, m.collect()))
    text = tables.lengths_text(d.lengths)
    assert sorted(r.value for r in text.collect()) == ["0\t30:1", "1\t30:1", "2\t30:1"]
    text.select("value").write.text(str(tmp_path / "l"))
    assert sorted(map(tuple, tables.read_lengths(spark, str(tmp_path / "l")).collect())) == sorted(map(tuple, d.lengths.collect()))
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n1\t|\tall\t|\t\t|\tsynonym\t|\n")
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tdomain\t|\n2\t|\t9\t|\tx\t|\n")
    (tmp_path / "acc").write_text("a v t g\nx ref1 11 0\nx ref1 12 0\nx other 5 0\n")
    assert [tuple(r) for r in tables.read_names(spark, str(tmp_path / "names.dmp")).collect()] == [(1, "root")]
    assert sorted(map(tuple, tables.read_nodes(spark, str(tmp_path / "nodes.dmp")).collect())) == [(1, 1, "no rank"), (2, 1, "domain")]
    refs = alignments.refs_frame(spark, HEAD)
    assert [tuple(r) for r in tables.read_acc2tax(spark, str(tmp_path / "acc"), refs).collect()] == [("ref1", 0, 12)]
    alignments.write_sam(rows, str(tmp_path / "sam"), HEAD)
    back, _ = alignments.read_sam(spark, str(tmp_path / "sam"))
    assert sorted(map(tuple, back.drop("aln_idx").collect())) == sorted(map(tuple, rows.drop("aln_idx").collect()))


def test_bam(spark, tmp_path):
    import gzip
    import struct

    head = "\n".join(HEAD) + "\n"
    raw = b"BAM\1" + struct.pack("<i", len(head)) + head.encode() + struct.pack("<i", 3)
    for i in (1, 2, 3):
        raw += struct.pack("<i", 5) + f"ref{i}".encode() + b"\0" + struct.pack("<i", 1000)
    body = struct.pack("<iiBBHHHiiii", 1, 4, 3, 60, 0, 1, 16, 5, -1, -1, 0) + b"ab\0" + struct.pack("<I", 5 << 4) + bytes([0x12, 0x48, 0xF0]) + bytes([30] * 5) + b"MDZ5\0" + b"NMC\2" + b"ASs" + struct.pack("<h", 77)
    (tmp_path / "x.bam").write_bytes(gzip.compress(raw[:50]) + gzip.compress(raw[50:] + struct.pack("<i", len(body)) + body))
    rows, refs = alignments.read_bam(spark, str(tmp_path / "x.bam"))
    r = rows.first()
    assert (r.qname, r.tid, r.rname, r.pos, r.cigar, r.seq, r.md, r.nm, r.as_score, r.flag) == ("ab", 1, "ref2", 4, "5M", "ACGTN", "5", 2, 77, 16)
    assert refs.count() == 3


def test_fit_finds_the_likelihood():
    rng = np.random.default_rng(5)
    x = np.tile(np.arange(15), 2)
    d = 0.3 * 0.7**x + 0.02
    n = np.full(30, 500.0)
    k = rng.binomial(500, rng.beta(d * 200, (1 - d) * 200)).astype(float)
    p, llh, _ = fit.best_fit(x, k, n, 2, np.random.default_rng(0))
    assert llh >= fit.log_likelihood(np.array([0.3, 0.3, 0.02, 200]), x, k, n) - 1e-3
    assert abs(p[0] - 0.3) < 0.1
    v = np.array([0.01, 0.5, 1, 3.3, 20, 1e5])
    assert fit.lgamma(v) == pytest.approx([math.lgamma(t) for t in v], rel=1e-10, abs=1e-10)


def test_interval_positions():
    v = np.arange(40.0)
    assert fit.interval(v[:2], 0.95, 2) == (1, 0) and fit.interval(v[:3], 0.95, 2) == (1, 1) and fit.interval(v[:10], 0.95, 2) == (1, 8)


def test_bad_arguments(spark):
    for bad in ({"max_dust": 101}, {"min_ani": 2}, {"min_edit": 5, "max_edit": 2}, {"min_length": -1}):
        with pytest.raises(ValueError):
            AlignmentFilter(**bad)
    with pytest.raises(ValueError):
        tax.level_of("nonsense")
    with pytest.raises(Exception, match="without score"):
        best_as(spark.createDataFrame([("a", None)], "qname string, as_score int")).collect()


def test_broken_lineages(spark):
    nodes = spark.createDataFrame([(1, 1, "no rank"), (2, 1, "species"), (5, 99, "species")], "taxid int, parent int, rank string")
    tree = tax.lineage(nodes)
    rows = spark.createDataFrame([("a", 5), ("b", 5), ("b", 2), ("c", 2), ("c", 2)], "qname string, taxid int").join(tree, "taxid")
    got = {r.qname: (r.lca, r.naln) for r in tax.lca(rows).collect()}
    assert got["c"] == (2, 2) and "b" not in got and "a" in got


def test_streaming(spark, tmp_path):
    from relictum.streaming import damage as streams

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text('{"k": "x", "w": 2}\n{"k": "y", "w": 1}\n')
    rows = spark.readStream.schema("k string, w long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = streams.stream(rows, lambda b: b.groupBy("k").agg(F.sum("w").alias("w")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(60)
    assert sorted(map(tuple, streams.totals(spark.read.parquet(str(tmp_path / "out")), ["k"], ["w"]).collect())) == [("x", 4), ("y", 2)]
