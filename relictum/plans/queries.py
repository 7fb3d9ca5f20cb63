"""Registered queries: every operator over stand-in tables made from the driver's data, with the same in SQL.

region > nation > supplier is the taxonomy, lineitem holds alignments (order = read, supplier = reference), documents hold
sequences (their letters A, C, G, T): the first 60 of each text, as the SQL has them. Each query over sequences is registered once more
as NAME_whole, over all letters of each text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.functions import fit as fits
from relictum.functions import seq
from relictum.operators import damage, rollup, select
from relictum.operators import taxonomy as tax
from relictum.operators.filters import AlignmentFilter, best_as, first_reads, first_row
from relictum.plans import commands

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
L = 5


def query(name: str, sql: str | None = None, whole: str | None = None):
    """whole: "sql" or "rows" registers the query over whole texts too, with the same SQL over whole texts or without."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"with recursive {PROXY}\n{sql}"
        if whole:
            QUERIES[f"{name}_whole"] = lambda s, d: f(s, d, None)
        if whole == "sql":
            SQL[f"{name}_whole"] = f"with recursive {WHOLE}\n{sql}"
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str, clades: bool = False) -> DataFrame:
    root = spark.createDataFrame([(1, 1, "no rank", "root")], "taxid int, parent int, rank string, name string")
    region = read(spark, d, "region").select((10 + F.col("r_regionkey")).cast("int").alias("taxid"), F.lit(1).alias("parent"), F.lit("clade" if clades else "order").alias("rank"), F.col("r_name").alias("name"))
    nation = read(spark, d, "nation").select((100 + F.col("n_nationkey")).cast("int").alias("taxid"), (10 + F.col("n_regionkey")).cast("int").alias("parent"), F.lit("clade" if clades else "family").alias("rank"), F.col("n_name").alias("name"))
    supplier = read(spark, d, "supplier").select((1000 + F.col("s_suppkey")).cast("int").alias("taxid"), (100 + F.col("s_nationkey")).cast("int").alias("parent"), F.lit("species").alias("rank"), F.col("s_name").alias("name"))
    return root.unionByName(region).unionByName(nation).unionByName(supplier)


def tree(spark: SparkSession, d: str) -> DataFrame:
    return tax.closure(nodes(spark, d))


def lineage(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return tax.lineage(n.drop("name"), n.select("taxid", "name"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return read(spark, d, "lineitem").select(
        c("l_orderkey").alias("qname"), c("l_suppkey").alias("tid"), (1000 + c("l_suppkey")).cast("int").alias("taxid"), c("l_partkey").alias("mtid"),
        (c("l_orderkey") * 1000 + c("l_linenumber") * 100 + F.floor("l_quantity")).alias("aln_idx"), F.floor("l_extendedprice").cast("long").alias("as_score"), (30 + c("l_quantity").cast("int")).alias("len"),
        F.round(c("l_discount") * 100).cast("int").alias("nm"), F.round(c("l_tax") * 100).cast("int").alias("mapq"),
        (F.when(c("l_returnflag") == "R", 512).otherwise(0) + F.when(c("l_returnflag") == "A", 16).otherwise(0) + F.when(c("l_linestatus") == "F", 1).otherwise(0)).alias("flag"),
    )


def sequences(spark: SparkSession, d: str, most: int | None = 60) -> DataFrame:
    """most: letters of each text from its start; None: all."""
    s = F.regexp_replace(F.upper("text"), "[^ACGT]+", "")
    s = s if most is None else F.substring(s, 1, most)
    # Exploded, seq is a column of its own: no filter or projection above it is rewritten to clean the text again each time it names seq.
    own = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array(s)).alias("seq"), (F.col("doc_id") % 7).alias("taxon"), F.when(F.col("doc_id") % 3 == 0, 16).otherwise(0).alias("flag"))
    ref = F.when(F.col("id") % 2 == 0, F.concat(F.translate(F.substring("seq", 1, 3), "T", "C"), F.substring("seq", 4, 2**31 - 1))).otherwise(F.col("seq"))
    return own.where("length(seq) >= 10").withColumn("ref", ref)


PROXY = r"""nodes as (select 1 taxid, 1 parent, 'no rank' rank, 'root' as name union all select 10 + r_regionkey, 1, 'order', r_name from region
  union all select 100 + n_nationkey, 10 + n_regionkey, 'family', n_name from nation union all select cast(1000 + s_suppkey as integer), 100 + s_nationkey, 'species', s_name from supplier),
a as (select taxid, taxid anc, 0 dist from nodes union all select a.taxid, n.parent, a.dist + 1 from a join nodes n on a.anc = n.taxid where n.parent <> n.taxid),
aln as (select l_orderkey qname, l_suppkey tid, cast(1000 + l_suppkey as integer) taxid, l_partkey mtid, cast(l_orderkey * 1000 + l_linenumber * 100 + floor(l_quantity) as bigint) aln_idx,
  cast(floor(l_extendedprice) as bigint) as_score, cast(30 + floor(l_quantity) as integer) len, cast(round(l_discount * 100) as integer) nm, cast(round(l_tax * 100) as integer) mapq,
  (case when l_returnflag = 'R' then 512 else 0 end) + (case when l_returnflag = 'A' then 16 else 0 end) + (case when l_linestatus = 'F' then 1 else 0 end) flag from lineitem),
sq0 as (select doc_id id, regexp_replace(upper(text), '[^ACGT]', '', 'g')[1:60] seq, doc_id % 7 taxon, case when doc_id % 3 = 0 then 16 else 0 end flag from documents),
sq as (select *, case when id % 2 = 0 then translate(seq[1:3], 'T', 'C') || seq[4:] else seq end as ref from sq0 where length(seq) >= 10),
b0 as (select taxon, flag, seq, ref, cast(unnest(range(0, 5)) as integer) p from sq),
b1 as (select taxon, '5p' as "end", p pos, flag, case when flag = 0 then p + 1 else length(seq) - p end i, seq, ref from b0
  union all select taxon, '3p', p, flag, case when flag = 0 then length(seq) - p else p + 1 end, seq, ref from b0),
mm as (select taxon, "end", pos, case when flag = 0 then ref[i] || seq[i] else translate(ref[i] || seq[i], 'ACGT', 'TGCA') end sub, count(*) w from b1 group by all),
stat as (select taxid, count(*) nreads, avg(len) mean_len, coalesce(var_samp(len), 0) var_len from aln group by taxid)"""

#: The same over whole texts.
WHOLE = PROXY.replace("[1:60]", "")


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def counts(spark: SparkSession, d: str, most: int | None = 60) -> DataFrame:
    return damage.substitutions(sequences(spark, d, most), "taxon", L)


# Filters.


def _filtered(f: AlignmentFilter) -> Query:
    return lambda s, d: alignments(s, d).where(f.column(F.col("len"))).groupBy("tid").agg(F.count(F.lit(1)).alias("n"), F.sum("aln_idx").alias("s"))


for _name, _f, _sql in (
    ("flag_mask", AlignmentFilter(), "true"),
    ("discard_mask", AlignmentFilter(discard=17, no_failed=False), "(flag & 17) = 0"),
    ("min_length", AlignmentFilter(min_length=50), "len >= 50"),
    ("edit_distance", AlignmentFilter(min_edit=2, max_edit=6), "nm between 2 and 6"),
    ("ani_filter", AlignmentFilter(min_ani=0.9, max_ani=0.98), "1 - nm / len between 0.9 and 0.98"),
    ("mapq_filter", AlignmentFilter(min_mapq=4), "mapq >= 4"),
    ("aln_filters", AlignmentFilter(min_length=40, min_mapq=2, max_edit=8, min_ani=0.85), "len >= 40 and mapq >= 2 and nm <= 8 and 1 - nm / len >= 0.85"),
):
    query(_name, f"select tid, count(*) n, cast(sum(aln_idx) as bigint) s from aln where {'' if _name == 'discard_mask' else '(flag & 3584) = 0 and '}{_sql} group by tid")(_filtered(_f))


@query("best_as", "select qname, tid, as_score from aln qualify rank() over (partition by qname order by as_score desc) = 1")
def _(s, d):
    return best_as(alignments(s, d)).select("qname", "tid", "as_score")


@query("maxreads_limit", "select qname, tid, aln_idx from aln where qname in (select qname from (select qname, min(aln_idx) f from aln group by qname order by f, qname limit 100))")
def _(s, d):
    return first_reads(alignments(s, d), 100).select("qname", "tid", "aln_idx")


@query("first_alignment", "select qname, arg_min(struct_pack(x := len), aln_idx).x len from (select qname, aln_idx, min(len) len from aln group by all) group by qname")
def _(s, d):
    own = alignments(s, d).groupBy("qname", "aln_idx").agg(F.min("len").alias("len"))
    return first_row(own, ["len"])


# Joins.


@query("ref2tax_inner", "select qname, aln.taxid, count(*) n from aln join (select taxid from nodes where taxid % 3 <> 0) t on aln.taxid = t.taxid group by all")
def _(s, d):
    r = nodes(s, d).where("taxid % 3 <> 0 and rank = 'species'").select((F.col("taxid") - 1000).cast("long").alias("tid"), F.col("taxid").alias("t"))
    return alignments(s, d).join(r, "tid").groupBy("qname", F.col("t").alias("taxid")).agg(F.count(F.lit(1)).alias("n"))


@query("missing_refs_anti", "select tid, count(*) n from aln where taxid not in (select taxid from nodes where taxid % 3 <> 0) group by tid")
def _(s, d):
    r = nodes(s, d).where("taxid % 3 <> 0").select("taxid")
    return alignments(s, d).join(r, "taxid", "left_anti").groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


@query("names_left_join", "select taxid, coalesce(name, '<missing-name>') as name, n from (select taxid, count(*) n from aln group by taxid) left join (select taxid, name from nodes where taxid % 2 = 0) using (taxid)")
def _(s, d):
    n = nodes(s, d).where("taxid % 2 = 0").select("taxid", "name")
    return alignments(s, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("n")).join(n, "taxid", "left").select("taxid", F.coalesce("name", F.lit("<missing-name>")).alias("name"), "n")


@query("moved_taxids", "select case taxid when 1001 then 1002 when 1003 then 1004 else taxid end taxid, count(*) n from aln group by 1")
def _(s, d):
    return tax.moved(alignments(s, d), {1001: 1002, 1003: 1004}).groupBy("taxid").agg(F.count(F.lit(1)).alias("n"))


# Taxonomy.


@query("closure", "select taxid, anc, dist from a")
def _(s, d):
    return tree(s, d)


@query("lineage_paths", "select taxid, string_agg(cast(anc as varchar), ',' order by dist desc) path from a group by taxid")
def _(s, d):
    return lineage(s, d).select("taxid", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("lineage_string", """select a.taxid, string_agg(anc || ':"' || name || '":"' || rank || '"', ';' order by dist) chain from a join nodes n on n.taxid = anc group by a.taxid""")
def _(s, d):
    return lineage(s, d).select("taxid", tax.lineage_string(F.col("path"), F.col("ranks"), F.col("names")).alias("chain"))


@query("clade_fix", "select taxid, parent, case when rank in ('order', 'family') then 'no rank' else rank end rank from nodes")
def _(s, d):
    return tax.without_clades(nodes(s, d, True).drop("name"))


@query("rank_level", "select taxid, case rank when 'species' then 5 when 'family' then 16 when 'order' then 21 else -1 end level from nodes")
def _(s, d):
    return nodes(s, d).select("taxid", tax.level(F.col("rank")).alias("level"))


@query("depth", "select taxid, max(dist) depth from a group by taxid")
def _(s, d):
    return lineage(s, d).select("taxid", "depth")


@query("closest_species", "select taxid, coalesce((select min(anc) from a x join nodes n on n.taxid = anc where x.taxid = nodes.taxid and n.rank = 'species'), 1) species from nodes")
def _(s, d):
    return lineage(s, d).select("taxid", "species")


@query("descendants", "select taxid from a where anc in (10, 101) group by taxid")
def _(s, d):
    return tax.descendants(tree(s, d), s.createDataFrame([(10,), (101,)], "taxid int"))


def reads(s: SparkSession, d: str) -> DataFrame:
    return tax.lca(alignments(s, d).join(lineage(s, d).select("taxid", "path", "species", "complete"), "taxid"), "qname", (F.count_distinct("species").alias("nspec"), F.max("len").alias("len")))


LCA = """, k as (select qname, count(*) naln, count(distinct taxid) nspec, max(len) len from aln group by qname),
anyc as (select aln.qname, anc, count(*) n from aln join a on a.taxid = aln.taxid group by all),
dp as (select taxid, max(dist) depth from a group by taxid),
lca as (select k.qname, naln, nspec, len, arg_max(anc, depth) lca from anyc join k on k.qname = anyc.qname and n = naln join dp on dp.taxid = anc group by all)
"""


def lca_query(name: str, sql: str):
    def put(f):
        QUERIES[name] = f
        SQL[name] = f"with recursive {PROXY}{LCA}{sql}"
        return f

    return put


@lca_query("lca_per_read", "select qname, naln, nspec, lca from lca")
def _(s, d):
    return reads(s, d).select("qname", "naln", "nspec", "lca")


def gated(s: SparkSession, d: str, most: int) -> DataFrame:
    levels = nodes(s, d).select(F.col("taxid").alias("lca"), tax.level(F.col("rank")).alias("level"))
    return reads(s, d).join(levels, "lca").where(f"level <> -1 and level <= {most}")


@lca_query("lca_level_gate", "select lca, count(*) n from lca join nodes on taxid = lca where rank = 'species' group by lca")
def _(s, d):
    return gated(s, d, 5).groupBy("lca").agg(F.count(F.lit(1)).alias("n"))


@lca_query("lca_family_gate", "select lca, count(*) n from lca join nodes on taxid = lca where rank in ('species', 'family') group by lca")
def _(s, d):
    return gated(s, d, 16).groupBy("lca").agg(F.count(F.lit(1)).alias("n"))


@lca_query("lca_node_stats", "select lca, count(*) nreads, round(avg(len), 6) mean_len, round(coalesce(var_samp(len), 0), 4) var_len, round(avg(nspec), 6) mean_nspec from lca group by lca")
def _(s, d):
    out = reads(s, d).groupBy("lca").agg(F.count(F.lit(1)).alias("nreads"), *damage.moments("len", "len"), F.avg("nspec").alias("mean_nspec"))
    return out.select("lca", "nreads", r6("mean_len"), F.round("var_len", 4).alias("var_len"), r6("mean_nspec"))


@lca_query("unique_species", "select lca species, count(*) n from lca where nspec = 1 group by lca")
def _(s, d):
    return tax.unique_species(reads(s, d), "lca").select(F.col("taxid").alias("species"), F.col("nreads").alias("n"))


# Roll-ups.


@query("rollup_counts", "select anc taxid, count(*) n, cast(sum(len) as bigint) bases from aln join a on a.taxid = aln.taxid group by anc")
def _(s, d):
    own = alignments(s, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"))
    return rollup.counts(own, tree(s, d), [], ["n", "bases"])


@query("rollup_rlens", "select anc taxid, len rlen, count(*) cnt from aln join a on a.taxid = aln.taxid group by anc, len")
def _(s, d):
    return rollup.counts(damage.lengths(alignments(s, d), "taxid", F.col("len")), tree(s, d), ["rlen"], ["cnt"])


def read_stats(s: SparkSession, d: str) -> DataFrame:
    return alignments(s, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("nreads"), *damage.moments("len", "len"))


@query("rollup_moments_exact", "select anc taxid, count(*) nreads, round(avg(len), 6) mean_len, round(var_samp(len), 4) var_len from aln join a on a.taxid = aln.taxid group by anc")
def _(s, d):
    return rollup.moments(read_stats(s, d), tree(s, d), ["len"]).select("taxid", "nreads", r6("mean_len"), F.round("var_len", 4).alias("var_len"))


@query("rollup_moments_compat")
def _(s, d):
    return rollup.moments(read_stats(s, d), tree(s, d), ["len"], True)


# Nations of region 0 and all suppliers have data; nations hide their suppliers.
@query("leaf_only_rollup", """, own as (select taxid, count(*) n from aln group by taxid union all select taxid, 5 from nodes where rank = 'family' and parent = 10),
reach as (select o.taxid, o.n, a.anc, a.dist from own o join a on a.taxid = o.taxid),
hid as (select r.taxid, min(x.dist) stop from own r join a x on x.taxid = r.taxid and x.dist > 0 join own y on y.taxid = x.anc group by r.taxid)
select anc taxid, cast(sum(n) as bigint) n from reach r left join hid on hid.taxid = r.taxid where stop is null or dist < stop group by anc""")  # fmt: skip
def _(s, d):
    own = alignments(s, d).groupBy("taxid").agg(F.count(F.lit(1)).alias("n")).unionByName(nodes(s, d).where("rank = 'family' and parent = 10").select("taxid", F.lit(5).cast("long").alias("n")))
    return rollup.leaf_only(own, tree(s, d), [], ["n"])


# Sequences.


@query("gc_content", "select id, round(case when length(seq) = 0 then 0 else (length(seq) - length(translate(seq, 'GC', ''))) / length(seq) end, 6) gc from sq", whole="sql")
def _(s, d, most=60):
    return sequences(s, d, most).select("id", r6(seq.gc("seq"), "gc"))


DUST = """, t as (select id, seq[i : i + 2] t from (select id, seq, unnest(range(1, length(seq) - 1)) i from sq)), c as (select id, t, count(*) c from t group by all),
du as (select id, cast(floor(0.5 + 200.0 * sum(c * (c - 1) / 2) / ((sum(c) - 1) * sum(c))) as integer) dust from c group by id)"""


def _dust(most: int | None) -> Column:
    """The fold holds up to 64 triplets; whole texts have more."""
    return seq.dust("seq") if most is None else seq.dust_short("seq")


@query("dust_score", f"{DUST} select id, dust from du", whole="rows")
def _(s, d, most=60):
    return sequences(s, d, most).select("id", seq.rounded(_dust(most)).alias("dust"))


@query("dust_filter", f"{DUST} select count(*) n from du where dust <= 4", whole="rows")
def _(s, d, most=60):
    return sequences(s, d, most).where(seq.rounded(_dust(most)) <= 4).agg(F.count(F.lit(1)).alias("n"))


@query("dust_any_length", f"{DUST} select id, dust from du", whole="rows")
def _(s, d, most=60):
    return sequences(s, d, most).select("id", seq.rounded(seq.dust("seq")).alias("dust"))


@query("revcomp", "select id, reverse(translate(seq, 'ACGT', 'TGCA')) rc from sq", whole="sql")
def _(s, d, most=60):
    return sequences(s, d, most).select("id", seq.revcomp("seq").alias("rc"))


@query("ani", "select qname, tid, aln_idx, round(1 - nm / len, 6) ani from aln")
def _(s, d):
    return alignments(s, d).select("qname", "tid", "aln_idx", r6(seq.ani("nm", "len"), "ani"))


@query("matched_bases", "select aln_idx, tid, cast(len - 7 + mapq as bigint) matched from aln")
def _(s, d):
    cigar = F.concat(F.lit("3S"), (F.col("len") - 7).cast("string"), F.lit("M2I1D"), F.col("mapq").cast("string"), F.lit("="))
    return alignments(s, d).select("aln_idx", "tid", seq.matched_bases(cigar).cast("long").alias("matched"))


@query("aligned_reference", "select id, ref from sq", whole="sql")
def _(s, d, most=60):
    # MD strings from read and reference: runs of equal bases between the mismatching reference bases.
    own = sequences(s, d, most)
    cells = F.zip_with(F.split("seq", ""), F.split("ref", ""), lambda a, b: F.when(a == b, F.lit("=")).otherwise(b))
    parts = F.regexp_extract_all(F.concat(F.array_join(cells, ""), F.lit("$")), F.lit("(=*)([A-Z$])"), F.lit(0))
    md = F.regexp_replace(F.array_join(F.transform(parts, lambda p: F.concat((F.length(p) - 1).cast("string"), F.substring(p, -1, 1))), ""), r"\$", "")
    return own.select("id", seq.reference()(F.col("seq"), F.concat(F.length("seq").cast("string"), F.lit("M")), md).alias("ref"))


@query("pmd_score", """, q as (select id, seq, ref, unnest(range(0, length(seq))) i from sq),
v as (select id, ref[i + 1] r, seq[i + 1] b, 0.01 + 0.3 * pow(0.7, case when ref[i + 1] = 'C' then i + 1 else length(seq) - i end) dz from q),
w as (select id, case when r in ('C', 'G') then case when b = r then ln(0.99 * (1 - dz) + 0.01 / 3 * dz) - ln(0.99) else ln(1 - (0.99 * (1 - dz) + 0.01 / 3 * dz)) - ln(0.01) end else 0 end x from v)
select id, round(sum(x), 5) pmd from w group by id""", whole="rows")  # fmt: skip
def _(s, d, most=60):
    return sequences(s, d, most).select("id", F.round(seq.pmd("seq", "ref"), 5).alias("pmd"))


# Damage.


@query("substitution_matrix", """select taxon, "end", pos, sub, cast(w as double) w from mm""", whole="sql")
def _(s, d, most=60):
    return counts(s, d, most)


@query("substitution_weighted", """, c as (select taxon, count(*) k from sq group by taxon) select m.taxon, "end", pos, sub, round(w / k, 6) w from mm m join c on c.taxon = m.taxon""", whole="sql")
def _(s, d, most=60):
    own = sequences(s, d, most)
    n = own.groupBy("taxon").agg(F.count(F.lit(1)).alias("k"))
    out = damage.substitutions(own.join(n, "taxon"), "taxon", L, F.lit(1.0) / F.col("k"))
    return out.withColumn("w", F.round("w", 6))


FREQ = """, fr as (select taxon, "end", pos, sub, w / sum(w) over (partition by taxon, "end", pos, sub[1:1]) f from mm), nr as (select taxon, count(*) nreads from sq group by taxon)"""


@query("misincorporation_rates", f"""{FREQ} select taxon, "end", pos, sub, round(f, 6) f from fr""", whole="sql")
def _(s, d, most=60):
    return damage.frequencies(counts(s, d, most), "taxon").select("taxon", "end", "pos", "sub", r6("f"))


@query("print_wide", f"""{FREQ} select taxon, "end", pos, {', '.join(f"round(coalesce(sum(f) filter (sub = '{x}'), 0), 6) \"{x}\"" for x in damage.SUBSTITUTIONS)} from fr group by taxon, "end", pos""", whole="sql")
def _(s, d, most=60):
    rows = damage.wide(damage.frequencies(counts(s, d, most), "taxon"), "taxon", "f")
    return rows.select("taxon", "end", "pos", *[r6(x) for x in damage.SUBSTITUTIONS])


@query("print_counts", f"""select taxon, "end", pos, {', '.join(f"cast(coalesce(sum(w) filter (sub = '{x}'), 0) as bigint) \"{x}\"" for x in damage.SUBSTITUTIONS)} from mm group by taxon, "end", pos""", whole="sql")
def _(s, d, most=60):
    return commands.printed_ugly(counts(s, d, most).withColumnRenamed("taxon", "id"), None).withColumnRenamed("taxid", "taxon")


def taxa(s: SparkSession, d: str, most: int | None = 60) -> tuple[DataFrame, DataFrame]:
    return counts(s, d, most).withColumnRenamed("taxon", "id"), sequences(s, d, most).groupBy(F.col("taxon").alias("id")).agg(F.count(F.lit(1)).alias("nreads"))


_CELLS = [f"""round(coalesce(sum(f) filter ("end" = '{e}' and sub = '{x}' and pos = {p}), 0), 6) {n}{p}""" for e, x, n in (("5p", "CT", "ct"), ("3p", "GA", "ga")) for p in range(L)]


@query("ct_ga_compact", f"""{FREQ} select fr.taxon id, nreads, {', '.join(_CELLS)} from fr join nr on nr.taxon = fr.taxon group by fr.taxon, nreads""", whole="sql")
def _(s, d, most=60):
    rows = commands.compact(*taxa(s, d, most), L)
    return rows.select("id", "nreads", *[r6(c) for c in rows.columns[2:]])


@query("print_all_vector", f"""{FREQ}, v as (select taxon, pos, coalesce(sum(f) filter ("end" = '5p' and sub = 'CT'), 0) ct, coalesce(sum(f) filter ("end" = '3p' and sub = 'GA'), 0) ga,
  coalesce(sum(f) filter (sub[1:1] <> sub[2:2]), 0) al from fr group by taxon, pos)
select v.taxon taxid, nreads, pos, round(ct * nreads, 5) ct, round(ga * nreads, 5) ga, round((al - ct - ga) / 10 * nreads, 5) other from v join nr on nr.taxon = v.taxon""", whole="sql")  # fmt: skip
def _(s, d, most=60):
    rows = commands.printed_all(*taxa(s, d, most), L)
    return rows.select("taxid", "nreads", "pos", *[F.round(c, 5).alias(c) for c in ("ct", "ga", "other")])


KN = """, kn as (select taxon, "end", pos, coalesce(sum(w) filter (sub = case when "end" = '5p' then 'CT' else 'GA' end), 0) k, coalesce(sum(w) filter (sub[1:1] = case when "end" = '5p' then 'C' else 'G' end), 0) n from mm group by taxon, "end", pos)"""


@query("kn_extract", f"""{KN} select taxon, "end", pos, cast(k as double) k, cast(n as double) n, round(case when n > 0 then k / n else 0 end, 6) f from kn""", whole="sql")
def _(s, d, most=60):
    return damage.kn(counts(s, d, most), "taxon").select("taxon", "end", "pos", "k", "n", r6("f"))


@query("rlens_hist_flat", "select tid, len rlen, count(*) cnt from aln group by all")
def _(s, d):
    return damage.lengths(alignments(s, d), "tid", F.col("len"))


@query("rlens_hist_sparse", "select tid id, tid || chr(9) || string_agg(len || ':' || c, chr(9) order by len) as value from (select tid, len, count(*) c from aln group by all) group by tid")
def _(s, d):
    from relictum.sources.tables import lengths_text

    return lengths_text(damage.lengths(alignments(s, d), "tid", F.col("len")).withColumnRenamed("tid", "id"))


@query("misincorporation_first", f"""{FREQ} select "end", pos, sub, round(f, 6) f from fr where taxon = (select min(taxon) from mm) and sub[1:1] <> sub[2:2]""", whole="sql")
def _(s, d, most=60):
    return damage.first_rates(counts(s, d, most), "taxon").select("end", "pos", "sub", r6("f"))


# Fits at fixed parameters, and fitted.

A, Q, C, PHI = 0.2, 0.3, 0.02, 50.0


@query("damage_curve", f"select pos, round({A} * pow(1 - {Q}, pos) + {C}, 6) dx from (select unnest(range(0, 15)) pos)")
def _(s, d):
    return s.range(15).select(F.col("id").alias("pos"), r6(seq.damage_curve(F.lit(A), F.lit(Q), F.lit(C), "id"), "dx"))


@query("betabinom_llh", f"""{KN}, z as (select taxon, k, n, ({A} * pow(1 - {Q}, pos) + {C}) * {PHI} al, (1 - ({A} * pow(1 - {Q}, pos) + {C})) * {PHI} be from kn)
select taxon taxid, round(sum(lgamma(n + 1) + lgamma(k + al) + lgamma(n - k + be) + lgamma(al + be) - lgamma(k + 1) - lgamma(n - k + 1) - lgamma(al) - lgamma(be) - lgamma(n + al + be)), 4) llh from z group by taxon""", whole="sql")  # fmt: skip
def _(s, d, most=60):
    rows = damage.kn_arrays(counts(s, d, most), "taxon", L)
    return rows.select("taxid", F.round(fits.llh_udf()(F.lit(A), F.lit(Q), F.lit(C), F.lit(PHI), "k", "n"), 4).alias("llh"))


@query("sigma_z", f"""{KN}, e as (select taxon, greatest(1, max(case when "end" = '5p' and pos = 0 then n end)) n0, greatest(1, sum(n * pow(1 - {Q}, 2 * pos))) ne from kn group by taxon)
select taxon taxid, round(sqrt({A} * (1 - {A}) * ({PHI} + n0) / (({PHI} + 1) * n0)), 6) sigma_old, round({A} / sqrt({A} * (1 - {A}) * ({PHI} + n0) / (({PHI} + 1) * n0)), 6) z_old,
round(sqrt({A} * (1 - {A}) * ({PHI} + ne) / (({PHI} + 1) * ne)), 6) sigma_new, round({A} / sqrt({A} * (1 - {A}) * ({PHI} + ne) / (({PHI} + 1) * ne)), 6) z_new from e""", whole="sql")  # fmt: skip
def _(s, d, most=60):
    kn = damage.kn_arrays(counts(s, d, most).withColumnRenamed("taxon", "taxid"), "taxid", L)
    rows = fits.spreads(kn, np.array([A, Q, C, PHI]))
    return rows.select("taxid", *[r6(c, n) for c, n in (("sigmaD_old", "sigma_old"), ("Zfit_old", "z_old"), ("sigmaD_new", "sigma_new"), ("Zfit_new", "z_new"))])


@query("dfit_params")
def _(s, d):
    return commands.dfit(counts(s, d, None).withColumnRenamed("taxon", "taxid"), positions=L, nopt=2)


@query("bootstrap_ci")
def _(s, d):
    return commands.dfit(counts(s, d, None).withColumnRenamed("taxon", "taxid"), positions=L, nopt=0, nbootstrap=8)


@query("regression_fit")
def _(s, d):
    return commands.regression(taxa(s, d, None)[0], 2)


# Selections.


@query("filter_ids_semi", "select tid id, count(*) nal from aln where tid % 4 = 1 group by tid")
def _(s, d):
    return select.by_ids(table(s, d), ids(s, d))


@query("filter_ids_anti", "select tid id, count(*) nal from aln where tid % 4 <> 1 group by tid")
def _(s, d):
    return select.by_ids(table(s, d), ids(s, d), exclude=True)


@query("min_max_reads", "select tid id, count(*) nal from aln group by tid having count(*) between 590 and 610")
def _(s, d):
    return select.by_ids(table(s, d), None, min_reads=590, max_reads=610)


def table(s: SparkSession, d: str) -> DataFrame:
    return alignments(s, d).groupBy(F.col("tid").alias("id")).agg(F.count(F.lit(1)).alias("nal"))


def ids(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "supplier").where("s_suppkey % 4 = 1").select(F.col("s_suppkey").alias("id"))


@query("filter_nodes", "select taxid id, count(*) nal from aln where taxid in (select taxid from a where anc in (11, 103)) group by taxid")
def _(s, d):
    own = alignments(s, d).groupBy(F.col("taxid").alias("id")).agg(F.count(F.lit(1)).alias("nal"))
    return commands.filter_damage({"matrices": own}, s.createDataFrame([(11,), (103,)], "id int"), tree(s, d))["matrices"]


@query("resolve_selectors", "select s_suppkey id from supplier where s_suppkey % 5 = 2")
def _(s, d):
    refs = read(s, d, "supplier").select(F.col("s_name").alias("rname"), F.col("s_suppkey").alias("tid"))
    return select.resolve(refs.where("tid % 5 = 2").select(F.col("rname").alias("label")), refs)


@query("extract_byread", "select qname, tid, aln_idx from aln where qname in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def _(s, d):
    return select.by_read(alignments(s, d), read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("qname"))).select("qname", "tid", "aln_idx")


@query("extract_byread_exclude", "select qname, tid, aln_idx from aln where qname not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def _(s, d):
    return select.by_read(alignments(s, d), read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("qname")), True).select("qname", "tid", "aln_idx")


@query("unmatched_reads", "select o_orderkey qname from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(s, d):
    return select.unmatched(read(s, d, "orders").select(F.col("o_orderkey").alias("qname")), alignments(s, d))


@query("extract_byref_strict", "select qname, tid, aln_idx from aln where tid in (3, 7)")
def _(s, d):
    return select.by_reference(alignments(s, d), s.createDataFrame([(3,), (7,)], "tid long")).select("qname", "tid", "aln_idx")


@query("extract_byref_group", "select qname, tid, aln_idx from aln where qname in (select qname from aln where tid in (3, 7))")
def _(s, d):
    return select.by_reference(alignments(s, d), s.createDataFrame([(3,), (7,)], "tid long"), False).select("qname", "tid", "aln_idx")


@query("extract_byref_exclude", "select qname, tid, aln_idx from aln where tid in (select s_suppkey from supplier where s_suppkey not in (3, 7))")
def _(s, d):
    refs = read(s, d, "supplier").select(F.col("s_suppkey").alias("tid"))
    return select.by_reference(alignments(s, d), select.references_not(refs, s.createDataFrame([(3,), (7,)], "tid long"))).select("qname", "tid", "aln_idx")


@query("extract_bytaxid", "select qname, tid, aln_idx from aln where qname in (select qname from aln where taxid in (select taxid from a where anc in (102, 1005)))")
def _(s, d):
    r = read(s, d, "supplier").select((F.col("s_suppkey") + 1000).cast("int").alias("taxid"), F.col("s_suppkey").alias("tid"))
    return commands.by_taxid(alignments(s, d).drop("taxid"), r, tree(s, d), s.createDataFrame([(102,), (1005,)], "taxid int")).select("qname", "tid", "aln_idx")


@query("taxon_names", "select taxid from nodes where name in ('ASIA', 'EUROPE')")
def _(s, d):
    return commands.taxids_of(s.createDataFrame([("ASIA",), ("EUROPE",)], "name string"), nodes(s, d).select("taxid", "name"))


@query("compress_refs", """, kept as (select * from aln where len >= 60), used as (select tid from kept union select mtid from kept), nw as (select tid, cast(row_number() over (order by tid) - 1 as integer) n from used where tid in (select s_suppkey from supplier))
select aln_idx, a1.n tid, coalesce(a2.n, -1) mtid from kept join nw a1 on a1.tid = kept.tid left join nw a2 on a2.tid = kept.mtid""")  # fmt: skip
def _(s, d):
    refs = read(s, d, "supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_name").alias("rname"))
    rows, _ = select.compressed(alignments(s, d).select("aln_idx", "tid", "mtid", "len"), refs, 60, F.col("len"))
    return rows.select("aln_idx", "tid", "mtid")


@query("reference_usage", "select tid, count(*) n from (select tid from aln union all select mtid from aln) group by tid")
def _(s, d):
    return select.reference_usage(alignments(s, d))


@query("merge_damage", """select taxon id, "end", pos, sub, cast(2 * w as double) w from mm""", whole="sql")
def _(s, d, most=60):
    own = taxa(s, d, most)[0]
    return select.merged([own, own], ["id", "end", "pos", "sub"], ["w"])


@query("aggregate_report", """, m as (select anc, count(*) nreads, avg(len) mean_len, var_samp(len) var_len from aln join a on a.taxid = aln.taxid group by anc)
select anc taxid, nreads, round(mean_len, 6) mean_len, round(var_len, 4) var_len, nreads nalign, name, rank, anc || ':"' || name || '":"' || rank || '"' lca from m join nodes on nodes.taxid = anc""")  # fmt: skip
def _(s, d):
    n = nodes(s, d)
    own = read_stats(s, d)
    out, _ = commands.aggregate(own, n.drop("name"), n.select("taxid", "name"), own.select("taxid", "nreads"))
    return out.select("taxid", "nreads", r6("mean_len"), F.round("var_len", 4).alias("var_len"), "nalign", "name", "rank", "lca")
