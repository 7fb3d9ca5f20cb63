"""The commands: each takes and returns DataFrames; readers and writers stand in `sources`."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.functions import fit as fits
from relictum.functions import seq
from relictum.operators import damage, rollup, select
from relictum.operators import taxonomy as tax
from relictum.operators.filters import UNMAPPED, AlignmentFilter, best_as, first_reads


@dataclass
class Damage:
    """counts(id, end, pos, sub, w), nreads(id, nreads), lengths(id, rlen, cnt), stats."""

    counts: DataFrame
    nreads: DataFrame
    lengths: DataFrame
    stats: DataFrame

    def matrices(self, positions: int) -> DataFrame:
        return damage.arrays(self.counts, self.nreads, "id", positions)


def with_reference(rows: DataFrame, errors: str = "raise", compat: bool = True) -> DataFrame:
    """Adds ref. Rows whose CIGAR and MD do not give one are an error or dropped."""
    out = rows.withColumn("ref", seq.reference(compat)("seq", "cigar", "md"))
    if errors == "drop":
        return out.where("ref is not null")
    return out.withColumn("ref", F.coalesce("ref", F.raise_error(F.concat(F.lit("cannot rebuild the reference of "), F.col("qname"))).cast("string")))


def _counted(rows: DataFrame, positions: int, weight=None, min_qual: int = 0) -> Damage:
    rows = rows.withColumn("gc", seq.gc("seq"))
    stats = rows.groupBy("id").agg(F.count(F.lit(1)).alias("nreads"), *damage.moments("len", F.length("seq")), *damage.moments("gc", "gc"))
    return Damage(damage.substitutions(rows, "id", positions, weight, min_qual), stats.select("id", "nreads"), damage.lengths(rows, "id"), stats)


def getdamage(rows: DataFrame, run_mode: int = 0, positions: int = 5, where: AlignmentFilter = AlignmentFilter(min_length=35), best: bool = False, ref2tax: DataFrame | None = None, errors: str = "raise", compat: bool = True) -> Damage:
    """Damage of all alignments (run_mode 0), by reference (1) or by taxid (2, rows without one are left out)."""
    kept = rows.where(where.column(dust=seq.dust("seq") if where.max_dust is not None else None))
    if run_mode == 2:
        if ref2tax is None:
            raise ValueError("run_mode 2 needs ref2tax")
        kept = kept.join(ref2tax.select("tid", F.col("taxid").alias("id")), "tid")
    elif run_mode in (0, 1):
        kept = kept.withColumn("id", F.lit(0) if run_mode == 0 else F.col("tid"))
    else:
        raise ValueError("run_mode is 0, 1 or 2")
    return _counted(with_reference(best_as(kept) if best else kept, errors, compat), positions)


@dataclass
class Lca:
    reads: DataFrame
    stats: DataFrame
    damage: Damage
    used: DataFrame
    family: DataFrame
    missing: DataFrame
    species: DataFrame


def lca(rows: DataFrame, ref2tax: DataFrame, nodes: DataFrame, names: DataFrame, positions: int = 5, rank: str = "species", min_mapq: int = 0, min_length: int | None = None, low: float = 0.0, high: float = 1.0, min_edit: int | None = None, max_edit: int | None = None,
        discard: int = 516, fix_moved: bool = False, skip_no_rank: bool = True, no_rank_as_species: bool = False, weight_type: int = 0, max_reads: int | None = None, best: bool = False, max_dust: int | None = None, errors: str = "raise", compat: bool = True) -> Lca:
    """Lowest common ancestors of reads, statistics by ancestor, and damage keyed by the reference's own taxon.

    max_reads counts reads that have an alignment left after all filters. family holds the alignments left of reads whose
    ancestor is a family or below; species the number of reads whose references are all of one species. A sequence of length
    zero and an ancestor that the taxonomy does not know are errors."""
    gate = tax.level_of(rank, no_rank_as_species)
    if fix_moved:
        nodes, ref2tax = tax.moved_nodes(nodes, tax.MOVED), tax.moved(ref2tax, tax.MOVED)
    nodes = tax.without_clades(nodes)
    tree = tax.lineage(nodes, names)
    empty = F.raise_error(F.concat(F.lit("sequence of length zero: "), F.coalesce("qname", F.lit("")))).cast("string")
    # No read's name starts with @; the optimizer may ask this of header lines before they are left out.
    none = F.coalesce("seq", F.lit("")).isin("", "*") & ~F.coalesce("qname", F.lit("@")).startswith("@") & (F.col("qname") != "")
    own = rows.withColumn("seq", F.when(none, empty).otherwise(F.col("seq")))
    passed = own.where(AlignmentFilter(min_length=min_length, min_mapq=min_mapq, discard=discard, max_dust=max_dust).column(dust=seq.dust("seq") if max_dust is not None else None))
    opened = passed.groupBy("qname").agg(F.min_by(F.struct("seq", F.length("seq").alias("len"), seq.gc("seq").alias("gc")), "aln_idx").alias("o"))
    kept = passed.where(AlignmentFilter(min_edit=min_edit, max_edit=max_edit, min_ani=low, max_ani=high, no_failed=False).column())
    mapped = kept.join(ref2tax.select("tid", "taxid"), "tid", "left")
    missing = mapped.where("taxid is null").groupBy("tid", "rname").agg(F.count(F.lit(1)).alias("n"))
    mapped = mapped.where("taxid is not null").join(tree.select("taxid", "path", "species", "complete", F.get("ranks", F.lit(0)).alias("rank")), "taxid")
    if max_reads is not None:
        mapped = first_reads(mapped, max_reads)
    mapped = best_as(mapped) if best else mapped
    found = tax.lca(mapped, "qname", (F.count_distinct("species").alias("nspec"), F.min("species").alias("one_species"), F.min_by("seq", "aln_idx").alias("first_seq")))
    info = tree.select(F.col("taxid").alias("lca"), F.get("ranks", F.lit(0)).alias("lca_rank"), tax.lineage_string(F.col("path"), F.col("ranks"), F.col("names")).alias("taxa_path"))
    unknown = F.raise_error(F.concat(F.lit("no level for taxid "), F.col("lca").cast("string"))).cast("string")
    found = found.join(opened.select("qname", "o.*"), "qname").join(info, "lca", "left").withColumn("lca_rank", F.coalesce("lca_rank", unknown))
    found = found.withColumn("dust", seq.rounded(seq.dust("first_seq"))).withColumn("level", tax.level(F.col("lca_rank"), no_rank_as_species))
    reads = found.select("qname", "seq", "len", "naln", "nspec", F.col("dust").alias("dustscore"), "gc", F.substring_index("taxa_path", ";", 1).alias("lca_text"), "taxa_path", "lca", "lca_rank", "level")
    passing = found.where((F.col("level") != -1) & (F.col("level") <= gate))
    stats = passing.groupBy(F.col("lca").alias("taxid")).agg(F.count(F.lit(1)).alias("nreads"), *damage.moments("len", "len"), *damage.moments("gc", "gc"), *damage.moments("dust", "dust"), *damage.moments("nspec", "nspec"))
    counted = mapped.join(passing.select("qname", "naln"), "qname")
    if skip_no_rank:
        counted = counted.where("lower(rank) <> 'no rank'")
    weight = F.lit(1.0) / F.col("naln") if weight_type == 1 else F.lit(1.0)
    result = _counted(with_reference(counted.withColumn("id", F.col("taxid")), errors, compat), positions, weight, 13)
    near = mapped.join(found.where("level <> -1 and level <= 16").select("qname"), "qname", "left_semi")
    only = lambda some: rows.join(some.select("aln_idx"), "aln_idx", "left_semi")
    species = tax.unique_species(found, "one_species").join(names, "taxid", "left").select("taxid", "name", "nreads")
    return Lca(reads, stats, result, only(counted), only(near), missing, species)


def dfit(counts: DataFrame, tree: DataFrame | None = None, positions: int = 5, single_stranded: bool = False, **options) -> DataFrame:
    """Beta-binomial fits of counts(taxid, end, pos, sub, w), rolled up first if a closure is given."""
    if tree is not None:
        counts = rollup.counts(counts, tree, ["end", "pos", "sub"], ["w"])
    return fits.fit(damage.kn_arrays(counts, "taxid", positions, single_stranded), **options)


def aggregate(stats: DataFrame, nodes: DataFrame, names: DataFrame, nreads: DataFrame | None = None, lengths: DataFrame | None = None, fitted: DataFrame | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The report by taxon: rolled-up statistics with rolled-up numbers of alignments, lineage and fits; and rolled-up lengths."""
    tree, known = tax.closure(nodes), tax.lineage(nodes, names)
    measures = [c[5:] for c in stats.columns if c.startswith("mean_")]
    out = rollup.moments(stats, tree, measures, compat)
    if nreads is not None:
        out = out.join(rollup.counts(nreads, tree, [], ["nreads"]).withColumnRenamed("nreads", "nalign"), "taxid", "left").withColumn("nalign", F.coalesce("nalign", F.lit(-1)))
    if fitted is not None:
        out = out.join(fitted, "taxid", "left")
    text = tax.lineage_string(F.col("path"), F.col("ranks"), F.col("names"))
    info = known.select("taxid", F.when(F.get("names", F.lit(0)) != "", F.get("names", F.lit(0))).otherwise("<missing-name>").alias("name"), F.get("ranks", F.lit(0)).alias("rank"), F.substring_index(text, ";", 1).alias("lca"), text.alias("taxa_path"))
    out = out.where("nreads > 0").join(info, "taxid", "left")
    return out, rollup.counts(lengths, tree, ["rlen"], ["cnt"]) if lengths is not None else None


def printed(counts: DataFrame, nreads: DataFrame, positions: int = 15, only: int | None = None, as_counts: bool = False, held: int | None = None) -> DataFrame:
    """id, nreads, end, pos and a column for each substitution, as frequencies within a reference base or as counts.

    held: the positions that the counts have; asking for more is an error."""
    if held is not None and positions > held:
        raise ValueError(f"{positions} positions asked for, {held} there")
    own = counts.where(F.col("pos") < positions)
    own = own if only is None else own.where(F.col("id") == only)
    rows = damage.wide(own if as_counts else damage.frequencies(own, "id"), "id", "w" if as_counts else "f")
    return rows.join(nreads, "id").select("id", "nreads", "end", "pos", *damage.SUBSTITUTIONS)


def compact(counts: DataFrame, nreads: DataFrame, positions: int) -> DataFrame:
    """id, nreads, C>T at the 5' positions and G>A at the 3' positions."""
    freq = damage.frequencies(counts.where(F.col("pos") < positions), "id")
    pick = lambda e, s, p: F.coalesce(F.sum(F.when((F.col("end") == e) & (F.col("sub") == s) & (F.col("pos") == p), F.col("f"))), F.lit(0.0))
    cells = [pick("5p", "CT", p).alias(f"ct{p}") for p in range(positions)] + [pick("3p", "GA", p).alias(f"ga{p}") for p in range(positions)]
    return nreads.join(freq.groupBy("id").agg(*cells), "id", "left").fillna(0.0)


def printed_all(counts: DataFrame, nreads: DataFrame, positions: int, tree: DataFrame | None = None) -> DataFrame:
    """Vectors of C>T, G>A and other changes times reads; with a closure, rolled up leaf-only."""
    rows = damage.vector(damage.frequencies(counts, "id"), nreads, "id", positions).withColumnRenamed("id", "taxid")
    return rows if tree is None else rollup.leaf_only(rows, tree, ["pos"], ["nreads", "ct", "ga", "other"])


def printed_ugly(counts: DataFrame, nreads: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Counts of every substitution rounded half to even, rolled up if a closure is given."""
    own = counts.withColumnRenamed("id", "taxid")
    own = rollup.counts(own, tree, ["end", "pos", "sub"], ["w"]) if tree is not None else own
    wide = damage.wide(own, "taxid")
    return wide.select("taxid", "end", "pos", *[F.bround(s, 0).cast("long").alias(s) for s in damage.SUBSTITUTIONS])


def filter_damage(tables: dict[str, DataFrame], ids: DataFrame | None = None, tree: DataFrame | None = None, **bounds) -> dict[str, DataFrame]:
    """tables: matrices(id, nal, ..) and companions with id. Companions keep what the matrices keep."""
    if ids is not None and tree is not None:
        ids = tax.descendants(tree, ids.withColumnRenamed("id", "taxid")).withColumnRenamed("taxid", "id")
    kept = select.by_ids(tables["matrices"], ids, **bounds)
    return {name: kept if name == "matrices" else t.join(kept.select("id"), "id", "left_semi") for name, t in tables.items()}


def named(rows: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """rows with name in front, from names(taxid, name) or the references of a header; a key without a name is an error."""
    own = rows.join(names.select(F.col(names.columns[0]).alias(key), F.col("name").alias("name_")), key, "left")
    lost = F.raise_error(F.concat(F.lit("no name for "), F.col(key).cast("string"))).cast("string")
    return own.select(F.coalesce("name_", lost).alias("name"), *rows.columns)


def by_label(rows: DataFrame, kept: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """rows(label, ..) whose label stands for a kept id: a number, global for 0, or the name of a reference in refs(tid, rname)."""
    number = F.when(F.col("label").rlike(r"^[-+]?[0-9]+$"), F.col("label").try_cast("int"))
    own = rows.withColumn("id_", F.coalesce(number, F.when(F.col("label") == "global", F.lit(0))))
    if refs is not None:
        own = own.join(refs.select(F.col("rname").alias("label"), F.col("tid").alias("tid_")), "label", "left").withColumn("id_", F.coalesce("id_", "tid_")).drop("tid_")
    return own.join(kept.select(F.col("id").alias("id_")), "id_", "left_semi").select(*rows.columns)


def pmd(rows: DataFrame, mapped_only: bool = False, single_end: bool = True, min_mapq: int = -1, exact: bool = False, compat: bool = True) -> DataFrame:
    """qname, pmd of every alignment left."""
    keep = F.col("mapq") >= min_mapq
    if single_end:
        keep &= F.col("flag").bitwiseAND(1) == 0
    if mapped_only:
        keep &= F.col("flag").bitwiseAND(UNMAPPED) == 0
    own = with_reference(rows.where(keep), compat=compat)
    return own.select("qname", seq.pmd("seq", "ref", "qual", exact).alias("pmd"))


def by_taxid(rows: DataFrame, ref2tax: DataFrame, tree: DataFrame, taxids: DataFrame, more: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Alignments on references at or below the taxids, and on the references in more(tid)."""
    tids = tax.descendants(tree, taxids).join(ref2tax, "taxid").select("tid")
    return select.by_reference(rows, tids if more is None else tids.unionByName(more.select("tid")), strict)


def taxids_of(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """wanted(name) -> taxid; a name that is unknown or stands twice is an error."""
    found = wanted.join(names, "name", "left").groupBy("name").agg(F.count("taxid").alias("n"), F.min("taxid").alias("taxid"))
    return found.select(F.when(F.col("n") != 1, F.raise_error(F.concat(F.lit("name is not one taxon: "), F.col("name"))).cast("int")).otherwise(F.col("taxid")).alias("taxid"))


def merge_damage(parts: list[Damage]) -> Damage:
    stats = select.merged([p.nreads for p in parts], ["id"], ["nreads"])
    return Damage(select.merged([p.counts for p in parts], ["id", "end", "pos", "sub"], ["w"]), stats, select.merged([p.lengths for p in parts], ["id", "rlen"], ["cnt"]), stats)


def regression(counts: DataFrame, order: int = 6) -> DataFrame:
    """counts(id, end, pos, sub, w) -> multinomial-logit fitted share of each read base, by reference base and end."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot_table(index="pos", columns=frame["sub"].str[1], values="w", aggfunc="sum", fill_value=0.0).reindex(columns=list("ACGT"), fill_value=0.0)
        x = table.index.to_numpy(float)
        n = min(order, len(x) - 1)
        basis = np.vander(x / max(1.0, x.max()), n + 1, increasing=True)
        p = fits.softmax(basis @ fits.softmax_fit(x, table.to_numpy(), n))
        out = pd.DataFrame(p, columns=list("ACGT"))
        out.insert(0, "pos", table.index.astype("int32"))
        for c in ("refbase", "end", "id"):
            out.insert(0, c, frame[c].iloc[0])
        return out

    own = counts.withColumn("refbase", F.substring("sub", 1, 1))
    return own.groupBy("id", "end", "refbase").applyInPandas(run, "id long, end string, refbase string, pos int, A double, C double, G double, T double")


#: By model: whether the 3' end is folded onto the 5' end, and whether a reference base has a regression of its own.
MODELS = {0: (False, False), 1: (False, True), 2: (True, False), 3: (True, True)}
REGRESSION = "id long, end string, refbase string, pos int, sub string, f double, f_linear double, llh double, llh_linear double"


def regressions(counts: DataFrame, model: int = 1, order: int = 4) -> DataFrame:
    """counts(id, end, pos, sub, w) -> fitted shares of the substitutions by position, and log-likelihoods, of the multinomial and
    of the linear fit. model 0: all 16 substitutions, each end by itself; 1: within each reference base; 2 and 3: the same with
    the 3' end folded onto the 5' end by complement."""
    import pandas as pd

    if model not in MODELS:
        raise ValueError("model is 0, 1, 2 or 3")
    folded, conditional = MODELS[model]
    turned = F.when(F.col("end") == "3p", F.translate("sub", "ACGT", "TGCA")).otherwise(F.col("sub"))
    own = counts.select("id", "end", "pos", (turned if folded else F.col("sub")).alias("sub"), "w")
    own = own.withColumn("refbase", F.substring("sub", 1, 1) if conditional else F.lit("N")).withColumn("group_", F.lit("both") if folded else F.col("end"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        base = frame["refbase"].iloc[0]
        classes = [base + x for x in "ACGT"] if conditional else damage.SUBSTITUTIONS
        table = frame.pivot_table(index=["end", "pos"], columns="sub", values="w", aggfunc="sum", fill_value=0.0).reindex(columns=classes, fill_value=0.0)
        x = table.index.get_level_values("pos").to_numpy(float) + 1
        plain, best, beta = fits.logit_fits(x, table.to_numpy(), min(order, len(set(x)) - 1))
        out = pd.DataFrame({"pos": np.repeat(x - 1, len(classes)).astype("int32"), "sub": classes * len(x), "f": best.ravel(), "f_linear": plain.ravel()})
        out.insert(0, "refbase", base)
        out.insert(0, "end", table.index.get_level_values("end").repeat(len(classes)) if folded else frame["group_"].iloc[0])
        out.insert(0, "id", frame["id"].iloc[0])
        log = lambda p: float((table.to_numpy() * np.log(np.maximum(p, 1e-300))).sum())
        return out.assign(llh=log(best), llh_linear=log(plain))

    return own.groupBy("id", "group_", "refbase").applyInPandas(run, REGRESSION)
