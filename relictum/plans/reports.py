"""Result tables in their text layouts, companions of count files, and the single-matrix fit with its summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.functions import fit as fits
from relictum.operators import damage

SUFFIX = ".bdamage"


def _f(c: str | Column) -> Column:
    return F.format_string("%f", F.col(c) if isinstance(c, str) else c)


def write_lines(rows: DataFrame, path: str, order: list[str], head: list[str] = (), compression: str = "gzip") -> None:
    """rows(value, and the columns of order) as text in that order, after the lines of head."""
    keys = [F.col(c).alias(f"o{i}_") for i, c in enumerate(order)]
    own = rows.select(F.lit(1).alias("part_"), *keys, "value")
    if head:
        top = rows.sparkSession.createDataFrame([("\n".join(head),)], "value string").select(F.lit(0).alias("part_"), *[F.lit(None).cast(own.schema[f"o{i}_"].dataType).alias(f"o{i}_") for i in range(len(order))], "value")
        own = top.unionByName(own)
    own.orderBy("part_", *[f"o{i}_" for i in range(len(order))]).select("value").write.option("compression", compression).text(path)


LCA_HEAD = "queryid\tseq\tlen\tnaln\tnspec\tdustscore\tgc\tlca\ttaxa_path"


def lca_lines(reads: DataFrame) -> DataFrame:
    """(qname, value) of the per-read table: numbers plain, GC with six decimals, the ancestor, then its lineage."""
    text = [F.col(c).cast("string") for c in ("len", "naln", "nspec", "dustscore")]
    return reads.select("qname", F.concat_ws("\t", "qname", "seq", *text, _f("gc"), "lca_text", "taxa_path").alias("value"))


LCA_STATS_HEAD = "taxid\tnreads\tmean_len\tvar_len\tmean_gc\tvar_gc\tmean_dust\tvar_dust\tmean_nspec\tvar_nspec\tlca\trank"


def lca_stats_lines(stats: DataFrame, names: DataFrame) -> DataFrame:
    """(taxid, value) of the statistics by ancestor. names(taxid, name, rank)."""
    cells = [_f(f"{m}_{x}") for x in ("len", "gc", "dust", "nspec") for m in ("mean", "var")]
    quoted = [F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')) for c in ("name", "rank")]
    return stats.join(names.select("taxid", "name", "rank"), "taxid", "left").select("taxid", F.concat_ws("\t", F.col("taxid").cast("string"), F.col("nreads").cast("string"), *cells, *quoted).alias("value"))


STATS_HEAD = "taxid\tnreads\tmean_len\tvar_len\tmean_gc\tvar_gc\tlca\trank"


def stats_lines(stats: DataFrame, run_mode: int = 0, refs: DataFrame | None = None) -> DataFrame:
    """(id, value) of damage statistics(id, nreads, mean and var of len and gc). The key is global in run mode 0, the reference's
    name from refs(tid, rname) in mode 1 and the taxid in mode 2; ancestor and rank are not known there (NA)."""
    cells = [_f(f"{m}_{x}") for x in ("len", "gc") for m in ("mean", "var")]
    if run_mode == 1:
        lost = F.raise_error(F.concat(F.lit("no reference "), F.col("id").cast("string"))).cast("string")
        stats = stats.join(refs.select(F.col("tid").alias("id"), "rname"), "id", "left").withColumn("shown_", F.coalesce("rname", lost))
    else:
        stats = stats.withColumn("shown_", F.lit("global") if run_mode == 0 else F.col("id").cast("string"))
    return stats.select("id", F.concat_ws("\t", "shown_", F.col("nreads").cast("string"), *cells, F.lit("NA"), F.lit("NA")).alias("value"))


def fit_table(fitted: DataFrame, positions: int, showfits: int = 0) -> DataFrame:
    """The fits as one column a value. showfits 0: parameters; 1: also the curve and its deviation at each position of both ends;
    2: also the counts and frequencies. Missing deviations and frequencies are 0. With bootstraps, their means and intervals."""
    if showfits not in (0, 1, 2):
        raise ValueError("showfits is 0, 1 or 2")
    names = "taxid A q c phi llh ncall sigmaD_old Zfit_old sigmaD_new Zfit_new".split()
    if "A_b" in fitted.columns:
        names += [f"{n}_b" for n in fits.NAMES] + [f"{n}_CI_{x}" for n in fits.NAMES for x in "lh"]
    # By showfits: heading after fw or bw, the array it comes from, and whether a missing value is 0.
    kinds = {0: (), 1: (("dx", "dx", False), ("dxConf", "dx_conf", True)), 2: (("K", "K", False), ("N", "N", False), ("f", "f", True), ("dx", "dx", False), ("dxConf", "dx_conf", True))}[showfits]
    cells = []
    for end, shift in (("fw", 0), ("bw", positions)):
        for i in range(positions):
            for head, array, filled in kinds:
                value = F.get(F.col(array), F.lit(shift + i))
                cells.append((F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)) if filled else value).alias(f"{end}{head}{i}"))
    return fitted.select(*names, *cells)


def bootstrap_table(fitted: DataFrame) -> DataFrame:
    """taxid, run, A, q, c, phi: a row for each bootstrap run."""
    n = len(fits.NAMES)
    runs = F.transform(F.sequence(F.lit(0), (F.size("boot") / n).cast("int") - 1), lambda i: F.struct(i.alias("run"), *[F.get("boot", i * n + k).alias(c) for k, c in enumerate(fits.NAMES)]))
    return fitted.where("size(boot) > 0").select("taxid", F.explode(runs).alias("x")).select("taxid", "x.*")


def companion_names(path: str) -> dict[str, list[str]]:
    """Where the statistics and lengths of a count file may lie, by its name; nothing for a name of another kind."""
    for end in (f"{SUFFIX}.gz", SUFFIX):
        if path.endswith(end):
            base = path.removesuffix(end)
            return {kind: [f"{base}.{kind}.gz", f"{base}.{kind}"] for kind in ("stat", "rlens")}
    return {}


def companions(spark: SparkSession, path: str, **given: str) -> dict[str, str]:
    """The companions that exist, the first of each kind's names, looked for through Spark's own file systems; given ones win."""
    out = dict(given)
    for kind, names in companion_names(path).items():
        for name in names if kind not in out else ():
            at = spark._jvm.org.apache.hadoop.fs.Path(name)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                out[kind] = name
                break
    return out


def read_mismatches(spark: SparkSession, path: str) -> DataFrame:
    """(label, end, pos, and a column for each substitution) of a mismatch table in text: a header, then key, 5' or 3',
    position and 16 numbers a line, parted by tabs or spaces."""
    v = F.split(F.trim("value"), r"[\t ]+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(v.alias("v")).where("size(v) >= 19 and v[1] in (\"5'\", \"3'\")")
    cells = [F.col("v")[3 + i].try_cast("double").alias(s) for i, s in enumerate(damage.SUBSTITUTIONS)]
    return rows.select(F.col("v")[0].alias("label"), F.when(F.col("v")[1] == "5'", "5p").otherwise("3p").alias("end"), F.col("v")[2].try_cast("int").alias("pos"), *cells)


def single_counts(rows: DataFrame) -> DataFrame:
    """One matrix of read_mismatches as (end, pos, k, n): C>T of C at the 5' end, G>A of G at the 3' end. Two keys are an error."""
    two = F.raise_error(F.lit("the file holds more than one key")).cast("string")
    keys = rows.agg(F.min("label").alias("low"), F.max("label").alias("high")).select(F.when(F.col("low") != F.col("high"), two).otherwise(F.col("low")).alias("label"))
    five = F.col("end") == "5p"
    total = lambda b: sum((F.col(f"{b}{x}") for x in "CGT"), F.col(f"{b}A"))
    return rows.join(keys, "label").select("end", "pos", F.when(five, F.col("CT")).otherwise(F.col("GA")).alias("k"), F.when(five, total("C")).otherwise(total("G")).alias("n"))


def summaries(rows: DataFrame) -> DataFrame:
    """By label, of the counts of read_mismatches: sums of k and n in all and at either end, smallest and largest n, n at the
    outermost positions, and the arrays of k, n and f by position at either end. A rate of no bases is null."""
    five = F.col("end") == "5p"
    total = lambda b: sum((F.col(f"{b}{x}") for x in "CGT"), F.col(f"{b}A"))
    own = rows.select("label", "end", F.abs("pos").alias("pos"), F.when(five, F.col("CT")).otherwise(F.col("GA")).alias("k"), F.when(five, total("C")).otherwise(total("G")).alias("n"))
    at = lambda e, c: F.coalesce(F.sum(F.when((F.col("end") == e), F.col(c))), F.lit(0.0)).cast("long")
    cells = lambda e: F.array_sort(F.collect_list(F.when(F.col("end") == e, F.struct("pos", "k", "n"))))
    out = own.groupBy("label").agg(
        F.sum("n").cast("long").alias("n_sum"), at("5p", "n").alias("n_sum_fwd"), at("3p", "n").alias("n_sum_rev"), F.min("n").cast("long").alias("n_min"), F.max("n").cast("long").alias("n_max"),
        F.sum("k").cast("long").alias("k_sum"), at("5p", "k").alias("k_sum_fwd"), at("3p", "k").alias("k_sum_rev"), cells("5p").alias("fwd"), cells("3p").alias("rev"),
    )
    field = lambda c: lambda x: x[c]
    parts = [F.transform(end, field(c)).alias(f"{c}_{end}") for end in ("fwd", "rev") for c in ("k", "n")]
    rates = [F.transform(end, lambda x: F.try_divide(x["k"], x["n"])).alias(f"f_{end}") for end in ("fwd", "rev")]
    first = [F.get(end, F.lit(0))["n"].cast("long").alias(f"n_first_{end}") for end in ("fwd", "rev")]
    return out.select("label", *first, *[c for c in out.columns if c not in ("label", "fwd", "rev")], *parts, *rates)


#: Bounds of A, q, c and phi of the single-matrix fit.
MAP_LOW, MAP_HIGH = np.array([1e-8, 1e-8, 1e-8, 2.0]), np.array([1 - 1e-8, 1 - 1e-8, 1 - 1e-8, 1e5])
#: Priors of A, q and c: mean and weight of a beta distribution; of phi: least value and scale of an exponential one.
PRIORS = {"A": (0.1, 10.0), "q": (0.2, 5.0), "c": (0.1, 10.0), "phi": (2.0, 1000.0)}


def log_prior(p: np.ndarray) -> float:
    """Log density of the priors at (A, q, c, phi)."""
    out = 0.0
    for x, name in zip(p[:3], ("A", "q", "c"), strict=True):
        mean, weight = PRIORS[name]
        a, b = mean * weight, (1 - mean) * weight
        out += (a - 1) * math.log(x) + (b - 1) * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    low, scale = PRIORS["phi"]
    return out - (p[3] - low) / scale - math.log(scale) if p[3] >= low else -math.inf


def map_row(x: np.ndarray, k: np.ndarray, n: np.ndarray, priors: bool = False) -> dict:
    """Fit of one matrix: parameters, log-likelihood (with the priors' density, if asked for), deviation of A at the first
    position's n, significance, and the curve and its normalised deviation at each position."""

    def bounded(y):
        return MAP_LOW + (MAP_HIGH - MAP_LOW) / (1 + np.exp(-np.clip(y, -36, 36)))

    def cost(y):
        p = bounded(y)
        return -fits.log_likelihood(p, x, k, n) - (log_prior(p) if priors else 0.0)

    u = (fits.START - MAP_LOW) / (MAP_HIGH - MAP_LOW)
    y, low, _ = fits.minimise(cost, np.log(u / (1 - u)))
    p = bounded(y)
    a, q, c, phi = p
    first = max(1.0, float(n[0]))
    std = math.sqrt(a * (1 - a) * (phi + first) / ((phi + 1) * first))
    got = fits.spread(p, x, n)
    return {**dict(zip(fits.NAMES, map(float, p))), "llh": -low, "std": std, "significance": a / std, "dx": got["dx"].tolist(), "dx_std": np.nan_to_num(got["dx_conf"]).tolist()}


MAP_SCHEMA = "label string, A double, q double, c double, phi double, llh double, std double, significance double, dx array<double>, dx_std array<double>"


def map_fit(rows: DataFrame, priors: bool = False) -> DataFrame:
    """One fit for each label of summaries(..): 5' positions outwards, then 3' positions, x the distance from the end."""

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                k, n = (np.concatenate([np.asarray(v, float) for v in pair]) for pair in ((r.k_fwd, r.k_rev), (r.n_fwd, r.n_rev)))
                x = np.concatenate([np.arange(len(r.k_fwd)), np.arange(len(r.k_rev))])
                out.append({"label": r.label, **map_row(x, k, n, priors)})
            yield pd.DataFrame(out, columns=[f.split()[0] for f in MAP_SCHEMA.split(", ")])

    return rows.select("label", "k_fwd", "k_rev", "n_fwd", "n_rev").repartition("label").mapInPandas(run, MAP_SCHEMA)
