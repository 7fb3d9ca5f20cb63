"""Sums and moments moved up a taxonomy. tree: closure(taxid, anc, dist)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(rows: DataFrame, tree: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Sums over each node and all below it. Rows are summed by node before they meet the tree."""
    own = rows.groupBy("taxid", *by).agg(*[F.sum(s).alias(s) for s in sums])
    up = own.join(tree.select("taxid", "anc"), "taxid")
    return up.groupBy(F.col("anc").alias("taxid"), *by).agg(*[F.sum(s).alias(s) for s in sums])


def moments(stats: DataFrame, tree: DataFrame, names: list[str], compat: bool = False) -> DataFrame:
    """stats(taxid, nreads, mean_x, var_x ..) rolled up.

    Exact by default, from sums. compat folds pair by pair, own row first and then by taxid; there a side of one read
    leaves the other's variance as it is."""
    up = stats.join(tree.select("taxid", "anc"), "taxid")
    n = F.col("nreads").cast("double")
    if not compat:
        sums = []
        for x in names:
            m, v = F.col(f"mean_{x}"), F.col(f"var_{x}")
            sums += [F.sum(n * m).alias(f"s_{x}"), F.sum((n - 1) * v + n * m * m).alias(f"q_{x}")]
        own = up.groupBy(F.col("anc").alias("taxid")).agg(F.sum("nreads").alias("nreads"), *sums)
        out = []
        for x in names:
            mean = F.col(f"s_{x}") / F.col("nreads")
            out += [mean.alias(f"mean_{x}"), F.when(F.col("nreads") > 1, F.greatest(F.lit(0.0), F.col(f"q_{x}") - F.col("nreads") * mean * mean) / (F.col("nreads") - 1)).otherwise(0.0).alias(f"var_{x}")]
        return own.select("taxid", "nreads", *out)
    cells = [c for x in names for c in (f"mean_{x}", f"var_{x}")]
    row = F.struct((F.col("taxid") != F.col("anc")).alias("other"), "taxid", n.alias("n"), *[F.col(c).cast("double").alias(c) for c in cells])
    held = up.groupBy("anc").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def merge(a, b):
        total = a["n"] + b["n"]
        out = [total.alias("n")]
        for x in names:
            ma, va, mb, vb = a[f"mean_{x}"], a[f"var_{x}"], b[f"mean_{x}"], b[f"var_{x}"]
            both = ((b["n"] - 1) * vb + (a["n"] - 1) * va + b["n"] * a["n"] / total * (mb - ma) * (mb - ma)) / (total - 1)
            out += [((mb * b["n"] + ma * a["n"]) / total).alias(f"mean_{x}"), F.when((a["n"] > 1) & (b["n"] > 1), both).when(b["n"] > 1, vb).otherwise(va).alias(f"var_{x}")]
        return F.struct(*out)

    first = F.struct(F.col("rows")[0]["n"].alias("n"), *[F.col("rows")[0][c].alias(c) for c in cells])
    done = held.select("anc", F.aggregate(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), first, merge).alias("x"))
    return done.select(F.col("anc").alias("taxid"), F.col("x.n").cast("long").alias("nreads"), *[F.col(f"x.{c}").alias(c) for c in cells])


def leaf_only(rows: DataFrame, tree: DataFrame, by: list[str], sums: list[str], means: list[str] = (), weight: str = "nreads") -> DataFrame:
    """Like `counts`, but a node with data keeps its own and hides what lies below it. means: weighted by `weight`."""
    data = rows.select("taxid").distinct()
    # A node with data reaches an ancestor if none between them, and not the ancestor itself, has data.
    inner = tree.where("dist > 0").join(data.withColumnRenamed("taxid", "anc"), "anc", "left_semi")
    block = inner.groupBy("taxid").agg(F.min("dist").alias("stop"))
    reach = tree.join(data, "taxid", "left_semi").join(block, "taxid", "left").where("stop is null or dist < stop")
    up = rows.join(reach.select("taxid", "anc"), "taxid")
    w = F.col(weight)
    return up.groupBy(F.col("anc").alias("taxid"), *by).agg(*[F.sum(s).alias(s) for s in sums], *[(F.sum(w * F.col(m)) / F.sum(w)).alias(m) for m in means])
