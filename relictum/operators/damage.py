"""Counts of substitutions by position, read statistics, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBSTITUTIONS = [a + b for a in "ACGT" for b in "ACGT"]


def substitutions(rows: DataFrame, key: str, positions: int = 5, weight: Column | None = None, min_qual: int = 0) -> DataFrame:
    """rows(key, seq, ref, flag[, qual]) -> key, end, pos, sub, w. ref: the reference base under each read base, else '.'.

    Only the `positions` bases at both ends are unfolded. Reverse reads are complemented and turned round."""
    seq, ref = F.upper("seq"), F.upper("ref")
    n, reverse = F.length(seq), F.col("flag").bitwiseAND(16) > 0
    flip = lambda b: F.when(reverse, F.translate(b, "ACGT", "TGCA")).otherwise(b)
    near = F.sequence(F.lit(0), F.least(F.lit(positions), n) - 1)

    def cells(end: str, from_left: Column):
        def one(p):
            i = F.when(from_left, p).otherwise(n - 1 - p)
            good = F.get("qual", i) >= min_qual if min_qual else F.lit(True)
            return F.struct(F.lit(end).alias("end"), p.alias("pos"), flip(F.concat(F.substring(ref, i + 1, 1), F.substring(seq, i + 1, 1))).alias("sub"), good.alias("good"))

        return F.transform(near, one)

    cell = F.explode(F.concat(cells("5p", ~reverse), cells("3p", reverse)))
    flat = rows.where(n > 0).select(key, (F.lit(1.0) if weight is None else weight).alias("w_"), cell.alias("x"))
    flat = flat.where("x.good and x.sub rlike '^[ACGT][ACGT]$'")
    return flat.groupBy(key, F.col("x.end").alias("end"), F.col("x.pos").alias("pos"), F.col("x.sub").alias("sub")).agg(F.sum("w_").alias("w"))


def frequencies(counts: DataFrame, key: str) -> DataFrame:
    """w as a share of its reference base's row."""
    row = Window.partitionBy(key, "end", "pos", F.substring("sub", 1, 1))
    return counts.withColumn("f", F.col("w") / F.sum("w").over(row))


def wide(counts: DataFrame, key: str, value: str = "w") -> DataFrame:
    """One column for each substitution; missing cells are 0."""
    return counts.groupBy(key, "end", "pos").agg(*[F.coalesce(F.sum(F.when(F.col("sub") == s, F.col(value))), F.lit(0.0)).alias(s) for s in SUBSTITUTIONS])


def arrays(counts: DataFrame, nreads: DataFrame, key: str, positions: int) -> DataFrame:
    """key, nal, fw, bw: 16 cells for each position, as the exchange file holds them."""
    place = F.when(F.col("end") == "3p", 16 * positions).otherwise(0) + 16 * F.col("pos") + 4 * (F.instr(F.lit("ACGT"), F.substring("sub", 1, 1)) - 1) + F.instr(F.lit("ACGT"), F.substring("sub", 2, 1)) - 1
    own = counts.where((F.col("pos") >= 0) & (F.col("pos") < positions) & F.col("end").isin("5p", "3p")).select(key, place.cast("int").alias("i_"), "w")
    cells = laid_out(own.groupBy(key, "i_").agg(F.sum("w").alias("w")), key, ["w"], 32 * positions)
    matrices = cells.select(key, F.slice("w", 1, 16 * positions).alias("fw"), F.slice("w", 16 * positions + 1, 16 * positions).alias("bw"))
    none = F.array_repeat(F.lit(0.0), 16 * positions)
    return nreads.join(matrices, key, "left").select(F.col(key).alias("id"), F.col("nreads").alias("nal"), F.coalesce("fw", none).alias("fw"), F.coalesce("bw", none).alias("bw"))


def laid_out(rows: DataFrame, key: str, values: list[str], n: int) -> DataFrame:
    """rows(key, i_, values), one for each key and i_ -> key and for each value an array over i_ from 0 to n - 1, 0 where there is no row."""
    held = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i_", F.struct(*values)))).alias("m_"))
    cell = lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m_", i)[v].cast("double"), F.lit(0.0)))
    return held.select(key, *[cell(v).alias(v) for v in values])


def unfolded(matrices: DataFrame) -> DataFrame:
    """The reverse of `arrays`: id, end, pos, sub, w of non-zero cells."""
    subs = F.array(*map(F.lit, SUBSTITUTIONS))
    both = [matrices.select("id", F.lit(end).alias("end"), F.posexplode(c).alias("i", "w")) for end, c in (("5p", "fw"), ("3p", "bw"))]
    rows = both[0].unionByName(both[1]).where("w <> 0")
    return rows.select("id", "end", (F.col("i") / 16).cast("int").alias("pos"), F.get(subs, F.col("i") % 16).alias("sub"), "w")


def lengths(rows: DataFrame, key: str, length: Column | None = None) -> DataFrame:
    """key, rlen, cnt."""
    return rows.groupBy(key, (F.length("seq") if length is None else length).alias("rlen")).agg(F.count(F.lit(1)).alias("cnt"))


def moments(name: str, value: Column | str) -> list[Column]:
    """Mean and sample variance (0 for a single value)."""
    return [F.avg(value).alias(f"mean_{name}"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias(f"var_{name}")]


def vector(freq: DataFrame, nreads: DataFrame, key: str, positions: int) -> DataFrame:
    """key, nreads, pos, ct, ga, other: rates times the number of reads; other is a tenth of all other changes at both ends."""
    changed = F.substring("sub", 1, 1) != F.substring("sub", 2, 1)
    pick = lambda end, sub: F.coalesce(F.sum(F.when((F.col("end") == end) & (F.col("sub") == sub), F.col("f"))), F.lit(0.0))
    own = freq.where(F.col("pos") < positions).groupBy(key, "pos").agg(pick("5p", "CT").alias("ct"), pick("3p", "GA").alias("ga"), F.coalesce(F.sum(F.when(changed, F.col("f"))), F.lit(0.0)).alias("all_"))
    return own.join(nreads, key).select(key, "nreads", "pos", (F.col("ct") * F.col("nreads")).alias("ct"), (F.col("ga") * F.col("nreads")).alias("ga"), ((F.col("all_") - F.col("ct") - F.col("ga")) / 10 * F.col("nreads")).alias("other"))


def kn(counts: DataFrame, key: str, single_stranded: bool = False) -> DataFrame:
    """key, end, pos, k, n, f: C>T among C at the 5' end; at the 3' end G>A among G, or C>T again for single-stranded libraries."""
    three = "C" if single_stranded else "G"
    hit = F.when(F.col("end") == "5p", F.col("sub") == "CT").otherwise(F.col("sub") == ("CT" if single_stranded else "GA"))
    base = F.when(F.col("end") == "5p", F.col("sub").startswith("C")).otherwise(F.col("sub").startswith(three))
    out = counts.groupBy(key, "end", "pos").agg(F.coalesce(F.sum(F.when(hit, F.col("w"))), F.lit(0.0)).alias("k"), F.coalesce(F.sum(F.when(base, F.col("w"))), F.lit(0.0)).alias("n"), F.sum("w").alias("total"))
    return out.withColumn("f", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0))


def kn_arrays(counts: DataFrame, key: str, positions: int, single_stranded: bool = False) -> DataFrame:
    """taxid, k, n, total as arrays over 5' then 3' positions."""
    long = kn(counts, key, single_stranded).where((F.col("pos") >= 0) & (F.col("pos") < positions))
    place = (F.when(F.col("end") == "3p", positions).otherwise(0) + F.col("pos")).cast("int")
    return laid_out(long.select(F.col(key).alias("taxid"), place.alias("i_"), "k", "n", "total"), "taxid", ["k", "n", "total"], 2 * positions)


def first_rates(counts: DataFrame, key: str) -> DataFrame:
    """end, pos, sub, f: the rates of the smallest key's misincorporations."""
    first = counts.agg(F.min(key).alias(key))
    rows = frequencies(counts.join(first, key, "left_semi"), key)
    return rows.where("substring(sub, 1, 1) <> substring(sub, 2, 1)").select("end", "pos", "sub", "f")
