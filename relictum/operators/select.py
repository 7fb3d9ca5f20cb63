"""Subsets of tables by ids, reads and references, and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_ids(rows: DataFrame, ids: DataFrame | None, exclude: bool = False, min_reads: int | None = None, max_reads: int | None = None, key: str = "id", nreads: str = "nal") -> DataFrame:
    """Rows whose key is in ids(key) (not in them, if exclude), with bounds on the number of reads. No ids: all."""
    if ids is not None:
        rows = rows.join(ids.select(key).distinct(), key, "left_anti" if exclude else "left_semi")
    if min_reads is not None:
        rows = rows.where(F.col(nreads) >= min_reads)
    if max_reads is not None:
        rows = rows.where(F.col(nreads) <= max_reads)
    return rows


def resolve(labels: DataFrame, refs: DataFrame, accessions: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """labels(label) -> id: of reference names, which accessions(label, id) override. strict: an unknown label is an error."""
    known = refs.select(F.col("rname").alias("label"), F.col("tid").cast("long").alias("id"), F.lit(0).alias("order_"))
    if accessions is not None:
        known = known.unionByName(accessions.select("label", F.col("id").cast("long").alias("id"), F.lit(1).alias("order_")))
    known = known.groupBy("label").agg(F.max_by("id", "order_").alias("id"))
    found = labels.distinct().join(known, "label", "left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("cannot resolve "), F.col("label"))).cast("long")
        return found.select(F.when(F.col("id").isNull(), unknown).otherwise(F.col("id")).alias("id")).distinct()
    return found.where("id is not null").select("id").distinct()


def by_read(rows: DataFrame, reads: DataFrame, exclude: bool = False) -> DataFrame:
    return rows.join(reads.select("qname").distinct(), "qname", "left_anti" if exclude else "left_semi")


def unmatched(reads: DataFrame, rows: DataFrame) -> DataFrame:
    """Names asked for that no row has."""
    return reads.select("qname").distinct().join(rows.select("qname").distinct(), "qname", "left_anti")


def by_reference(rows: DataFrame, tids: DataFrame, strict: bool = True) -> DataFrame:
    """strict: rows on these references. Otherwise all rows of a read with one of them."""
    hit = rows.join(tids.select("tid").distinct(), "tid", "left_semi")
    return hit if strict else rows.join(hit.select("qname").distinct(), "qname", "left_semi")


def references_not(refs: DataFrame, listed: DataFrame) -> DataFrame:
    return refs.join(listed.select("tid").distinct(), "tid", "left_anti").select("tid")


def compressed(rows: DataFrame, refs: DataFrame, min_match: int = 30, matched=None) -> tuple[DataFrame, DataFrame]:
    """Rows that match enough, and the references they (or their mates) use, numbered anew without gaps."""
    from relictum.functions.seq import matched_bases

    kept = rows.where((F.col("tid") >= 0) & ((matched_bases("cigar") if matched is None else matched) >= min_match))
    used = kept.select("tid").unionByName(kept.select(F.col("mtid").alias("tid"))).where("tid >= 0").distinct()
    # Headers are small (one row a reference), so numbering them in one task is bounded by the header.
    new = refs.join(used, "tid", "left_semi").withColumn("new_tid", (F.row_number().over(Window.orderBy("tid")) - 1).cast("int"))
    table = new.select("tid", "new_tid")
    out = kept.join(table, "tid").withColumn("tid", F.col("new_tid")).drop("new_tid")
    mates = table.select(F.col("tid").alias("mtid"), F.col("new_tid").alias("new_mtid"))
    out = out.join(mates, "mtid", "left").withColumn("mtid", F.coalesce("new_mtid", F.lit(-1))).drop("new_mtid")
    return out, new.drop("tid").withColumnRenamed("new_tid", "tid")


def merged(tables: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """Several tables of counts as one: a union and sums."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def reference_usage(rows: DataFrame) -> DataFrame:
    """tid, n: how often a reference is an alignment's own or its mate's."""
    return rows.select(F.explode(F.array("tid", "mtid")).alias("tid")).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
