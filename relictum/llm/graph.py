"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relictum.llm import shared


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def _star(sides: DataFrame, large: bool) -> DataFrame:
    """sides(u, v): neighbours v of u. Each u links the chosen neighbours to the smallest of them all.

    The minima are written out, so that the join below has plain exchanges on both sides and AQE can split a hub."""
    least = shared.table(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    rows = sides.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"), "u")
    rows = rows.where("a > u") if large else rows
    rows = rows.select("a", "b")
    if not large:
        rows = rows.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = shared.table(rows.where("a <> b").distinct(), "stars")
    shared.drop(least)
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long), undirected -> (node, root) for every node with an edge; root is the smallest node reachable.

    Each round's tables are removed once the next one's are written. Only the number and checksum of edges come to the driver. Self-links and nulls are ignored; no edges give no rows."""
    now = shared.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _sum(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True)
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        shared.drop(now, large)
        now = small
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
