"""Hierarchy operators on nodes(taxid, parent, rank); the root is its own parent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the ranks, from the highest; fixed values.
LEVELS = {
    "superkingdom": 36, "domain": 37, "lineage": 35, "kingdom": 34, "subkingdom": 33, "superphylum": 32, "phylum": 31, "subphylum": 30,
    "superclass": 29, "class": 28, "subclass": 27, "infraclass": 26, "clade": 25, "cohort": 24, "subcohort": 23, "superorder": 22,
    "order": 21, "suborder": 20, "infraorder": 19, "parvorder": 18, "superfamily": 17, "family": 16, "subfamily": 15, "tribe": 14,
    "subtribe": 13, "infratribe": 12, "genus": 11, "subgenus": 10, "section": 9, "series": 8, "subseries": 7, "subsection": 6,
    "species": 5, "species group": 4, "species subgroup": 3, "subspecies": 2, "varietas": 1, "morph": 1, "subvariety": 1, "forma": 1,
    "forma specialis": 1, "biotype": 1, "genotype": 1, "isolate": 1, "pathogroup": 1, "serogroup": 1, "serotype": 1, "strain": 1,
}
#: Outdated taxids and what they became; fixed values.
MOVED = {
    1649555: 1333996, 1401172: 1333996, 1582271: 1582270, 374764: 1914213, 242716: 1917265, 1793725: 1915309, 292451: 263865, 38298: 2801,
    63403: 1916091, 67357: 285450, 163247: 1762941, 328623: 1916091, 356150: 157727, 502130: 1932322, 545877: 376133, 996989: 1762939,
    996990: 1762946, 1086724: 430531, 1169024: 1169025, 1576640: 1247960, 1769757: 1769758, 1802981: 1708715, 1811974: 1708715, 1955118: 1925741,
}


def level_of(rank: str, no_rank_as_species: bool = False) -> int:
    if no_rank_as_species and rank == "no rank":
        return LEVELS["species"]
    if rank not in LEVELS:
        raise ValueError(f"unknown rank: {rank}")
    return LEVELS[rank]


def level(rank: Column, no_rank_as_species: bool = False) -> Column:
    """A rank's level; -1 if unknown."""
    known = LEVELS | ({"no rank": LEVELS["species"]} if no_rank_as_species else {})
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, rank), F.lit(-1))


def closure(nodes: DataFrame) -> DataFrame:
    """(taxid, anc, dist) of every node with itself and all its ancestors, by a recursive query."""
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        """with recursive a(taxid, anc, dist) as (
             select taxid, taxid, 0 from {nodes}
             union all
             select a.taxid, n.parent, a.dist + 1 from a join {nodes} n on a.anc = n.taxid where n.parent <> n.taxid)
           select * from a""",
        nodes=nodes.select("taxid", "parent"),
    )


def lineage(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """taxid, path (root first), ranks and names (self first), depth, species, complete: whether the path ends at a root."""
    named = nodes.join(names, "taxid", "left") if names is not None else nodes.withColumn("name", F.lit(None).cast("string"))
    up = closure(nodes).join(named.select(F.col("taxid").alias("anc"), "parent", "rank", "name"), "anc", "left")
    rows = up.groupBy("taxid").agg(F.array_sort(F.collect_list(F.struct("dist", "anc", "rank", "name", (F.col("anc") == F.col("parent")).alias("top")))).alias("up"))
    species = F.filter("up", lambda x: x["rank"] == "species")
    return rows.select(
        "taxid",
        F.reverse(F.transform("up", lambda x: x["anc"])).alias("path"),
        F.transform("up", lambda x: F.coalesce(x["rank"], F.lit(""))).alias("ranks"),
        F.transform("up", lambda x: F.coalesce(x["name"], F.lit(""))).alias("names"),
        (F.size("up") - 1).alias("depth"),
        F.coalesce(F.get(species, F.lit(0))["anc"], F.element_at("up", -1)["anc"]).alias("species"),
        F.coalesce(F.element_at("up", -1)["top"], F.lit(False)).alias("complete"),
    )


def without_clades(nodes: DataFrame) -> DataFrame:
    """Rank clade becomes the rank of the nearest ancestor that is none."""
    up = closure(nodes).join(nodes.select(F.col("taxid").alias("anc"), "rank"), "anc").where("rank <> 'clade'")
    near = up.groupBy("taxid").agg(F.min_by("rank", "dist").alias("near"))
    return nodes.join(near, "taxid", "left").select("taxid", "parent", F.when(F.col("rank") == "clade", F.coalesce("near", "rank")).otherwise(F.col("rank")).alias("rank"))


def moved(rows: DataFrame, pairs: dict[int, int], columns: tuple[str, ...] = ("taxid",)) -> DataFrame:
    """Taxids that moved get their new number."""
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return reduce(lambda df, c: df.withColumn(c, F.coalesce(F.try_element_at(table, F.col(c)), F.col(c))), columns, rows)


def moved_nodes(nodes: DataFrame, pairs: dict[int, int]) -> DataFrame:
    """nodes with moved taxids and parents renumbered; of two nodes that end at one taxid, the one that had it before stays."""
    old = nodes.withColumn("old_", F.col("taxid"))
    new = moved(old, pairs, ("taxid", "parent"))
    others = [c for c in nodes.columns if c != "taxid"]
    rows = new.groupBy("taxid").agg(F.min_by(F.struct(*others), F.struct(F.col("old_") != F.col("taxid"), "old_")).alias("x"))
    return rows.select("taxid", *[f"x.{c}" for c in others]).select(*nodes.columns)


def lca(rows: DataFrame, read: str = "qname", more: tuple[Column, ...] = ()) -> DataFrame:
    """rows(read, path, complete) -> lca of each read: the last node that the smallest and the largest path share.

    Both are plain aggregates, so reads are combined before the one shuffle. A read of several rows with a broken path is
    dropped; a single row keeps its own taxid whatever its path."""
    own = rows.groupBy(read).agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count(F.lit(1)).alias("naln"), F.bool_and("complete").alias("whole"), *more)
    same = F.aggregate(F.sequence(F.lit(0), F.least(F.size("low"), F.size("high")) - 1), F.lit(0), lambda a, i: F.when((a == i) & (F.get("low", i) == F.get("high", i)), a + 1).otherwise(a))
    out = own.withColumn("same_", same).where("(whole or naln = 1) and same_ > 0")
    return out.withColumn("lca", F.get("low", F.col("same_") - 1)).drop("low", "high", "same_", "whole")


def unique_species(reads: DataFrame, species: str) -> DataFrame:
    """taxid, nreads: reads(nspec, species) whose references are all of one species, counted by it."""
    return reads.where("nspec = 1").groupBy(F.col(species).alias("taxid")).agg(F.count(F.lit(1)).alias("nreads"))


def descendants(tree: DataFrame, seeds: DataFrame) -> DataFrame:
    """tree: closure. seeds(taxid) -> taxid of the seeds and all below."""
    return tree.join(seeds.select(F.col("taxid").alias("anc")).distinct(), "anc", "left_semi").select("taxid").distinct()


def lineage_string(path: Column, ranks: Column, names: Column) -> Column:
    """self;..;root, each as taxid:"name":"rank"."""
    up = F.reverse(path)
    return F.array_join(F.transform(up, lambda t, i: F.concat(t.cast("string"), F.lit(':"'), F.get(names, i), F.lit('":"'), F.get(ranks, i), F.lit('"'))), ";")
