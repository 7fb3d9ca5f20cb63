"""Benchmark decontamination by test n-grams (op3 and the pipeline's fourth stage). DataFrame functions only.

Every window of an item (10 words, or the whole item if shorter) of m words holds, wherever it stands in a document, one
block of b = (m + 1) // 2 words that starts at a multiple of b. So a document is scanned at every b-th word only: the
block's hash is looked up in a bitmap of fixed size, hits then in the broadcast hash set of the items' blocks, and
what is left is verified word by word. The set is broadcast up to BROADCAST bytes, summed first; beyond that the same
join is left to Spark, which then shuffles. Documents are never shuffled, only their hits and counts.

Defined results: a null text has no words; items without words are no windows; equal item_ids count once; repeated rows of documents give a row each;
extra columns are ignored; an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import shared

N = 10
#: Bytes of the items' block table (words, item ids and 64 a row besides) up to which it is broadcast.
BROADCAST = 64 << 20
#: 64-bit cells of the bitmap.
CELLS = 1 << 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), GAP), lambda w: w != "")


def block(m: int) -> int:
    return (m + 1) // 2


def block_hash(m, ws: Column, at: Column, b) -> Column:
    return F.xxhash64(F.lit(m) if isinstance(m, int) else m, F.slice(ws, at + 1, b))


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """m, win (its words), items (sorted ids as text) of every distinct window."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("m", F.least(F.lit(n), F.size("w")))
    rows = rows.select("item", "m", F.explode(F.transform(F.expr("sequence(0, size(w) - m)"), lambda i: F.slice(F.col("w"), i + 1, F.col("m")))).alias("win"))
    return rows.groupBy("m", "win").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """docs plus row_, n_words and, for each verified hit, at, m and items; documents without a hit have one row of nulls."""
    wins = windows(items, n)
    b = F.expr("(m + 1) div 2").cast("int")
    grams = wins.select("m", "win", "items", F.explode(F.expr("sequence(0, m - cast((m + 1) div 2 as int))")).alias("off")).withColumn("h", block_hash(F.col("m"), F.col("win"), F.col("off"), b))
    grams = shared.table(grams, "grams")
    lengths = sorted(r[0] for r in grams.select("m").distinct().collect())  # at most n
    cells = [0] * CELLS
    slot = (F.pmod("h", F.lit(CELLS)).alias("cell"), F.shiftrightunsigned("h", 58).cast("int").alias("bit"))
    for cell, bit in grams.select(*slot).distinct().collect():  # at most 64 * CELLS
        cells[cell] |= 1 << bit
    size = F.sum(F.lit(64) + F.octet_length(F.concat_ws(" ", "win")) + F.octet_length(F.concat_ws(",", "items")))
    few = (grams.agg(size).first()[0] or 0) <= BROADCAST
    bitmap = F.split(F.lit(",".join(str(x - (x >> 63 << 64)) for x in cells)), ",").cast("array<bigint>")
    known = lambda h: F.getbit(F.get(bitmap, F.pmod(h, F.lit(CELLS)).cast("int")), F.shiftrightunsigned(h, 58).cast("int")) == 1

    rows = docs.withColumn("row_", F.monotonically_increasing_id()).withColumn("w", words(F.col("text")))

    def scan(m: int) -> Column:
        """Blocks of windows of m words whose slot is set, each with the words around it."""
        step = block(m)
        at = F.when(F.size("w") >= step, F.sequence(F.lit(0), F.size("w") - step, F.lit(step))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(at, lambda i: F.struct(i.alias("i"), block_hash(m, F.col("w"), i, step).alias("h")))
        likely = F.filter(blocks, lambda x: known(x["h"]))
        low = lambda x: F.greatest(x["i"] - (m - step), F.lit(0))
        return F.transform(likely, lambda x: F.struct(F.lit(m).alias("m"), x["h"].alias("h"), x["i"].alias("i"), low(x).alias("low"), F.slice(F.col("w"), low(x) + 1, F.lit(2 * m)).alias("near")))

    found = [scan(m) for m in lengths]
    none = F.array().cast("array<struct<m:int,h:bigint,i:int,low:int,near:array<string>>>")
    rows = rows.select(*[c for c in docs.columns if c != "text"], "row_", F.size("w").alias("n_words"), (F.concat(*found) if found else none).alias("found"))
    rows = rows.withColumn("x", F.explode_outer("found")).drop("found")
    names = [c for c in rows.columns if c != "x"]
    rows = rows.select(*names, *[F.col(f"x.{c}").alias(c) for c in ("m", "h", "i", "low", "near")])
    joined = rows.join(F.broadcast(grams) if few else grams, ["m", "h"], "left").withColumn("at", F.col("i") - F.col("off"))
    true = F.coalesce((F.col("at") >= 0) & (F.slice("near", F.greatest(F.col("at") - F.col("low") + 1, F.lit(1)), F.col("m")) == F.col("win")), F.lit(False))
    return joined.select(*names, *[F.when(true, F.col(c)).alias(c) for c in ("at", "m", "items")])


def report(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """One row for each document: its other columns, n_words, n_hit, n_items, items_sha256, contaminated."""
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs, back = shared.masked(docs, ["text"], made)
    others = [c for c in docs.columns if c != "text"]
    rows = hits(docs, items, n).groupBy("row_").agg(
        *[F.first(c).alias(c) for c in [*others, "n_words"]],
        F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "m")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["at"] + x["m"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["at"] + x["m"] - F.greatest(a["end"], x["at"]))).alias("n")),
    )["n"]
    return rows.select(*back, F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "found"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """The operator: documents without a hit, with the same columns."""
    rid = shared.free(docs, "rid_")
    keyed = docs.withColumn(rid, shared.row_id())
    dirty = hits(keyed.select(F.col(rid).alias("id_"), "text"), items, n).where("at is not null").select(F.col("id_").alias(rid)).distinct()
    return keyed.join(shared.table(dirty, "dirty"), rid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(shared.read(spark, sf_dir, "documents").select("doc_id", "text"), shared.read(spark, sf_dir, "benchmark"))


SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item, least({N}, len(w)) m, array_to_string(w[i : i + least({N}, len(w)) - 1], ' ') win
       from (select item, w, unnest(range(1, len(w) - least({N}, len(w)) + 2)) i from b where len(w) > 0)),
dw as (select doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') win
       from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from d, (select distinct m from bw) where len(w) >= m)),
h as (select doc_id, i, dw.m m, item from dw join bw on dw.win = bw.win and dw.m = bw.m),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + m)) p from h) group by doc_id),
t as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c on d.doc_id = c.doc_id left join t on d.doc_id = t.doc_id
"""
