"""Quality rules with adaptive thresholds (op9 and the pipeline's first stage). DataFrame functions only.

Each document gets a few ratios. KLL quantile sketches of every ratio are built for each language and source, and merged
into sketches for each language and for all. A group of at least ENOUGH documents uses its own sketch, else its
language's, else that of all. A ratio is out if it lies beyond the upper quartile by STEPS times the spread between the
quartiles, or by the ratio's least spread where that is larger, so that a clean group does not lose its tail.

Defined results: null or blank text has no words and fails the base rules; null lang or source are groups of their own;
repeated rows give a row each; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relictum.llm import shared

SYMBOLS = "#*$%&|<>"
#: Least number of words, most words in repeated windows (percent), words in a window.
LEAST, REPEAT, WINDOW = 10, 20, 5
#: Documents that a group needs for thresholds of its own; steps beyond the upper quartile; size of a sketch.
ENOUGH, STEPS, SKETCH = 200, 6.0, 200
#: Least room above the upper quartile, by ratio.
ROOM = {"symbols": 0.2, "marks": 0.5, "lines": 0.3, "repeats": 0.15, "length": 4.0}

MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_lines", *ROOM, *(f"most_{r}" for r in ROOM), "base_failed", "kept"]


def counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source, ..) without text, plus the base counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda chars: sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in others],
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("l"),
        gone(SYMBOLS).cast("long").alias("n_symbols"),
        gone("!?").cast("long").alias("n_marks"),
    )
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("h", F.transform(starts, lambda i: F.xxhash64(F.slice(F.col("w"), i + 1, WINDOW))))
    rows = rows.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    return rows.select(
        *[F.col(f"`{c}`") for c in others],
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered(F.col("h"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_marks",
        F.size("l").cast("long").alias("n_lines"),
    )


def covered(h: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in h. Equal hashes are neighbours once sorted, so one fold
    keeps, of each window, its place in the text if its hash equals the one before or after it."""
    order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs = F.zip_with(F.slice(order, F.lit(1), F.size(order) - 1), F.slice(order, F.lit(2), F.size(order) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"))
    return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step)["n"]


def ratios(rows: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return rows.select(
        "*",
        (F.col("n_symbols") / words).alias("symbols"),
        (F.col("n_marks") / words).alias("marks"),
        (F.col("n_dup_lines") / lines).alias("lines"),
        (F.col("n_repeat_words") / words).alias("repeats"),
        (F.col("word_chars") / words).alias("length"),
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """lang, source -> most_<ratio>. One row for each group; sketches only travel, never values."""
    sketch = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH)).alias(r) for r in ROOM])
    sketch = shared.table(sketch, "sketches")
    merged = lambda df: df.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r).alias(r) for r in ROOM])
    by_lang = merged(sketch.groupBy("lang")).select("lang", F.struct("n", *ROOM).alias("b"))
    every = merged(sketch).select(F.struct("n", *ROOM).alias("c"))
    wide = sketch.select("lang", "source", F.struct("n", *ROOM).alias("a"))
    wide = wide.join(by_lang.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_")), "left").withColumn("c", every.scalar())
    use = F.when(F.col("a.n") >= ENOUGH, F.col("a")).when(F.col("b.n") >= ENOUGH, F.col("b")).otherwise(F.col("c"))
    wide = wide.select("lang", "source", use.alias("u"))

    def most(r: str) -> Column:
        low, high = (F.kll_sketch_get_quantile_double(F.col("u")[r], F.lit(q)) for q in (0.25, 0.75))
        return (high + F.greatest(F.lit(ROOM[r]), (high - low) * STEPS)).alias(f"most_{r}")

    return wide.select("lang", "source", *[most(r) for r in ROOM])


def judged(docs: DataFrame) -> DataFrame:
    """docs without text, plus counts, ratios, thresholds, base_failed and kept."""
    docs, back = shared.masked(docs, ["text", "lang", "source"], MADE)
    rows = shared.table(ratios(counts(docs)), "counts")
    limits = shared.table(thresholds(rows), "limits").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left").drop("lang_", "source_")
    failed = (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > REPEAT * F.col("n_words"))
    fine = F.lit(True)
    for r in ROOM:
        fine = fine & (F.col(r) <= F.col(f"most_{r}"))
    joined = joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(True)))
    return joined.select(*back, "lang", "source", *MADE)


def keep(docs: DataFrame) -> DataFrame:
    """The operator: the documents kept, with the same columns."""
    rid = shared.free(docs, "rid_")
    keyed = docs.withColumn(rid, shared.row_id())
    good = judged(keyed.select(F.col(rid).alias("id_"), "text", "lang", "source")).where("kept").select(F.col("id_").alias(rid)).distinct()
    return keyed.join(shared.table(good, "kept"), rid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
