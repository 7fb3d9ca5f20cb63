"""URL filters by a temporal list join (op5).

A list is a table of dated changes (domain, category, day, added). Each domain and category's changes become validity
intervals: from an addition up to the next change, or for ever. A capture is tried as of its fetch day against the
entries of its host and of every parent domain.

Captures are dealt by host suffix; the list is broadcast if it has at most BROADCAST rows (counted first), else both
sides are plain tables, whose join AQE can split at a hot host.

Defined results: a null or hostless url matches nothing and is not blocked; several changes of one day count as one, an
addition winning; repeated captures give a row each; a null fetch day matches nothing; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relictum.llm import shared

BROADCAST = 200_000
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """Lower-case host of an absolute url, without user, port and final dot; null if there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(place, "^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    return F.nullif(name, F.lit(""))


def intervals(changes: DataFrame) -> DataFrame:
    """domain, category, since, until (exclusive) of every addition that was in force."""
    day = changes.where("domain is not null and day is not null").groupBy(F.lower("domain").alias("domain"), "category", "day").agg(F.max(F.coalesce("added", F.lit(False))).alias("added"))
    order = Window.partitionBy("domain", "category").orderBy("day")
    day = day.withColumn("until", F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date")))
    return day.where("added").select("domain", "category", F.col("day").alias("since"), "until")


def matched(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures(url, fetched, ..) plus host, n_active, categories (sorted, comma-joined) and blocked."""
    entries = shared.table(intervals(changes), "intervals")
    few = entries.count() <= BROADCAST
    captures, back = shared.masked(captures, ["url", "fetched"], ["host", "n_active", "categories", "blocked"])
    names = captures.columns
    rows = captures.withColumn("host", host(F.col("url"))).withColumn("row_", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    rows = rows.withColumn("suffix_", F.explode_outer(F.when(F.col("host").isNotNull(), up)))
    if not few:
        rows = shared.table(rows, "suffixes")
    hit = rows.join(F.broadcast(entries) if few else entries, (rows["suffix_"] == entries["domain"]) & (rows["fetched"] >= entries["since"]) & (rows["fetched"] < entries["until"]), "left")
    out = hit.groupBy("row_").agg(*[F.first(c).alias(c) for c in [*names, "host"]], F.count("domain").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return out.select("url", "fetched", *back, "host", "n_active", "categories").withColumn("blocked", F.col("n_active") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch day and no list, so both follow from rules: a page is fetched on day page_id mod 365 of 2024; by
    the MD5 of its name a domain (each host, and its last two labels) is added, removed and added again on certain days."""
    pages = shared.read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))
    names = pages.select(host(F.col("url")).alias("h")).where("h is not null").distinct()
    names = names.select("h").unionByName(names.select(F.array_join(F.slice(F.split("h", r"\."), F.greatest(F.size(F.split("h", r"\.")) - 1, F.lit(1)), F.lit(2)), ".").alias("h"))).distinct()
    part = lambda i: F.conv(F.substring(F.md5("h"), i, 3), 16, 10).cast("int")
    dated = names.withColumn("a", part(1)).withColumn("b", part(4)).withColumn("c", part(7)).where("c % 3 <> 0")
    kinds = F.element_at(F.array(*map(F.lit, ("adult", "gambling", "malware", "spam"))), F.col("c") % 4 + 1)
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    first = F.col("a") % 300
    steps = F.array(
        F.struct(day(first).alias("day"), F.lit(True).alias("added")),
        F.struct(day(first + 1 + F.col("b") % 100).alias("day"), F.lit(False).alias("added")),
        F.struct(day(first + 101 + F.col("b") % 100).alias("day"), (F.col("b") % 2 == 0).alias("added")),
    )
    changes = dated.select(F.col("h").alias("domain"), kinds.alias("category"), F.explode(steps).alias("x")).select("domain", "category", "x.day", "x.added")
    return matched(captures, changes)


SQL = r"""
with p as (select page_id, url, date '2024-01-01' + cast(page_id % 365 as integer) fetched,
             nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')), '') host from pages),
h as (select distinct host h from p where host is not null),
n as (select h from h union select array_to_string(string_split(h, '.')[greatest(len(string_split(h, '.')) - 1, 1) :], '.') from h),
v as (select h, cast('0x' || md5(h)[1:3] as integer) a, cast('0x' || md5(h)[4:6] as integer) b, cast('0x' || md5(h)[7:9] as integer) c from n),
w as (select h, ['adult', 'gambling', 'malware', 'spam'][c % 4 + 1] category, date '2024-01-01' + a % 300 d1, date '2024-01-01' + (a % 300 + 1 + b % 100) d2,
        date '2024-01-01' + (a % 300 + 101 + b % 100) d3, b from v where c % 3 <> 0),
e as (select h, category, d1 since, d2 until from w union all select h, category, d3, date '9999-12-31' from w where b % 2 = 0),
s as (select page_id, url, fetched, host, unnest(case when host is null then [null] else list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) end) suffix from p)
select page_id, url, fetched, host, count(e.h) n_active, coalesce(string_agg(distinct category, ',' order by category), '') categories, count(e.h) > 0 blocked
from s left join e on suffix = e.h and fetched >= since and fetched < until group by page_id, url, fetched, host
"""
