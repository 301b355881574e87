"""Aggregates: freshness, junk, coverage, consistency, funnel and subscription reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Freshness buckets with the most days of each, junk titles and their shapes, and the funnel's events.
BUCKETS = (("today", 0), ("7 days", 7), ("14 days", 14), ("1 month", 30), ("3 months", 90), ("older", None))
JUNK_TITLES = ("", "untitled", "home", "test", "n/a", "link", "here", "主頁", "首頁", "連結", "按此")
CATEGORY_LISTING = r"^(?i:category|categories|tag|archive|分類|類別)\b.*$"
EVENTS = ("panel_open", "permission_prompt", "permission_granted", "permission_denied", "subscribed", "updated", "unsubscribed", "push_shown", "push_clicked", "results_open", "install_prompt", "installed", "error")
STALE_DAYS = 90


def bucket(age: Column) -> Column:
    """The freshness bucket of an age in days; a missing age is in the last."""
    out = F.when(age.isNull(), BUCKETS[-1][0])
    for name, most in BUCKETS[:-1]:
        out = out.when(age <= most, name)
    return out.otherwise(BUCKETS[-1][0])


def ages(rows: DataFrame, source: str, day: Column, today: Column) -> DataFrame:
    """(source, n, latest, age_days, bucket)."""
    out = rows.groupBy(source).agg(F.count("*").alias("n"), F.max(day).alias("latest"))
    return out.withColumn("age_days", F.datediff(today, "latest")).withColumn("bucket", bucket(F.col("age_days")))


def freshness(rows: DataFrame, source: str, day: Column, today: Column) -> DataFrame:
    """(bucket, sources) for every bucket, zeros too: six exclusive buckets that leave no source out."""
    counted = ages(rows, source, day, today).groupBy("bucket").agg(F.count("*").alias("sources"))
    names = rows.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(b) for b, _ in BUCKETS])).alias("ord", "bucket"))
    return names.join(F.broadcast(counted), "bucket", "left").select("bucket", "ord", F.coalesce("sources", F.lit(0)).cast("long").alias("sources"))


def stale(rows: DataFrame, source: str, day: Column, today: Column, days: int = STALE_DAYS) -> DataFrame:
    """Sources without a row for more than ``days`` days, or without any day."""
    return ages(rows, source, day, today).where(F.col("age_days").isNull() | (F.col("age_days") > days))


def is_junk(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    return F.lower(t).isin(*JUNK_TITLES) | t.rlike(CATEGORY_LISTING) | t.rlike(r"^\d{1,4}$")


def junk_report(rows: DataFrame, source: str, junk: Column, sample: str, samples: int = 3) -> DataFrame:
    """Sources with junk that is half of their rows, or any if they have at most three; with the first samples.

    Samples come from a bounded two-step ranking, never from a list of all junk.
    """
    marked = rows.select(source, junk.alias("_junk"), sample)
    found = marked.groupBy(source).agg(F.count("*").alias("n"), F.count_if("_junk").alias("junk"))
    found = found.where((F.col("junk") > 0) & ((F.col("junk") / F.col("n") >= 0.5) | (F.col("n") <= 3)))
    top = marked.where("_junk").withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(sample))).where(F.col("_rn") <= samples)
    lists = top.groupBy(source).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    return found.join(lists, source).withColumn("ratio", F.round(F.col("junk") / F.col("n"), 3))


def counts_where(**conditions: Column) -> list[Column]:
    """COUNT(*) FILTER (WHERE ...) by name, over as many conditions as wanted in one pass."""
    return [F.count_if(c).alias(name) for name, c in conditions.items()]


def unnest_counts(rows: DataFrame, values: str, name: str, n: str = "n") -> DataFrame:
    """Rows per array element, each row once an element."""
    return rows.select(F.explode(F.array_distinct(values)).alias(name)).groupBy(name).agg(F.count("*").alias(n))


def funnel(counters: DataFrame, views: str = "panel_open", done: str = "subscribed") -> DataFrame:
    """One row: views, completions and their rate in per cent to one place, 0 without views. ``counters``: event, count."""
    total = lambda e: F.coalesce(F.sum(F.when(F.col("event") == e, F.col("count"))), F.lit(0))
    out = counters.agg(total(views).alias("views"), total(done).alias("done"))
    return out.withColumn("rate", F.when(F.col("views") > 0, F.round(F.col("done") * 100.0 / F.col("views"), 1)).otherwise(F.lit(0.0)))


def add_counters(table: DataFrame, events: DataFrame, vocabulary: Sequence[str] = EVENTS) -> DataFrame:
    """Daily counters after new events (day, event): known events only, names cut to 40 characters."""
    known = events.where(F.col("event").isin(*vocabulary)).select("day", F.substring("event", 1, 40).alias("event"), F.lit(1).cast("long").alias("count"))
    return table.select("day", "event", "count").unionByName(known).groupBy("day", "event").agg(F.sum("count").alias("count"))


def retained(table: DataFrame, today: Column, days: int) -> DataFrame:
    return table.where(F.col("day") >= F.date_sub(today, days))


def inconsistent(rows: DataFrame, key: Sequence[str], source: str, signature: str) -> DataFrame:
    """Groups seen in at least two sources whose signatures differ or are missing in part."""
    grouped = rows.groupBy(*key).agg(F.count_distinct(source).alias("sources"), F.count_distinct(signature).alias("signatures"), F.count_if(F.col(signature).isNull()).alias("missing"))
    return grouped.where((F.col("sources") >= 2) & ((F.col("signatures") > 1) | (F.col("missing") > 0)))


def divergent_mirrors(rows: DataFrame, canonical: str, url: str, categories: str) -> DataFrame:
    """Canonical addresses with at least two spellings whose category sets differ; rows without categories don't count."""
    signed = rows.where(F.col(categories).isNotNull()).select(canonical, url, F.array_join(F.array_sort(F.array_distinct(categories)), ",").alias("_sig"))
    grouped = signed.groupBy(canonical).agg(F.count_distinct(url).alias("urls"), F.count_distinct("_sig").alias("variants"))
    return grouped.where("urls >= 2 AND variants > 1")


def coverage(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row: rows, the share in per cent of each field that is there, and of rows with any field."""
    there = {f: F.coalesce(F.trim(F.col(f).cast("string")) != "", F.lit(False)) for f in fields}
    some = F.lit(False)
    for c in there.values():
        some = some | c
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c) * F.lit(100.0), F.count("*")), F.lit(0.0)), 1)
    return rows.agg(F.count("*").alias("rows"), *[share(c).alias(f"{f}_pct") for f, c in there.items()], share(some).alias("any_pct"))


def source_health(results: DataFrame, source: str = "source") -> DataFrame:
    """``results`` (source, fetched boolean, assets) with status: FETCH_FAIL, EMPTY or OK."""
    return results.withColumn("status", F.when(~F.coalesce(F.col("fetched"), F.lit(False)), "FETCH_FAIL").when(F.coalesce(F.col("assets"), F.lit(0)) == 0, "EMPTY").otherwise("OK"))


def duplicate_titles(rows: DataFrame, source: str, title: str, url: str) -> DataFrame:
    """(source, title, urls): one title for several addresses in a source."""
    return rows.groupBy(source, title).agg(F.count_distinct(url).alias("urls")).where("urls > 1")
