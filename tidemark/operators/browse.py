"""The reader's view: keyword, section, category and time filters, counts, batches and bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import sections_of

# The time windows in days, the source of tools and the category of a row without any.
WINDOWS = {"today": 0, "week": 7, "half_month": 15, "month": 30, "quarter": 90, "half_year": 180}
TOOLS = "tools"
NO_CATEGORY = "announcement"


def keyword(title_form: Column, word_form: Column) -> Column:
    """The title, and only the title, holds the word. Both in NFKC lower case; an empty word matches all."""
    return (word_form == "") | F.contains(title_form, word_form)


def for_section(title: Column, audience: Column, section: str, names: dict[str, str]) -> Column:
    """The audience, or without one the title, names the section or all members. Matching forms."""
    return F.array_contains(sections_of(title, audience, names), section)


def categories(stored: Column) -> Column:
    """Category ids of array<struct<id, subtype>>: an old competition subtype counts as competition; none at all as an announcement."""
    ids = F.transform(stored, lambda c: F.when((c["id"] == "activity") & (c["subtype"] == "competition"), "competition").otherwise(c["id"]))
    return F.when(F.size(F.coalesce(ids, F.expr("CAST(array() AS array<string>)"))) > 0, F.array_distinct(ids)).otherwise(F.array(F.lit(NO_CATEGORY)))


def in_category(stored: Column, category: str) -> Column:
    return F.array_contains(categories(stored), category)


def in_window(day: Column, today: Column, window: str, is_tool: Column) -> Column:
    """A row of the last days; undated rows show under 'all' only, and tools are either of today or under 'all'."""
    if window == "all":
        return F.lit(True)
    days = WINDOWS[window]
    return F.when(is_tool, day == today if days == 0 else F.lit(False)).otherwise(day.between(F.date_sub(today, days), today)) & day.isNotNull()


def side_counts(rows: DataFrame, region: str, source: str, day: str, today: Column) -> DataFrame:
    """Counts of all, of each region and of each source in one rollup, with those new today and ``hot``."""
    out = rows.rollup(region, source).agg(F.count("*").alias("total"), F.count_if(F.col(day) == today).alias("new_today"), F.grouping_id().alias("level"))
    return out.withColumn("hot", F.col("new_today") > 0)


def exact_batch(rows: DataFrame, ids: DataFrame, key: str = "notice_id") -> DataFrame:
    """Just the rows of a message's ids, whatever the reader prefers."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def bookmarks(saved: DataFrame, rows: DataFrame, hidden: DataFrame, key: str = "notice_id", url: str = "url") -> DataFrame:
    """Saved rows with ``gone`` (no longer listed) and ``hidden``; none is dropped."""
    there = rows.select(key).distinct().withColumn("_there", F.lit(True))
    out = saved.join(there, key, "left").join(hidden.select(url).distinct().withColumn("_hidden", F.lit(True)), url, "left")
    return out.select(*saved.columns, F.col("_there").isNull().alias("gone"), F.col("_hidden").isNotNull().alias("hidden"))


def listed(rows: DataFrame, hidden: DataFrame, url: str = "url") -> DataFrame:
    return rows.join(hidden.select(url).distinct(), url, "left_anti")


def allowed(requests: DataFrame, urls: DataFrame, url: str = "url") -> DataFrame:
    """Requests for known addresses in raw, encoded or decoded spelling; all others fail."""
    spelled = urls.select(F.explode(F.array_distinct(F.array(F.col(url), F.try_url_decode(F.col(url)), F.replace(F.url_encode(F.col(url)), F.lit("%2F"), F.lit("/"))))).alias("_spelled")).distinct()
    return requests.join(spelled, F.col(url) == F.col("_spelled"), "left_semi")


def with_region(rows: DataFrame, regions: DataFrame, source: str = "source") -> DataFrame:
    """The first region, by its place, that lists the source. ``regions``: ord, region, sources."""
    flat = regions.select("ord", "region", F.explode("sources").alias(source)).groupBy(source).agg(F.min_by("region", "ord").alias("region"))
    return rows.join((flat), source, "left")


def store_kind(category: Column, page: Column) -> Column:
    """What a store row is: a page's own kind, else by its category."""
    return F.when(F.lower(page).isin("tools", "tool"), "tool").when(F.lower(page).isin("games", "game"), "game").when(F.lower(category).rlike("game|遊戲"), "game").otherwise("tool")


def valid_subscription(endpoint: Column, p256dh: Column, auth: Column, hosts: list[str]) -> Column:
    """Null if fine, else what is wrong: not https, host not allowed, or keys of a wrong length or alphabet."""
    host = F.lower(F.regexp_extract(endpoint, r"^https://([^/:?#]+)", 1))
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h) | host.endswith(f".{h}")
    return (
        F.when(~F.coalesce(endpoint.startswith("https://"), F.lit(False)), "endpoint").when(~known, "host")
        .when(~F.coalesce(p256dh.rlike(r"^[A-Za-z0-9_-]{80,100}=?$"), F.lit(False)), "p256dh").when(~F.coalesce(auth.rlike(r"^[A-Za-z0-9_-]{16,32}={0,2}$"), F.lit(False)), "auth")
    )
