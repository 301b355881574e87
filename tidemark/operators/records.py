"""Records between their forms: normalised rows, entries, payloads, metadata, story items, catalogs; and their fixed orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

# Optional fields of a record, the date of a story without one, and source types whose pages hold articles.
OPTIONAL = ("published_date", "backfilled_at", "suppress_notifications")
NO_DATE = "9999-99-99"
ARTICLE_TYPES = ("article", "generic_article")
STORY_FIELDS = ("title", "date", "source_site", "region", "category", "url", "deadline", "audience", "fee")
NONE = "CAST(array() AS array<string>)"


def text_of(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def normalised(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Raw records (source_site, region, pdf_url, title, captured_date, the optional ones, tags) with no null in the five main fields; a
    record without a region takes that of its source (source_site, region)."""
    of = sources.select("source_site", F.col("region").alias("_region"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    tags = F.when(F.size("tags") > 0, F.col("tags"))
    return records.join(of, "source_site", "left").select("source_site", F.coalesce("region", "_region", F.lit("")).alias("region"), *[blank(c).alias(c) for c in ("pdf_url", "title", "captured_date")], *OPTIONAL, tags.alias("tags"))


def grouped_entries(records: DataFrame) -> DataFrame:
    """Entries under their source: address and date by both of their names."""
    return records.select("title", F.col("pdf_url").alias("url"), "pdf_url", F.col("captured_date").alias("date"), "captured_date", "source_site", "region", *OPTIONAL, "tags")


def flat_entries(records: DataFrame) -> DataFrame:
    return records.select("source_site", "region", "pdf_url", "title", "captured_date", *OPTIONAL, "tags")


def payloads(assets: DataFrame, known: DataFrame, today: Column) -> DataFrame:
    """Scraped assets (source_site, region, pdf_url, title, tags) stamped with the day; a known (source, address) keeps its day, so its payload has none."""
    there = known.select("source_site", "pdf_url").distinct().withColumn("_known", F.lit(True))
    joined = assets.join(there, ["source_site", "pdf_url"], "left")
    return joined.select("source_site", "region", "pdf_url", "title", F.when(F.col("_known").isNull(), today).alias("captured_date"), F.when(F.size("tags") > 0, F.col("tags")).alias("tags"), F.col("_known").isNotNull().alias("is_update"))


def preferred_tags(stored: Column, computed: Column) -> Column:
    """The stored tags if there are any, else those computed from title and audience: column by column."""
    return F.when(F.size(F.coalesce(stored, F.expr(NONE))) > 0, stored).otherwise(F.coalesce(computed, F.expr(NONE)))


def matching_metadata(notices: DataFrame, stored: DataFrame, tools_sources: Sequence[str], key: str = "notice_key") -> DataFrame:
    """What matching needs of each notice (key, source, branch_tags, subscription_tags as computed): stored tags first, and whether it is a tool."""
    extra = stored.select(key, F.col("branch_tags").alias("_b"), F.col("subscription_tags").alias("_t"), "deadline", "fee", "audience")
    joined = notices.select(key, "source", "branch_tags", "subscription_tags").join(extra, key, "left")
    topics = preferred_tags(F.col("_t"), F.col("subscription_tags"))
    return joined.select(
        key, preferred_tags(F.col("_b"), F.col("branch_tags")).alias("branch_tags"), topics.alias("topic_tags"),
        (F.trim("source").isin(*tools_sources) | F.array_contains(topics, "category:tools")).alias("is_tools"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("deadline", "fee", "audience")],
    )


def delivery_rows(pairs: DataFrame, batch: Column) -> DataFrame:
    return pairs.select("sub_id", "notice_key", batch.alias("batch_date")).distinct()


def story_items(rows: DataFrame) -> DataFrame:
    """Rows as a story shows them: trimmed, days cut to ten characters, the region of the section if they have none; with ``complete``."""
    day = lambda c: F.trim(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, 10))
    url = F.coalesce(F.nullif("url", F.lit("")), F.col("pdf_url"), F.lit(""))
    region = F.coalesce(F.nullif("region", F.lit("")), F.nullif("section", F.lit("")), F.col("source_site"))
    out = rows.select(text_of("title").alias("title"), F.trim(url).alias("url"), F.trim(region).alias("region"), "source_site", day("date").alias("date"), day("deadline").alias("deadline"), text_of("audience").alias("audience"), text_of("fee").alias("fee"), "category")
    fine = F.lit(True)
    for c in STORY_FIELDS:
        fine = fine & (F.coalesce(F.col(c), F.lit("")) != "")
    return out.withColumn("complete", fine)


def store_entries(apps: DataFrame, today: Column) -> DataFrame:
    """Catalog entries of store apps (id, name, category, url, order)."""
    return apps.select(F.concat(F.lit("store:"), F.col("id")).alias("id"), F.trim("name").alias("title"), F.trim("url").alias("url"), F.coalesce("category", F.lit("")).alias("category"), today.alias("date"), F.col("order").alias("sort_order"))


def by_source(rows: DataFrame, source: str, day: str, title: str, place: str = "place") -> DataFrame:
    """Rows with their place in their source: the latest day first, then the title, both descending; missing ones count as ''."""
    w = Window.partitionBy(source).orderBy(F.coalesce(F.col(day).cast("string"), F.lit("")).desc(), F.coalesce(title, F.lit("")).desc())
    return rows.withColumn(place, F.row_number().over(w))


def flat_order(day: str, source: str, title: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).desc() for c in (day, source, title)]


def story_order(day: str, source: str, title: str) -> list[Column]:
    """Undated items last."""
    return [F.coalesce(F.nullif(F.col(day).cast("string"), F.lit("")), F.lit(NO_DATE)), F.col(source), F.col(title)]


def freshness_order(age: str, source: str) -> list[Column]:
    return [F.col(age).desc_nulls_last(), F.col(source)]


def catalog_order(order: str, key: str) -> list[Column]:
    return [F.col(order).asc_nulls_last(), F.col(key)]


def first_in_order(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """The first rows with ``place``; a bounded selection, no global sort."""
    top = rows.orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def active_sources(sources: DataFrame) -> DataFrame:
    """Sources to fetch: those switched off or expected to be empty are passed over, and that is no error."""
    return sources.where(F.coalesce(F.col("enabled"), F.lit(True)) & ~F.coalesce(F.col("expected_empty"), F.lit(False)))


def circular_assets(assets: DataFrame, url: str = "url") -> DataFrame:
    """Assets that can be a circular: known endings of other documents and archives go, addresses without an ending stay."""
    return assets.where(~urls.extension(F.col(url)).isin(*[f".{e}" for e in urls.DOWNLOADS if e != "pdf"]))


def fallback_pages(first: DataFrame, second: DataFrame, key: str = "url", page: str = "html") -> DataFrame:
    """A page as it was fetched first, or where that gave nothing, second."""
    other = second.select(key, F.col(page).alias("_second"))
    joined = first.join(other, key, "full_outer")
    return joined.select(key, F.coalesce(F.nullif(page, F.lit("")), F.nullif("_second", F.lit(""))).alias(page))


def is_fragment(html: Column, ready: str) -> Column:
    """A fetched fragment counts only if it holds what marks it as ready."""
    return F.coalesce(html.rlike(ready), F.lit(False))


def follows_details(explicit: Column, kind: Column, kinds: Sequence[str] = ARTICLE_TYPES) -> Column:
    """A source's own switch, else whether it is of a type whose pages hold articles."""
    return F.coalesce(explicit, F.coalesce(kind, F.lit("")).isin(*kinds))


def folder_keys(found: DataFrame) -> DataFrame:
    """(folder_id, resource_key) of each folder once: its first key if it is named with one, else ''. ``found``: folder_id, resource_key, pos (any ordered type, no place twice in a folder)."""
    keyed = F.coalesce("resource_key", F.lit("")) != ""
    return found.groupBy("folder_id").agg(F.coalesce(F.min_by("resource_key", F.when(keyed, F.col("pos"))), F.lit("")).alias("resource_key"))


def new_today(grouped: DataFrame, flat: DataFrame, today: Column) -> DataFrame:
    """(daily_new): distinct (source, address) of the day over both copies of the table."""
    columns = ("source_site", "url")
    of_day = lambda df: df.where((F.col("day") == today) & (F.coalesce("url", F.lit("")) != "")).select(*columns)
    return of_day(grouped).unionByName(of_day(flat)).distinct().agg(F.count("*").alias("daily_new"))


def kept_catalog(previous: DataFrame, rebuilt: DataFrame, key: str = "id") -> DataFrame:
    """The rebuilt catalog, and what the previous one had beside it."""
    return rebuilt.unionByName(previous.join(rebuilt.select(key).distinct(), key, "left_anti").select(*rebuilt.columns))


def gate(updated: Column, today: Column, gained: Column) -> Column:
    """Whether a run is worth publishing: 'stale', 'no gain' or 'publish'."""
    fresh = F.substring(F.coalesce(updated.cast("string"), F.lit("")), 1, 10) == today.cast("string")
    return F.when(~fresh, "stale").when(gained <= 0, "no gain").otherwise("publish")


def average_topics(subscribers: DataFrame) -> DataFrame:
    """(average): topics of an enabled subscriber, to one decimal; 0 without any."""
    n = F.size(F.coalesce("topic_ids", F.expr(NONE)))
    return subscribers.where("enabled").agg(F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("average"))


def error_counts(results: DataFrame) -> DataFrame:
    """(source, error, n) of failed rows, the most first."""
    return results.where("error IS NOT NULL").groupBy("source", "error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "error")


def hit_rate(results: DataFrame, fields: Sequence[str] = ("deadline", "audience", "fee")) -> DataFrame:
    """(done, hit, rate): rows of which any field was found."""
    any_ = F.lit(False)
    for f in fields:
        any_ = any_ | (F.coalesce(F.col(f), F.lit("")) != "")
    out = results.agg(F.count("*").alias("done"), F.count_if(any_).alias("hit"))
    return out.withColumn("rate", F.when(F.col("done") > 0, F.round(F.col("hit") / F.col("done"), 3)).otherwise(0.0))


def topic_labels(topics: DataFrame) -> DataFrame:
    """(id, name): sections, group and label of each topic, joined by dots."""
    own = F.array_join(F.filter(F.coalesce("branches", F.expr(NONE)), lambda b: b != "*"), "/")
    name = F.concat(F.when(own != "", F.concat(own, F.lit(" · "))).otherwise(""), F.coalesce("group", F.lit("")), F.lit(" · "), F.coalesce("label", "id"))
    return topics.select("id", F.regexp_replace(name, "^[ ·]+|[ ·]+$", "").alias("name"))
