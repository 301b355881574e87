"""State that outlives a run: publication days, fingerprints, guards, overlays of corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_heading
from .rows import keep_earliest

# Of the guards.
BLAST_LEAST, BLAST_SHARE = 3, 0.3
SHRINK_LEAST, SHRINK_SHARE = 2, 1 / 3


def publication_days(observed: DataFrame, state: DataFrame, today: Column, repairs: DataFrame | None = None, first_run: bool = False) -> DataFrame:
    """Visible rows (url, created_on) with the day they became public and why.

    ``state``: url, first_public, known_day, delisted_on. In this order: back after a delisting: today; a reviewed repair;
    a known day is kept; the very first run trusts creation days; first seen now: today. Days after today become today.
    """
    joined = observed.join(state, "url", "left")
    if repairs is not None:
        joined = joined.join(repairs.select("url", F.col("day").alias("_repair")), "url", "left")
    else:
        joined = joined.withColumn("_repair", F.lit(None).cast("date"))
    history = F.coalesce("first_public", "known_day")
    back = F.col("delisted_on").isNotNull()
    day = F.when(back, today).otherwise(F.coalesce("_repair", history, F.col("created_on") if first_run else F.lit(None).cast("date"), today))
    why = F.when(back, "relisted").when(F.col("_repair").isNotNull(), "repaired").when(history.isNotNull(), "kept").when(F.lit(first_run) & F.col("created_on").isNotNull(), "created").otherwise("first seen")
    return joined.select(*observed.columns, F.least(day, today).alias("public_on"), why.alias("reason"))


def next_state(state: DataFrame, published: DataFrame, observed_all: DataFrame, today: Column) -> DataFrame:
    """The state after a run: public days of visible rows, ``delisted_on`` for rows that were public and are gone, pending for invisible new ones."""
    visible = published.select("url", "public_on")
    hidden = observed_all.where(~F.coalesce(F.col("visible"), F.lit(False))).select("url", F.lit(True).alias("_hidden"))
    joined = state.join(visible, "url", "full_outer").join(hidden, "url", "full_outer")
    first = F.coalesce("public_on", "first_public")
    gone = F.when(F.col("public_on").isNotNull(), None).when(F.col("first_public").isNotNull(), F.coalesce("delisted_on", today)).otherwise(F.col("delisted_on"))
    pending = F.col("_hidden").isNotNull() & first.isNull()
    return joined.select("url", first.alias("first_public"), F.col("known_day"), gone.alias("delisted_on"), pending.alias("pending"))


def blast_guarded(rows: DataFrame, today: Column, evidence: Column, fallback: Column, day: str = "public_on") -> DataFrame:
    """If more rows than max(3, 30 %) became public today, those without evidence get the fallback day instead. Two passes over ``rows``."""
    n, fresh = rows.agg(F.count("*"), F.count_if(F.col(day) == today)).first()
    if fresh <= max(BLAST_LEAST, BLAST_SHARE * n):
        return rows
    return rows.withColumn(day, F.when((F.col(day) == today) & ~F.coalesce(evidence, F.lit(False)), fallback).otherwise(F.col(day)))


def shrink_guarded(current: DataFrame, previous: DataFrame, key: str = "url") -> tuple[DataFrame, bool]:
    """Too many rows missing at once (more than max(2, a third)) is a broken source: they are carried over and the flag is set. None left at all is refused."""
    before = previous.count()
    if before and current.isEmpty():
        raise ValueError("no visible row is left: refused")
    missing = previous.join(current.select(key), key, "left_anti")
    if missing.count() > max(SHRINK_LEAST, SHRINK_SHARE * before):
        return current.unionByName(missing.select(*current.columns)), True
    return current, False


def changed_sources(fetched: DataFrame, fingerprints: DataFrame, forced: bool = False) -> DataFrame:
    """Fetched sources (source, fingerprint, ...) whose fingerprint isn't the stored one."""
    if forced:
        return fetched
    same = fingerprints.select(F.col("source"), F.col("fingerprint"))
    return fetched.join(same, ["source", "fingerprint"], "left_anti")


def stored_fingerprints(old: DataFrame, processed: DataFrame) -> DataFrame:
    """Fingerprints after a run: a source without assets, or with a failed page, keeps its old one, so that it is tried again."""
    good = processed.where((F.col("assets") > 0) & ~F.coalesce(F.col("failed"), F.lit(False))).select("source", F.col("fingerprint").alias("_new"))
    return old.join(good, "source", "full_outer").select("source", F.coalesce("_new", "fingerprint").alias("fingerprint"))


def merged_days(existing: DataFrame, incoming: DataFrame, keys: list[str], day: str, updated: list[str]) -> DataFrame:
    """Known keys keep their day (the earliest of both) and take the incoming text fields; new keys come in whole."""
    other = incoming.select(*keys, *[F.col(c).alias(f"_{c}") for c in incoming.columns if c not in keys])
    joined = existing.join(other, keys, "full_outer")
    value = lambda c: F.least(day, f"_{day}") if c == day else F.coalesce(f"_{c}", c) if c in updated else F.coalesce(c, f"_{c}")
    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in existing.columns])


def migrated(rows: DataFrame, moves: DataFrame, keys: list[str], url: str, day: str, order: list[str]) -> DataFrame:
    """Addresses replaced by reviewed ones; rows that then share a key are one, with the earliest day."""
    moved = rows.join(moves.select(F.col("old_url").alias("_old"), F.col("new_url").alias("_to")), F.col(url) == F.col("_old"), "left")
    return keep_earliest(moved.withColumn(url, F.coalesce("_to", url)).drop("_old", "_to"), keys, day, order)


def title_fixes(rows: DataFrame, fixes: DataFrame, key: str = "url", title: str = "title") -> DataFrame:
    """A stored title correction is laid on again while the listing title is the one it was made for; one that no longer reads like a title is reverted."""
    f = fixes.select(key, F.col("listing_title").alias("_from"), F.col("title").alias("_to"))
    joined = rows.join(f, key, "left")
    good = (F.col(title) == F.col("_from")) & looks_like_heading(F.col("_to"))
    check = F.when(F.col("_to").isNull(), None).when(good, "corrected").when(F.col(title) == F.col("_from"), "reverted")
    return joined.withColumn("title_check", check).withColumn(title, F.when(good, F.col("_to")).otherwise(F.col(title))).drop("_from", "_to")


def with_category_topics(tags: Column, topic: Column) -> Column:
    """Subscription tags with the category's topic in place of other category topics; course topics stay. Sorted."""
    courses = F.filter(tags, lambda x: ~x.rlike("^(category|activity):"))
    return F.array_sort(F.array_union(courses, F.array(topic)))
