"""Daily picks: diversified top-k, rotation of texts, allocation of templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.text import VARIANTS

# Categories in their order of preference, cards a day, slogans a category, and template names.
CATEGORIES = ("training", "activity", "service", "competition")
MOST = 5
SLOTS = 8
PRIMARY = {"training": ("train_blue", "train_orange", "train_green"), "competition": ("competition_gold_black",), "activity": ("activity_army",), "service": ("service_wanted",)}
OVERFLOW = ("unc_scope", "unc_topsecret", "unc_glitch")


def place(values: Sequence[str], c: Column) -> Column:
    """The 1-based place of a value in a list; 0 if it isn't there."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def complete(fields: Sequence[str]) -> Column:
    """All fields are there and not blank."""
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.coalesce(F.trim(F.col(f).cast("string")) != "", F.lit(False))
    return ok


def diversified(rows: DataFrame, group: Sequence[str], category: str, order: Sequence[str], categories: Sequence[str] = CATEGORIES, most: int = MOST) -> DataFrame:
    """Of each group, the first row of each category in the categories' order, then the others in theirs, ``most`` in all, with ``pick`` from 1.

    Only the first ``most`` rows of a category can be picked, so they alone reach the second ranking.
    """
    known = rows.where(F.col(category).isin(*categories))
    first = known.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, category).orderBy(*order))).where(F.col("_rn") <= most)
    lead = F.when(F.col("_rn") == 1, place(categories, F.col(category)).cast("int")).otherwise(len(categories) + 1)
    ranked = first.withColumn("pick", F.row_number().over(Window.partitionBy(*group).orderBy(lead, *order)))
    return ranked.where(F.col("pick") <= most).drop("_rn")


def rotated(rows: DataFrame, group: Sequence[str], category: str, order: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot``: 0, 1, 2 ... within group and category, starting anew after ``slots``."""
    return rows.withColumn("slot", (F.row_number().over(Window.partitionBy(*group, category).orderBy(*order)) - 1) % slots)


def allocated(rows: DataFrame, group: Sequence[str], category: str, order: Sequence[str], primary: dict[str, tuple[str, ...]] | None = None, overflow: Sequence[str] = OVERFLOW) -> DataFrame:
    """``rows`` with ``template``: the category's own names first, then names shared by all categories of the group while they last, then a cycle of both.

    Null for a category without templates.
    """
    primary = primary or PRIMARY
    nth = F.row_number().over(Window.partitionBy(*group, category).orderBy(*order)) - 1
    own = F.create_map(*[x for k, v in primary.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])[F.col(category)]
    shared = F.array(*[F.lit(n) for n in overflow])
    rows = rows.withColumn("_own", own).withColumn("_nth", nth).withColumn("_over", F.col("_own").isNotNull() & (F.col("_nth") >= F.size("_own")))
    upto = F.sum(F.col("_over").cast("int")).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = F.concat("_own", shared)
    template = (
        F.when(F.col("_own").isNull(), None).when(~F.col("_over"), F.get("_own", F.col("_nth")))
        .when(F.col("_upto") <= len(overflow), F.get(shared, F.col("_upto") - 1)).otherwise(F.get(both, (F.col("_nth") % F.size(both)).cast("int")))
    )
    return rows.withColumn("_upto", upto).withColumn("template", template).drop("_own", "_nth", "_over", "_upto")


def stable_choice(key: Column, n: int) -> Column:
    """md5(key) mod n, digit by digit: the 128-bit number never has to exist."""
    digits = F.filter(F.split(F.md5(F.encode(key, "UTF-8")), ""), lambda d: d != "")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % n)


def summary(rows: DataFrame, group: Sequence[str], done: Column) -> DataFrame:
    """Candidates and incomplete ones of each group."""
    return rows.groupBy(*group).agg(F.count("*").alias("candidates"), F.count_if(~done).alias("incomplete"))


def story_category(title: Column) -> Column:
    """What a story shows: the first rule that the title's words meet, else 'other'."""
    c = F.translate(F.coalesce(title, F.lit("")), *VARIANTS)
    has = lambda terms: c.rlike(terms if isinstance(terms, str) else "|".join(terms))
    rally, service, override = has(t.RALLY), has(t.STORY_SERVICE), has(t.STORY_OVERRIDE)
    rules = (
        (has(t.LOST_PROPERTY), "announcement"),
        (rally & service & ~override, "service"),
        (rally & has(t.RALLY_COMPETITION), "competition"),
        (rally, "activity"),
        (F.regexp_replace(c, t.STORY_RESULTS, "").rlike(t.STORY_ANNOUNCEMENT), "announcement"),
        (~has(t.STORY_YOUTH_AWARD) & (override | has(t.STORY_AWARD_PLAN)), "announcement"),
        (has(t.STRONG_ACTIVITY), "activity"),
        (service, "service"),
        (has(t.STORY_COMPETITION), "competition"),
        (has(t.REFERENCE) | c.rlike(t.MONTHLY_DIGEST), "announcement"),
        (has(t.STORY_TRAINING), "training"),
        (has(t.MEMBERSHIP), "announcement"),
        (has(t.STORY_ACTIVITY), "activity"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for test, kind in rules[1:]:
        out = out.when(test, kind)
    return out.otherwise("other")
