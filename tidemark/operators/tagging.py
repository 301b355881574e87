"""Sections, topics and fields of notices: what subscriptions are matched against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, urls
from ..functions.audience import audience_in, scope
from ..functions.text import match_text, nfkc, reconciled
from .classify import EMPTY, category_topic, classify, is_reference, named_topics, sections_of, topic_aliases

# Days for which a notice without fields is tried again, and the errors of a file that could not be read.
CATCH_UP_DAYS = 7
UNKNOWN_DRIVE, NOT_PDF = "drive_unrecognized", "not_pdf"
ENTRY = ("category", "branch_tags", "subscription_tags")


def tagged(notices: DataFrame, topics: DataFrame, names: dict[str, str], tools_sources: Sequence[str] = ("tools",), key: str = "notice_key") -> DataFrame:
    """``notices`` (key, title, text, audience, hint, source) with ``category``, ``branch_tags``, ``subscription_tags`` (both sorted) and ``tag_evidence``.

    ``topics``: id, label, kind, branches, aliases, exclude, section, excludes_topic. ``names``: section alias to id. The labelled
    audience decides the sections, else the site's hint, else the title; a course that is named stands in only where all three say
    nothing. Courses of other sections don't count, reference documents name no course, and the topics of a section's whole
    training follow the category, unless the topic that they exclude is there.
    """
    # Dealt out by key before any work: names, sections and the join by key then need no other exchange.
    texts = notices.repartition(F.col(key)).withColumns({"_title_form": match_text(F.col("title")), "_text_form": match_text(F.col("text")), "_said": match_text(F.coalesce(F.nullif(F.trim("audience"), F.lit("")), F.nullif(F.trim("hint"), F.lit(""))))})
    found = classify(texts, "title", "text", "source", tools_sources=tools_sources)
    found = found.withColumns({"_sections": sections_of(F.col("_title_form"), F.col("_said"), names), "_reference": is_reference(F.col("_title_form"), F.col("_text_form"))})
    course = F.col("topic_id.kind") == "course"
    names_ = topic_aliases(topics).withColumn("topic_id", kind_and_id("course")).unionByName(training_aliases(topics).withColumn("topic_id", kind_and_id("training")))
    of_topic = topics.select(kind_and_id("course", "id").alias("topic_id"), F.filter(F.coalesce("branches", F.expr(EMPTY)), lambda b: b != "*").alias("of_sections"), F.coalesce(F.array_contains("branches", "*"), F.lit(False)).alias("of_all"), F.coalesce("section", F.lit("")).alias("section"))
    named = named_topics(found, names_, key, "_title_form", "_text_form").join(F.broadcast(of_topic), "topic_id", "left").where(~course | F.col("of_sections").isNotNull())
    hits = named.groupBy(key).agg(*[F.collect_list(F.when(which, F.struct(F.col("topic_id.id").alias("topic_id"), "evidence", "of_sections", "of_all", "section"))).alias(out) for which, out in ((course, "_courses"), (~course, "_named"))])
    nothing = F.filter("_courses", lambda x: F.lit(False))
    # As many rows as notices: a size estimate must not make a broadcast of it.
    found = found.join(hits.hint("merge"), key, "left").withColumn("_courses", F.when(~F.col("_reference"), F.col("_courses")).otherwise(nothing))
    silent = (F.size("_sections") == 0) & (F.col("_said") == "")
    course_sections = F.array_distinct(F.flatten(F.transform("_courses", lambda x: x["of_sections"])))
    found = found.withColumn("branch_tags", F.array_sort(F.when(silent, F.coalesce(course_sections, F.expr(EMPTY))).otherwise(F.col("_sections"))))
    found = found.withColumn("_taken", F.filter("_courses", lambda x: (F.size("branch_tags") == 0) | x["of_all"] | F.arrays_overlap(x["of_sections"], F.col("branch_tags"))))
    found = found.withColumn("_topic", category_topic(F.col("category"))).crossJoin(F.broadcast(training_topics(topics)))
    no_tags = F.expr("CAST(array() AS array<struct<topic_id: string, evidence: array<string>>>)")
    own = F.when(F.array_contains("_ids", F.col("_topic")), F.array(F.struct(F.col("_topic").alias("topic_id"), F.col("category.evidence").alias("evidence")))).otherwise(no_tags)
    taken = F.coalesce(F.transform("_taken", lambda x: F.struct(x["topic_id"].alias("topic_id"), x["evidence"].alias("evidence"))), no_tags)
    found = found.withColumn("_known", F.concat(own, taken))
    found = found.withColumn("_all", F.concat("_known", F.when(F.col("category.id") == "training", whole_training()).otherwise(no_tags)))
    tags = F.when(F.size("_all") > 0, F.array_sort("_all"))
    return found.select(*notices.columns, "category", "branch_tags", F.coalesce(F.transform(tags, lambda x: x["topic_id"]), F.expr(EMPTY)).alias("subscription_tags"), tags.alias("tag_evidence"))


def kind_and_id(kind: str, column: str = "topic_id") -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.col(column).alias("id"))


def training_aliases(topics: DataFrame) -> DataFrame:
    """(topic_id, alias, excluded) of the topics that stand for all training of a section."""
    return topics.where("kind = 'training'").select(F.col("id").alias("topic_id"), F.explode("aliases").alias("alias"), F.coalesce("exclude", F.expr(EMPTY)).alias("excluded"))


def training_topics(topics: DataFrame) -> DataFrame:
    """One row: ``_ids`` of all topics, ``_wide``: the topics that stand for all training of a section."""
    wide = F.struct(F.col("id").alias("topic_id"), "branches", F.coalesce("section", F.lit("")).alias("section"), F.size(F.coalesce("aliases", F.expr(EMPTY))).alias("n_aliases"), "excludes_topic")
    return topics.agg(F.collect_list("id").alias("_ids"), F.collect_list(F.when(F.col("kind") == "training", wide)).alias("_wide"))


def whole_training() -> Column:
    """(topic_id, evidence) of ``_wide`` that a training notice takes for one of its sections; a topic with a course section needs
    a course of it, or else one of its aliases if it has any; none whose excluded topic is known."""
    def named(w: Column) -> Column:
        return F.get(F.filter("_named", lambda x: x["topic_id"] == w["topic_id"]), F.lit(0))["evidence"]

    def course(w: Column) -> Column:
        return (w["section"] != "") & F.coalesce(F.exists("_taken", lambda x: x["section"] == w["section"]), F.lit(False))

    def met(w: Column) -> Column:
        blocked = F.coalesce(F.exists("_known", lambda x: x["topic_id"] == w["excludes_topic"]), F.lit(False))
        return F.arrays_overlap(w["branches"], F.col("branch_tags")) & (course(w) | (w["n_aliases"] == 0) | named(w).isNotNull()) & ~blocked

    def evidence(w: Column) -> Column:
        return F.when(course(w), F.array(w["section"])).when(w["n_aliases"] > 0, named(w)).otherwise(F.array_sort(F.array_intersect(w["branches"], F.col("branch_tags"))))

    return F.transform(F.filter("_wide", met), lambda w: F.struct(w["topic_id"].alias("topic_id"), evidence(w).alias("evidence")))


def with_fields(notices: DataFrame) -> DataFrame:
    """``notices`` (text, tables) with ``deadline``, ``audience``, ``audience_evidence`` and ``fee``."""
    read = notices.withColumn("_form", nfkc(F.col("text"))).withColumn("audience_evidence", scope(F.col("_form"))).drop("_form")
    return read.withColumns({"audience": audience_in(F.col("audience_evidence")), "deadline": dates.deadline(F.col("text"), F.col("tables")), "fee": money.fee(F.col("text"), F.col("tables"))})


def enriched(notices: DataFrame, topics: DataFrame, names: dict[str, str], tools_sources: Sequence[str] = ("tools",), key: str = "notice_key") -> DataFrame:
    """Landed notices (key, url, title, source, hint, text, tables, is_pdf) with fields, tags, the checked title and ``error``.

    A file that is no PDF, or a drive address without an id, keeps the tags that its title gives and says why it has no fields.
    """
    drive = urls.host(F.col("url")).contains("drive.google") | urls.host(F.col("url")).contains("docs.google")
    error = F.when(drive & urls.drive_id(F.col("url")).isNull(), UNKNOWN_DRIVE).when(~F.coalesce("is_pdf", F.lit(False)), NOT_PDF)
    read = notices.withColumn("error", error)
    read = read.withColumns({"text": F.when(F.col("error").isNull(), F.col("text")).otherwise(""), "tables": F.when(F.col("error").isNull(), F.col("tables"))})
    checked = reconciled(read, "title", "text")
    titled = checked.withColumns({"title": F.col("reconciled.title"), "title_check": F.col("reconciled.check")}).drop("reconciled")
    return tagged(with_fields(titled), topics, names, tools_sources, key)


def has_current_tags(version: Column, current: str, extractor: Column | None = None, current_extractor: str = "") -> Column:
    """All tags are there and of the current catalog (and, if asked for, of the current extractor)."""
    there = F.lit(True)
    for name in ENTRY:
        there = there & F.col(name).isNotNull()
    fine = there & version.eqNullSafe(F.lit(current))
    return fine if extractor is None else fine & extractor.eqNullSafe(F.lit(current_extractor))


def is_target(url: Column, captured: Column, day: Column, mode: str = "incremental", days: int = CATCH_UP_DAYS, hosts: Sequence[str] = ()) -> Column:
    """A file to read: of the last days by default; 'all' and 'backfill' take every day, and what is done already is left out by the state."""
    drive = urls.host(url).contains("drive.google") | urls.host(url).contains("docs.google")
    readable = F.when(drive, urls.drive_id(url).isNotNull()).otherwise(urls.is_enrichable(url, hosts))
    if mode not in ("incremental", "all", "backfill"):
        raise ValueError(mode)
    return readable if mode != "incremental" else readable & dates.within_days(captured, day, days)


def targets(rows: DataFrame, done: DataFrame, day: Column, mode: str = "incremental", days: int = CATCH_UP_DAYS) -> DataFrame:
    """Rows (url, captured) to read in a run; all but 'all' leave out addresses in ``done`` that have current tags."""
    wanted = rows.where(is_target(F.col("url"), F.col("captured"), day, mode, days))
    return wanted if mode == "all" else wanted.join(done.select("url").distinct(), "url", "left_anti")


def skipped_links(rows: DataFrame, day: Column, source: str = "source", days: int = CATCH_UP_DAYS) -> DataFrame:
    """(source, links, example) of the last days' addresses that are not read, the most first."""
    recent = rows.where(dates.within_days(F.col("captured"), day, days)).where(~is_target(F.col("url"), F.col("captured"), day, "all"))
    return recent.groupBy(source).agg(F.count("*").alias("links"), F.min("url").alias("example")).orderBy(F.desc("links"), source)
