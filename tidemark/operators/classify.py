"""Ordered classification, section scanning and topic tagging, as expressions over term arrays that are each computed once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as t
from ..functions.audience import sections_by_age
from ..functions.text import match_text

EMPTY = "CAST(array() AS array<string>)"


def term_hits(text: Column, terms: Iterable[str]) -> Column:
    """The terms that the text holds, in their order. ``text``: matching form."""
    words = F.array(*[F.lit(x) for x in terms])
    return F.filter(words, lambda w: F.contains(text, F.lower(w)))


def masked(text: Column, phrases: Iterable[str]) -> Column:
    for p in phrases:
        text = F.replace(text, F.lit(p.lower()), F.lit("␀"))
    return text


def has(c: Column) -> Column:
    return F.size(c) > 0


def category(rules: Sequence[tuple[Column, str, Column]], default: str) -> Column:
    """The first rule that holds: struct(id, subtype, label, score, evidence). A rule is (condition, 'id' or 'id/subtype', evidence)."""
    def made(name: str, evidence: Column) -> Column:
        kind, _, sub = name.partition("/")
        return F.struct(F.lit(kind).alias("id"), F.lit(sub or None).cast("string").alias("subtype"), F.lit(t.LABELS.get(kind, kind)).alias("label"), F.lit(3.0).alias("score"), F.slice(F.array_distinct(evidence), 1, 4).alias("evidence"))

    out = None
    for when, name, evidence in rules:
        out = F.when(when, made(name, evidence)) if out is None else out.when(when, made(name, evidence))
    return out.otherwise(made(default, F.expr(EMPTY)))


def classify(notices: DataFrame, title: str = "title", text: str | None = None, source: str | None = None, out: str = "category", match: bool = True, tools_sources: Sequence[str] = ("tools",)) -> DataFrame:
    """``notices`` with one category each.

    A title that says something decides; the start of the text only helps a title that says nothing, and there incidental
    words don't count. Rows of ``tools_sources`` are tools whatever they say. Every term list is looked up once, in a projection of its own below the CASE.
    """
    form = match_text if match else (lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")))
    base = notices.withColumn("_title", form(F.col(title)))
    base = base.withColumn("_body", form(F.substring(F.coalesce(F.col(text), F.lit("")), 1, t.BODY_CHARS)) if text else F.lit(""))
    base = base.withColumn("_source", F.trim(F.col(source)) if source else F.lit(""))
    T_, B = F.col("_title"), F.col("_body")

    def service(c: Column) -> Column:
        return F.concat(term_hits(c, t.SERVICE), term_hits(F.replace(c, F.lit(t.SERVICE_NOT), F.lit("")), t.SERVICE_BARE))

    trusted = lambda c: F.array_except(c, F.array(*[F.lit(x) for x in t.BODY_UNTRUSTED]))
    lists = {
        "lost": t.LOST_PROPERTY, "rally": t.RALLY, "rally_competition": t.RALLY_COMPETITION, "invitation": t.INVITATION, "override": t.OVERRIDE,
        "override_not": t.OVERRIDE_NOT, "allowance": t.ALLOWANCE, "strong": t.STRONG_ACTIVITY, "competition": t.COMPETITION, "training": t.TRAINING,
        "camp": t.BIG_CAMP, "fire": t.CAMPFIRE, "membership": t.MEMBERSHIP, "activity": t.ACTIVITY,
    }
    hits = {f"_t_{k}": term_hits(T_, v) for k, v in lists.items()}
    hits["_t_service"] = service(T_)
    hits["_t_announcement"] = term_hits(masked(T_, t.RESULT_PHRASES), t.ANNOUNCEMENT)
    plain = term_hits(T_, t.REFERENCE)
    hits["_t_reference"] = F.when(has(plain), plain).when(T_.rlike(t.MONTHLY_DIGEST), F.array(F.lit("monthly digest"))).otherwise(F.expr(EMPTY))
    hits |= {"_b_service": trusted(service(B)), "_b_competition": trusted(term_hits(B, t.COMPETITION)), "_b_training": term_hits(B, t.TRAINING), "_b_camp": term_hits(B, t.BIG_CAMP), "_b_fire": term_hits(B, t.CAMPFIRE), "_b_activity": term_hits(B, t.ACTIVITY), "_b_reference": term_hits(B, t.REFERENCE)}
    c = {k: F.col(k) for k in hits}
    T, Bh = {k[3:]: v for k, v in c.items() if k.startswith("_t_")}, {k[3:]: v for k, v in c.items() if k.startswith("_b_")}
    untitled = T_ == ""
    decisive = has(T["service"]) | has(T["competition"]) | has(T["training"]) | has(T["camp"]) | has(T["fire"])
    rules = [
        (F.col("_source").isin(*tools_sources), "tools", F.array(F.col("_source"))),
        (has(T["lost"]), "announcement", T["lost"]),
        (has(T["rally"]) & has(T["service"]) & ~has(T["override"]), "service", T["service"]),
        (has(T["rally"]) & has(T["rally_competition"]), "competition", T["rally_competition"]),
        (has(T["rally"]), "activity/other", T["rally"]),
        (has(T["invitation"]), "service", T["invitation"]),
        (has(T["announcement"]), "announcement", T["announcement"]),
        (has(T["override"]) & ~has(T["override_not"]), "announcement", T["override"]),
        (has(T["allowance"]) & ~has(T["override_not"]), "announcement", T["allowance"]),
        (has(T["strong"]) & has(T["camp"]), "activity/big_camp", F.concat(T["strong"], T["camp"])),
        (has(T["strong"]) & has(T["fire"]), "activity/campfire", F.concat(T["strong"], T["fire"])),
        (has(T["strong"]), "activity/other", T["strong"]),
        (has(T["service"]), "service", T["service"]),
        (has(T["competition"]), "competition", T["competition"]),
        (decisive & has(T["reference"]), "announcement", T["reference"]),
        (has(T["training"]), "training", T["training"]),
        (has(T["camp"]), "activity/big_camp", T["camp"]),
        (has(T["fire"]), "activity/campfire", T["fire"]),
        (has(T["membership"]), "announcement", T["membership"]),
        (has(T["activity"]) & ~has(T["reference"]), "activity/other", T["activity"]),
        (has(T["reference"]), "announcement", T["reference"]),
        (has(Bh["service"]), "service", Bh["service"]),
        (has(Bh["competition"]), "competition", Bh["competition"]),
        (untitled & has(Bh["reference"]), "announcement", Bh["reference"]),
        (has(Bh["training"]), "training", Bh["training"]),
        (has(Bh["camp"]), "activity/big_camp", Bh["camp"]),
        (has(Bh["fire"]), "activity/campfire", Bh["fire"]),
        (untitled & has(Bh["activity"]), "activity/other", Bh["activity"]),
    ]
    return base.withColumns(hits).withColumn(out, category(rules, "announcement")).drop(*hits, "_title", "_body", "_source")


def is_reference(title: Column, text: Column | None = None) -> Column:
    """A calendar, rule book or list rather than something to enrol in. Arguments: matching form."""
    found = has(term_hits(title, t.REFERENCE)) | title.rlike(t.MONTHLY_DIGEST)
    return found if text is None else found | ((title == "") & has(term_hits(text, t.REFERENCE)))


def scan_longest(text: Column, names: dict[str, str]) -> Column:
    """Ids of the names met from left to right, at each place the longest that fits, which is then consumed. Ordered and distinct.

    An alternation tries its branches in order, so one pass of a pattern with the longest names first does it all.
    """
    ordered = sorted(names, key=lambda n: (-len(n), n))
    quoted = "|".join(quoted_term(n) for n in ordered)
    ids = F.create_map(*[x for n in ordered for x in (F.lit(n), F.lit(names[n]))])
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({quoted})"), 1), lambda n: ids[n]))


def quoted_term(s: str) -> str:
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|" else c for c in s)


def sections(text: Column, names: dict[str, str], nfkc_text: Column | None = None) -> Column:
    """Section ids of an audience or title, sorted. ``text``: matching form; ``names``: alias (matching form) to id.

    'All members' means every section; 'members of each section' the five youth sections besides those named; ages and 'or above'
    add the sections that they imply, and a bare section name beside an age is then no section.
    """
    whole = text if nfkc_text is None else nfkc_text
    by_age, above = sections_by_age(whole)
    implied = F.array_union(by_age, above)
    t1 = F.replace(F.regexp_replace(text, r"各支部成員[（(][^）)]*[）)]", ""), F.lit("教練員"), F.lit("領袖"))
    youth = F.array(*[F.lit(s) for s in t.SECTIONS])
    everyone = F.array(*[F.lit(i) for i in dict.fromkeys(names.values())])
    found = scan_longest(F.replace(t1, F.lit("各支部成員"), F.lit("")), names)
    others = "|".join(s for s in t.SECTIONS if s != "童軍")
    bare = (F.size(by_age) > 0) & ~t1.rlike(others)
    found = F.when(bare, F.array_except(found, youth)).otherwise(found)
    return F.array_sort(F.array_union(implied, F.when(t1.contains("各支部成員"), F.array_union(youth, found)).when(t1.rlike("|".join(t.ALL_MEMBERS[:2])), everyone).otherwise(found)))


def sections_of(title: Column, audience: Column, names: dict[str, str]) -> Column:
    """The audience decides if there is one, else the title without the organisation's name."""
    return F.when(audience != "", sections(audience, names)).otherwise(sections(F.regexp_replace(title, "香港童軍(總會)?", ""), names))


def badge_forms(label: Column) -> Column:
    stem = F.when(label.endswith(t.BADGE) & (F.length(label) >= 3), F.regexp_replace(label, f"{t.BADGE}$", ""))
    return F.when(stem.isNotNull(), F.transform(F.array(*[F.lit(x) for x in t.BADGE_FORMS]), lambda f: F.concat(stem, f))).otherwise(F.expr(EMPTY))


def topic_aliases(catalog: DataFrame) -> DataFrame:
    """(topic_id, alias, excluded) of course topics: their aliases and the forms that course titles take. ``catalog``: id, label, kind, aliases, exclude."""
    course = catalog.where("kind = 'course'")
    forms = F.transform(F.array(*[F.lit(x) for x in t.COURSE_FORMS]), lambda f: F.concat(F.trim("label"), f))
    names = F.concat(F.coalesce("aliases", F.expr(EMPTY)), F.when(F.trim("label") != "", forms).otherwise(F.expr(EMPTY)), badge_forms(F.trim("label")))
    return course.select(F.col("id").alias("topic_id"), F.explode(F.array_distinct(names)).alias("alias"), with_stems(F.coalesce("exclude", F.expr(EMPTY))).alias("excluded"))


def with_stems(names: Column) -> Column:
    """The names, and after each that is a badge's the badge without its last character."""
    return F.flatten(F.transform(names, lambda n: F.when(n.endswith(t.BADGE) & (F.length(n) >= 3), F.array(n, F.regexp_replace(n, f"{t.BADGE}$", ""))).otherwise(F.array(n))))


def requirement_only(text: Column, alias: Column) -> Column:
    """Every time that the alias is named, words of a requirement stand near it. Matching form."""
    near = t.REQUIREMENT_CHARS
    pieces = F.split(text, F.regexp_replace(alias, r"([.?+*()\[\]^$|\\{}-])", r"\\$1"), -1)
    at = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)))
    return F.forall(at, lambda i: F.concat(F.right(F.coalesce(F.get(pieces, i - 1), F.lit("")), F.lit(near)), F.left(F.coalesce(F.get(pieces, i), F.lit("")), F.lit(near))).rlike("|".join(t.REQUIREMENTS)))


def course_topics(notices: DataFrame, catalog: DataFrame, key: str = "notice_key", title: str = "title_form", text: str = "text_form") -> DataFrame:
    """(key, topic_id, evidence): the course topics that a notice's title or text names.

    An alias can only be named where its first two characters stand, so notices and aliases meet on these by an equi join, and the
    whole alias is looked for in the notices that it meets. Longer names that merely contain an alias are masked first, and
    names met only in requirements don't count unless the title has them.
    """
    return named_topics(notices, topic_aliases(catalog), key, title, text)


def named_topics(notices: DataFrame, aliases: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """(key, topic_id, evidence) for ``aliases`` (topic_id, alias, excluded), a controlled list that is broadcast; notices are never joined with themselves."""
    names = aliases.where("alias != ''").withColumn("_start", F.substring(F.lower("alias"), 1, 2))
    whole = F.concat(F.col(title), F.col(text))
    known = names.agg(F.collect_set("_start").alias("_known"))
    read = notices.select(key, F.col(title).alias("_title"), whole.alias("_whole"))
    at = F.sequence(F.lit(1), F.greatest(F.length("_whole"), F.lit(1)))
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substring(F.col("_whole"), i, F.lit(2)), F.substring(F.col("_whole"), i, F.lit(1))))))
    begun = read.crossJoin(F.broadcast(known)).select(key, "_title", "_whole", F.explode(F.array_intersect(starts, "_known")).alias("_start"))
    met = begun.join(F.broadcast(names), "_start").where(F.contains(F.col("_whole"), F.lower("alias")))
    shown = F.aggregate("excluded", F.col("_whole"), lambda acc, x: F.replace(acc, F.lower(x), F.lit("␀")))
    met = met.where(F.contains(shown, F.lower("alias")) & (F.contains(F.col("_title"), F.lower("alias")) | ~requirement_only(F.col("_whole"), F.lower("alias"))))
    return met.groupBy(key, "topic_id").agg(F.slice(F.array_sort(F.collect_set("alias")), 1, 4).alias("evidence"))


def category_topic(c: Column) -> Column:
    """The topic id of a category struct."""
    return F.when(c["id"] == "activity", F.concat(F.lit("activity:"), F.replace(F.coalesce(c["subtype"], F.lit("other")), F.lit("_"), F.lit("-")))).otherwise(F.concat(F.lit("category:"), c["id"]))
