"""Line dedup by winnowing over line hashes (after Schleimer, Wilkerson and Aiken, 2003). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Lines in a window: a run of at least so many lines that came before is found for certain, a shorter one never.
WINDOW = 3


def fingerprints(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """A row for each line that a window of its document selects, the least hash, the rightmost of equals: (id, th) of the document, the
    hash ``f`` and place ``p`` of the line, the start ``s`` and number ``n`` of the windows that select it, which are neighbours,
    and the two hashes ``a`` and ``b`` of each line that these windows hold, so from ``s`` on."""
    lines = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("th"), F.split(text, "\n").alias("lines")).where(F.size("lines") >= window)
    hashed = lines.select("id", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"))
    least = lambda w: window - F.array_position(F.reverse(w), F.array_min(w))
    placed = hashed.select("id", "th", "a", "b", F.transform(F.sequence(F.lit(0), F.size("a") - window), lambda s: (s + least(F.slice("a", s + 1, window))).cast("int")).alias("ps"))
    firsts = F.filter(F.sequence(F.lit(0), F.size("ps") - 1), lambda s: (s == 0) | (F.get("ps", s - 1) != F.get("ps", s)))
    starts = placed.select("id", "th", "a", "b", "ps", F.explode(firsts).alias("s")).withColumn("p", F.get("ps", F.col("s")))
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.get("ps", F.col("s") + k) == F.col("p")))
    counted = starts.select("id", "th", "a", "b", "s", "p", same.alias("n"))
    around = lambda c: F.slice(c, F.col("s") + 1, F.col("n") + (window - 1)).alias(c)
    return counted.select("id", "th", F.get("a", F.col("p")).alias("f"), "p", "s", "n", around("a"), around("b"))


def later_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, th, gone): the places of lines in runs of at least ``window`` lines that start earlier elsewhere, by (key, text hash, place).

    Only selected lines are stored, joined by their hash, and only where a hash is at two places is a match extended: over the
    lines left and right of the fingerprint, as far as the windows go that select it. Equal runs select equal lines, so every
    window of a match is met at its own fingerprint, and windows that follow one another make the whole run. The first of
    equal windows is found by an aggregation that combines before its shuffle, and the join back is one that Spark can split,
    so a line or passage in a third of all documents is no hot key. No pairs are formed.
    """
    rows = written(fingerprints(docs, key, text, window), "fingerprints")
    place = F.struct("id", "th", "p")
    repeated = rows.groupBy("f").agg(F.min(place).alias("low"), F.max(place).alias("high")).where(~F.col("low").eqNullSafe(F.col("high"))).select(F.col("f").alias("of"))
    joined = rows.join(repeated, rows["f"] == repeated["of"]).select("id", "th", "s", "a", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    extended = lambda c: F.xxhash64(F.slice(c, F.col("k") + 1, window))
    met = joined.select("id", "th", (F.col("s") + F.col("k")).alias("s"), extended("a").alias("k1"), extended("b").alias("k2"))
    start = F.struct("id", "th", "s")
    first = met.groupBy("k1", "k2").agg(F.min(start).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), "first")
    later = met.join(first, (met["k1"] == first["j1"]) & (met["k2"] == first["j2"])).where(~start.eqNullSafe(F.col("first")))
    runs = later.groupBy("id", "th").agg(F.collect_set("s").alias("starts"))
    cover = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (window - 1)))))
    return runs.select("id", "th", F.array_sort(cover).alias("gone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` (all of ``docs`` by default) with ``kept_text``, ``n_lines``, ``n_removed`` and ``n_runs`` (removed runs).

    Lines end at a line feed and are compared byte by byte through their hashes; an empty line is a line. A line goes if a
    window of lines that holds it also starts earlier in the table, its own document included, as judged on the input. Rows
    with equal key and text are one document and keep the same lines; a null key comes first; a null text has no lines and
    stays null; an empty text is one empty line. A text of any length counts whole; names that are taken get underscores; an empty table stays empty.
    """
    keep = docs.columns if keep is None else keep
    names = dict(zip(("kept_text", "n_lines", "n_removed", "n_runs"), fresh({*docs.columns, *keep}, "kept_text", "n_lines", "n_removed", "n_runs"), strict=True))
    th, lines, gone, stay = fresh({*docs.columns, *names.values(), "id", "th", "gone"}, "line_th", "line_list", "line_gone", "line_stay")
    runs = later_runs(docs, key, text, window).withColumnRenamed("gone", gone).select(F.col("id").alias(f"{th}_id"), F.col("th").alias(f"{th}_th"), gone)
    kept = [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*kept, F.col(key).alias(f"{th}_key"), F.xxhash64(text).alias(th), F.col(text).alias(lines))
    both = rows.join(runs, F.col(f"{th}_key").eqNullSafe(F.col(f"{th}_id")) & (F.col(th) == F.col(f"{th}_th")), "left")
    split = both.select(*kept, F.split(lines, "\n").alias(lines), F.coalesce(gone, F.expr("CAST(array() AS array<int>)")).alias(gone))
    n = F.coalesce(F.size(lines), F.lit(0))
    placed = split.select(*kept, lines, gone, F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), gone)).alias(stay))
    count = lambda x: F.size(x).cast("long")
    return placed.select(
        *kept,
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n").alias(names["kept_text"]),
        F.when(F.col(lines).isNull(), 0).otherwise(count(lines)).cast("long").alias(names["n_lines"]),
        count(gone).alias(names["n_removed"]),
        count(F.array_except(gone, F.transform(gone, lambda i: i + 1))).alias(names["n_runs"]),
    ), names
