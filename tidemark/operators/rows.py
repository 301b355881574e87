"""Deduplication, deltas and merges of keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def keep_earliest(rows: DataFrame, keys: str | Sequence[str], day: str, order: Sequence[str]) -> DataFrame:
    """One row a key: all fields of its first row by ``order``, but the earliest day of all its rows.

    A single aggregation that combines before its shuffle; no window, so a key with very many rows is no hot task.
    """
    keys = columns(keys)
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    grouped = rows.groupBy(*keys).agg(first.alias("_first"), F.min(day).alias("_day"))
    return grouped.select(*[F.col(k) if k in keys else (F.col("_day").alias(k) if k == day else F.col(f"_first.{k}").alias(k)) for k in rows.columns])


def latest(rows: DataFrame, keys: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, which has to be unique within a key."""
    keys = columns(keys)
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return grouped.select(*[F.col(k) if k in keys else F.col(f"_last.{k}").alias(k) for k in rows.columns])


def first_seen(rows: DataFrame, keys: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    keys = columns(keys)
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return grouped.select(*[F.col(k) if k in keys else F.col(f"_first.{k}").alias(k) for k in rows.columns])


def new_rows(current: DataFrame, baseline: DataFrame, keys: str | Sequence[str], order: Sequence[str], suppressed: Column | None = None) -> DataFrame:
    """Rows of keys that the baseline lacks, one a key; suppressed rows never count."""
    keys = columns(keys)
    current = current if suppressed is None else current.where(~F.coalesce(suppressed, F.lit(False)))
    return first_seen(current.join(baseline.select(*keys).distinct(), keys, "left_anti"), keys, order)


def catch_up(current: DataFrame, found: DataFrame, keys: str | Sequence[str], day: Column, batch: Column, order: Sequence[str], suppressed: Column | None = None) -> DataFrame:
    """Rows of the batch day that an earlier delta did not find. The day filter reaches the scan before the anti join."""
    return new_rows(current.where(day == batch), found, keys, order, suppressed)


def split_new(rows: DataFrame, existing: DataFrame, keys: str | Sequence[str], flag: str = "is_new") -> DataFrame:
    """``rows`` with a flag: the key is not among the existing ones."""
    keys = columns(keys)
    marked = existing.select(*keys).distinct().withColumn("_there", F.lit(True))
    return rows.join(marked, keys, "left").withColumn(flag, F.col("_there").isNull()).drop("_there")


def key_diff(before: DataFrame, after: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Keys on one side only: (keys, change), 'gained' or 'lost'. One full join of distinct keys."""
    keys = columns(keys)
    a = before.select(*keys).distinct().withColumn("_a", F.lit(True))
    b = after.select(*keys).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, keys, "full_outer").where("_a IS NULL OR _b IS NULL")
    return both.select(*keys, F.when(F.col("_a").isNull(), "gained").otherwise("lost").alias("change"))


def last_of_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row of each key: the last by ``order``, and by the values of all columns where that leaves several."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    grouped = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], *[F.to_json(F.struct(c)) for c in rest])).alias("_last"))
    return grouped.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def overlay(rows: DataFrame, corrections: DataFrame, keys: str | Sequence[str], fields: Sequence[str], changed: str = "is_changed", order: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the corrections' non-null fields in place of their own, and a flag for rows that this changed. Twice is like
    once; of several corrections of a key the last by ``order`` counts, so no row is doubled."""
    keys = columns(keys)
    corrections = last_of_key(corrections, keys, order)
    other = corrections.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = rows.join(other, keys, "left")
    differs = F.lit(False)
    for f in fields:
        differs = differs | (F.col(f"_new_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_new_{f}")))
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns], differs.alias(changed))


def merge_backfill(remote: DataFrame, local: DataFrame, keys: str | Sequence[str], fields: Sequence[str], is_backfill: Column) -> DataFrame:
    """Remote rows with the fields of local backfills of their key laid over them, and local backfills of keys that remote lacks."""
    keys = columns(keys)
    fills = local.where(is_backfill)
    laid = overlay(remote, fills, keys, fields).drop("is_changed")
    return laid.unionByName(fills.join(remote.select(*keys).distinct(), keys, "left_anti").select(*remote.columns))


def upsert(base: DataFrame, changes: DataFrame, keys: str | Sequence[str], keep: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """The table after the changes: a changed row replaces the one of its key but for the fields in ``keep``, which stay as they
    were. Of several changes of a key the last by ``order`` counts."""
    keys = columns(keys)
    changes = last_of_key(changes, keys, order)
    fields = [c for c in base.columns if c not in keys]
    other = changes.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_in"))
    old = base.withColumn("_old", F.lit(True))
    joined = old.join(other, keys, "full_outer")
    value = lambda f: F.when(F.col("_in").isNull() | (F.lit(f in keep) & F.col("_old").isNotNull()), F.col(f)).otherwise(F.col(f"_new_{f}")).alias(f)
    return joined.select(*[F.col(c) if c in keys else value(c) for c in base.columns])


def append_once(table: DataFrame, rows: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not there yet, one of each: what an idempotent append would write."""
    keys = columns(keys)
    return rows.join(table.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)


def without(table: DataFrame, gone: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The table without the rows whose keys are all matched: deletion by one or by two factors."""
    keys = columns(keys)
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def two_probes(rows: DataFrame, table: DataFrame, key: str, first: str, second: str, fields: Sequence[str]) -> DataFrame:
    """``rows`` with the table's fields, looked up by one address and, where that finds nothing, by the other. Of several rows of an address one counts."""
    table = last_of_key(table.select(key, *fields), [key])
    a = table.select(F.col(key).alias("_k1"), F.struct(*fields).alias("_f1"))
    b = table.select(F.col(key).alias("_k2"), F.struct(*fields).alias("_f2"))
    joined = rows.join(a, F.col(first) == F.col("_k1"), "left").join(b, F.col("_k1").isNull() & (F.col(second) == F.col("_k2")), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("_f1"), F.col("_f2"))[f].alias(f) for f in fields])


def greedy_distinct(rows: DataFrame, group: str, order: str, first: str, second: str) -> DataFrame:
    """Rows of each group in order, but for those that share either key with a row kept before: sequential by nature.

    Groups are days, whose candidates are few; each is one pandas group. Empty keys never clash.
    """
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, kept = set(), set(), []
        for i, x, y in pdf.sort_values(order)[[first, second]].itertuples():
            if (x and x in a) or (y and y in b):
                continue
            a.add(x)
            b.add(y)
            kept.append(i)
        return pdf.loc[kept]

    return rows.groupBy(group).applyInPandas(keep, rows.schema)


def exploded_map(grouped: DataFrame, field: str = "data", source: str = "source_site") -> DataFrame:
    """Rows of a map from source to array of structs; a row's own source wins over the key, rows without an address go."""
    pairs = grouped.select(F.explode(field).alias("_source", "_rows")).select("_source", F.explode("_rows").alias("_row"))
    rows = pairs.select("_source", "_row.*")
    named = rows.withColumn(source, F.coalesce(F.nullif(F.trim(F.col(source)), F.lit("")), F.col("_source"))) if source in rows.columns else rows.withColumnRenamed("_source", source)
    return named.drop("_source").where("coalesce(trim(pdf_url), '') != '' OR coalesce(trim(url), '') != ''")
