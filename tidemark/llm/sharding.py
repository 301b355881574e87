"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, least movement when a shard is added."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Fixed values of the method: its linear congruential generator and the 31 bits it uses of each step.
MULTIPLIER = 2862933555777941757
STEP_BITS = 31
#: Rows that one numbering task should hold.
ROWS_PER_BUCKET = 200_000


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; only keys whose next jump is still below ``shards`` go round again."""
    key = keys.astype(np.uint64)
    bucket = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    ahead = np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = ahead[live]
            key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            top = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[live] = ((bucket[live] + 1) * (float(1 << STEP_BITS) / top)).astype(np.int64)
            live = live[ahead[live] < shards]
    return bucket


def jump_shard(key: Column, shards: int, kind: T.DataType = T.LongType()) -> Column:
    """``jump`` as a column. A null key counts as key 0; keys that are no whole numbers are hashed to 64 bits by XXH64."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards).astype(np.int32))

    number = key.cast("long") if isinstance(kind, T.IntegralType) else F.when(key.isNotNull(), F.xxhash64(key))
    return shard(F.coalesce(number, F.lit(0).cast("long")))


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", shard_col: str = "shard", grown_col: str | None = None) -> DataFrame:
    """``docs`` with the shard of each row, and with ``grown_col`` the shard it would have if there were one more.

    The key and the number of shards alone decide, so copies and retries agree and no row moves between old shards.
    Null keys go where key 0 goes; rows with equal keys stay together; texts play no part, however long; an empty table stays
    empty. The new columns come last; underscores go before a name that is taken.
    """
    names = fresh(docs, shard_col, *([grown_col] if grown_col else []))
    kind = docs.schema[key].dataType
    return docs.withColumns({n: jump_shard(F.col(f"`{key}`"), shards + i, kind) for i, n in enumerate(names)})


def number(rows: DataFrame, shard: str = "shard", key: str = "doc_id", tie: tuple[str, ...] = (), slot: str = "slot") -> DataFrame:
    """Rows with their place in the shard: 0, 1, 2 ... without a gap, in the order of md5(key).

    A shard may hold an eighth of all rows, so no task sees a shard whole: the order's leading hash digits cut each shard
    into buckets of about ROWS_PER_BUCKET rows, one small table holds how many rows lie before each bucket, and only a
    bucket is sorted in one task. The places don't depend on the number of buckets. Equal rows are numbered in any order; null
    keys count as ''; an empty table stays empty. The place comes last, with underscores before its name if that is taken.
    """
    slot, = fresh(rows, slot)
    order, bucket, before, seen, of_shard, of_bucket = fresh({*rows.columns, slot}, "order", "bucket", "before", "seen", "of_shard", "of_bucket")
    rows = rows.withColumn(order, F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")))
    digits = 1
    n = rows.count()
    while 16**digits * ROWS_PER_BUCKET < n:
        digits += 1
    rows = rows.withColumn(bucket, F.substring(order, 1, digits))
    sizes = rows.groupBy(shard, bucket).agg(F.count("*").alias(seen))
    ahead = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(shard).alias(of_shard), F.col(bucket).alias(of_bucket), F.coalesce(F.sum(seen).over(ahead), F.lit(0)).alias(before))
    inside = Window.partitionBy(shard, bucket).orderBy(order, *tie)
    rows = rows.withColumn(slot, F.row_number().over(inside).cast("long") - 1)
    joined = rows.join(sizes, (F.col(shard) == F.col(of_shard)) & (F.col(bucket) == F.col(of_bucket)))
    return joined.withColumn(slot, F.col(slot) + F.col(before)).drop(order, bucket, before, of_shard, of_bucket)
