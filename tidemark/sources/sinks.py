"""Writers: snapshots published by compare-and-swap, JSON copies, batched upserts, backups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Stale(RuntimeError):
    """Another writer published first."""


class Invalid(ValueError):
    """A table broke its rules; nothing was published."""


def files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def published(spark: SparkSession, root: str) -> list[int]:
    """The versions that have a marker."""
    fs, p = files(spark, f"{root}/_published")
    return [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()] if fs.exists(p) else []


def current_version(spark: SparkSession, root: str) -> int:
    """The highest published version, 0 before the first."""
    return max(published(spark, root), default=0)


def folder(spark: SparkSession, root: str, version: int) -> str:
    """Where a version's tables are: the marker holds the name of the folder that its writer filled."""
    fs, marker = files(spark, f"{root}/_published/{version}")
    stream = fs.open(marker)
    try:
        return f"{root}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def load(spark: SparkSession, root: str, names: Iterable[str]) -> tuple[int, dict[str, DataFrame]]:
    version = current_version(spark, root)
    if not version:
        return 0, {}
    path = folder(spark, root, version)
    return version, {n: spark.read.parquet(f"{path}/{n}") for n in names}


def broken(df: DataFrame, rules: Mapping[str, Column]) -> dict[str, int]:
    """Rows that break each rule, in one pass."""
    if not rules:
        return {}
    row = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]).first()
    return {k: v for k, v in row.asDict().items() if v}


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], loaded: int, rules: Mapping[str, Mapping[str, Column]] | None = None) -> int:
    """Write all tables as one new version, if they keep their rules and ``loaded`` is still the published version.

    Files of the version are written first, to a folder of their own. The marker that names this folder is then put in place by
    a rename that fails if the version has one: only one of several writers can win, and one that dies before leaves nothing
    that stops others. A loser's files are removed, readers never see a part.
    """
    for name, df in tables.items():
        if faults := broken(df, (rules or {}).get(name, {})):
            raise Invalid(f"{name}: {faults}")
    if current_version(spark, root) != loaded:
        raise Stale(f"version {loaded} is no longer the published one")
    version, name_ = loaded + 1, f"v={loaded + 1}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name_}/{name}")
    fs, marker = files(spark, f"{root}/_published/{version}")
    fs.mkdirs(marker.getParent())
    jvm = spark._jvm.org.apache.hadoop.fs
    draft = files(spark, f"{root}/_drafts/{name_}")[1]
    stream = fs.create(draft)
    stream.write(name_.encode())
    stream.close()
    try:
        context = jvm.FileContext.getFileContext(marker.toUri(), spark._jsc.hadoopConfiguration())
        context.rename(draft, marker, spark._sc._gateway.new_array(jvm.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        fs.delete(files(spark, f"{root}/{name_}")[1], True)
        raise Stale(f"version {version} was taken by another writer") from e
    return version


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def in_batches(df: DataFrame, send: Callable[[list[dict]], None], size: int = 100) -> None:
    """Rows to an external store, ``size`` at a time from each task; ``send`` has to be idempotent, since tasks may run twice."""
    def each(rows: Iterable) -> None:
        held: list[dict] = []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) == size:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(each)


def drop_old(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Remove all but the last ``keep`` versions."""
    fs, _ = files(spark, root)
    now = current_version(spark, root)
    gone = sorted(v for v in published(spark, root) if v <= now - keep)
    for v in gone:
        fs.delete(files(spark, folder(spark, root, v))[1], True)
        fs.delete(files(spark, f"{root}/_published/{v}")[1], False)
    return gone
