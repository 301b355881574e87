"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SEED = "mix"
#: Means above this are split into equal parts, each with a uniform number of its own, so that exp(-mean) stays a number.
PART = 500.0
#: A ``total`` of more than so many times the input's rows is refused as a mistake; a single source may be repeated without bound.
MOST_REPEATS = 10_000.0
#: Sources whose rates are sent to all executors; rates of more sources are joined by a shuffle.
MOST_SOURCES = 100_000


def uniform(key: str, part: int = 0, seed: str = SEED) -> float:
    """A number between 0 and 1, both excluded, from 52 bits of an MD5; ``uniforms`` gives the same as a column."""
    return (int(hashlib.md5(f"{seed}:{part}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def inverse_poisson(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The smallest count whose cumulative chance reaches ``u``."""
    count = np.zeros(len(u), np.int64)
    chance = np.exp(-mean)
    total = chance.copy()
    live = np.flatnonzero(total < u)
    while len(live):
        count[live] += 1
        chance[live] *= mean[live] / count[live]
        total[live] += chance[live]
        live = live[(total[live] < u[live]) & (chance[live] > 1e-300)]
    return count


def uniforms(name: Column, mean: Column, seed: str = SEED) -> Column:
    """``uniform`` for each part of a row's mean, as an array."""
    digits = lambda p: F.substring(F.md5(F.concat(F.lit(f"{seed}:"), p.cast("string"), F.lit(":"), name).cast("binary")), 1, 13)
    parts = F.greatest(F.lit(1), F.ceil(mean / PART))
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda p: (F.conv(digits(p), 16, 10).cast("double") + 0.5) / float(1 << 52))


def repeats(draws: pd.Series, means: pd.Series) -> pd.Series:
    """For each row the running number of its copies after each part of its mean, from 0 on; the last one is their count."""
    parts = draws.map(len).to_numpy(np.int64)
    counts = inverse_poisson(np.concatenate([*draws, np.zeros(0)]), np.repeat(means.to_numpy(np.float64) / parts, parts))
    ends = np.cumsum(parts)
    return pd.Series([np.concatenate([[0], np.cumsum(counts[e - n : e])]) for e, n in zip(ends.tolist(), parts.tolist(), strict=True)], dtype=object)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, source: str = "source", key: str = "doc_id", seed: str = SEED, copy: str | None = None, order: str | None = None) -> DataFrame:
    """Each row repeated by a Poisson number whose mean is target rows / present rows of its source; the whole then shuffled.

    ``weights``: target shares by source (sources without one get none; they are normalised over the sources present); None:
    all sources, the null source included, weigh the same. ``total``: target rows, the input's by default. The key decides a
    row's number, so rows with equal keys in a source repeat alike and a retry repeats the same; null keys count as ''. Rows
    go to a partition and a place in it by a hash of key and copy. ``copy`` and ``order`` name columns to keep for the number
    of the repetition (from 1) and the hash. An empty table stays empty. No weighted source present: nothing is left.
    A row's copies are made a part of its mean at a time, so no array holds them all. Empty and very long texts are rows like any other.
    """
    n_copies, n_copy, n_order, n_rate, n_source = fresh(docs, "n_copies", "n_copy", "n_order", "rate", "of_source")
    sizes = docs.groupBy(F.col(source).alias(n_source)).agg(F.count("*").alias("rows"))
    given = F.lit(1.0) if weights is None else F.coalesce(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])[F.coalesce(F.col(n_source), F.lit(""))], F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.withColumn("weight", given)
    all_rows, all_weight, n_sources = sizes.agg(F.sum("rows"), F.sum("weight"), F.count("*")).first()
    target = float(all_rows or 0) if total is None else float(total)
    rates = sizes.select(n_source, (F.col("weight") * F.lit(target) / F.lit(all_weight or 1.0) / F.col("rows")).alias(n_rate))
    if target > MOST_REPEATS * float(all_rows or 0) > 0:
        raise ValueError(f"{target:.0f} rows are asked for, but only {all_rows} are there")
    if n_sources <= MOST_SOURCES:
        rates = F.broadcast(rates)
    draw = F.pandas_udf(repeats, "array<long>")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rated = docs.join(rates, docs[f"`{source}`"].eqNullSafe(F.col(n_source))).drop(n_source)
    drawn = rated.withColumn(n_copies, draw(uniforms(name, F.col(n_rate), seed), F.col(n_rate)))
    spans = F.transform(F.sequence(F.lit(1), F.size(n_copies) - 1), lambda i: F.struct((F.get(n_copies, i - 1) + 1).alias("a"), F.get(n_copies, i).alias("b")))
    parts = drawn.withColumn(n_copies, F.explode(spans)).where(F.col(n_copies)["a"] <= F.col(n_copies)["b"])
    copies = parts.withColumn(n_copy, F.explode(F.sequence(F.col(n_copies)["a"], F.col(n_copies)["b"])))
    placed = copies.withColumn(n_order, F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), name, F.col(n_copy)).cast("binary")))
    dealt = placed.repartition(F.col(n_order)).sortWithinPartitions(n_order)
    extra = [F.col(a).alias(b) for a, b in ((n_copy, copy), (n_order, order)) if b]
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


