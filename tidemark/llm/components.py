"""Connected components of a table of links, by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, written

#: Links that a task joins at a time before it writes the forest they make.
FOREST_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) pairs that join the same nodes as the links (a, b), one for each node that is not the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            deeper = new[new]
            if (deeper == new).all():
                break
            new = deeper
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        if held:
            a, b = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            u, v = forest(a, b)
            held, n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        n += batch.num_rows
        if n >= FOREST_LINKS:
            yield from flush()
    yield from flush()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v) of longs; the root is the smallest node reachable.

    Rounds of two steps on the table: every node's larger neighbours are linked to its smallest neighbour, then its smaller
    ones are (the large-star and small-star of Kiveris et al., 2014), until the table is made of stars. Smallest neighbours are found by an
    aggregation that combines before its shuffle, so a node in a third of all links is no hot key there; the join back to
    the links is one that Spark can split. Every round is written to the shared folder. No link, node or component reaches the driver.
    """
    links = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(contract, "u long, v long").distinct(), "links")
    while not stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
        large = both.join(low, both["u"] == low["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(low, large["u"] == low["n"])
        star = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
        before, links = links, written(star.where("u != v").distinct(), "links")
        remove(before)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller node that itself has none to a smaller one: then each smaller node is the
    smallest of its component, since the rounds keep what is joined."""
    twice = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    inner = links.join(links.select(F.col("v").alias("low")).distinct(), F.col("u") == F.col("low"), "left_semi")
    return twice.select("u").unionByName(inner.select("u")).isEmpty()
