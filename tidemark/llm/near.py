"""SimHash near-duplicates by similarity: bit-sliced comparison of wide fingerprints proposes, the exact Jaccard similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hashable, slices, written
from .components import components
from .simhash import COUNT_BLOCK, SEED, joined, links, shingle_hashes

SHINGLE = 5
#: Texts are near-duplicates from this similarity on, as a fraction.
LEAST = (4, 5)
#: Longs of a fingerprint, and the bits in which two may differ to be compared exactly. At a similarity of 0.8 they differ in
#: 39 of 256 with a standard deviation of 6; in sets of five shingles in 48.
WORDS, RADIUS = 4, 68
#: Keys under which texts meet: hashes of so many smallest values each. Two sets of similarity 0.8 share none of them with a
#: chance of (1 - 0.8**5)**40 = 1.3e-7.
BANDS, ROWS = 40, 5
#: Shingles that are hashed at a time, and the most shingles of a group that meet in one task.
BLOCK, GROUP_SHINGLES = 1 << 11, 1 << 22
#: So many texts to compare are looked up by a broadcast of their rows' hashes; more by a shuffle.
MOST_SENT = 200_000

RNG = np.random.default_rng(SEED)
TIMES = RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
PLUS = RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; of the whole sequence if it is shorter than one."""
    return np.unique(shingle_hashes(text, size))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A hash of each band of smallest values; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), BLOCK):
        x = hashes[i : i + BLOCK, None] * TIMES
        x += PLUS
        np.minimum(low, x.min(axis=0), out=low)
    out = np.arange(1, BANDS + 1).astype(np.uint64) * MIX
    for column in low.reshape(BANDS, ROWS).T:
        out = (out ^ column) * MIX
        out ^= out >> np.uint64(29)
    return out


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """``words`` longs; a bit is 1 if it is set in more than half of the set's hashes. Each long takes another mix of them."""
    ones = np.zeros((words, 64), np.int64)
    for i in range(0, len(hashes), COUNT_BLOCK):
        part = hashes[i : i + COUNT_BLOCK]
        for w in range(words):
            mixed = (part ^ (part >> np.uint64(31))) * (MIX + np.uint64(2 * w))
            mixed ^= mixed >> np.uint64(32)
            ones[w] += np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1).view(">u8").ravel().astype(np.uint64)


def with_sets(docs: DataFrame, text: str, size: int) -> DataFrame:
    """The other columns with ``node``, a 64-bit hash of the set of shingles, ``bands``, the longs of the fingerprint and ``n``, the size of the set."""
    rest = [f for f in docs.schema if f.name != text]
    longs = [f"w{i}" for i in range(WORDS)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            nodes, keys, prints, sizes = [], [], [], []
            for t in texts:
                s = shingles(t, size)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                keys.append(bands(s).view(np.int64))
                prints.append(wide_fingerprint(s))
                sizes.append(len(s))
            kept = [part.column(part.schema.get_field_index(f.name)) for f in rest]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            wide = [pa.array(c) for c in np.array(prints, np.uint64).reshape(-1, WORDS).T.copy().view(np.int64)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(nodes, np.uint64).view(np.int64)), lists, *wide, pa.array(sizes, pa.int64())], names=[*[f.name for f in rest], "node", "bands", *longs, "n"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return docs.mapInArrow(add, f"{names}, node long, bands array<long>, {', '.join(f'{w} long' for w in longs)}, n long")


def similar(sets: list[np.ndarray], query: int, others: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Those of ``others`` whose Jaccard similarity with the query is at least ``least``; an empty set is like none but an empty one."""
    own = sets[query]
    sizes = np.array([len(sets[i]) for i in others.tolist()], np.int64)
    if not len(own):
        return others[sizes == 0]
    others, sizes = others[sizes > 0], sizes[sizes > 0]
    if not len(others):
        return others
    flat = np.concatenate([sets[i] for i in others.tolist()])
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat(own[at] == flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return others[both * least[1] >= (len(own) + sizes - both) * least[0]]


def exact_links(groups: DataFrame, size: int, least: tuple[int, int], radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that join the same nodes as all similar pairs of a group within the radius; ``groups``: (g, a, b, node, raw), all rows of a
    (g, a, b) next to each other. The bit-sliced comparison names those whose sets are then compared with the query's."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            for part, texts in slices([batch], "raw"):
                columns = [part.column(i).to_pylist() for i in range(4)]
                for g, a, b, node, t in zip(*columns, texts, strict=True):
                    if (g, a, b) != key:
                        yield from out(held)
                        held, key = [], (g, a, b)
                    held.append((node, shingles(t, size)))
        yield from out(held)

    def out(held: list) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            nodes, sets = np.array([x[0] for x in held]), [x[1] for x in held]
            u, v = joined(np.array([wide_fingerprint(s) for s in sets]), radius, lambda q, found: similar(sets, q, found, least))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], names=["u", "v"])

    return groups.mapInArrow(compare, "u long, v long")


def near_groups(nodes: DataFrame, rows: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST, group: int = GROUP_SHINGLES) -> DataFrame:
    """(node, root) of the nodes in groups joined by similar pairs; ``nodes``: node, bands, w0.., n and the (na, nb) of a row with its text;
    ``rows``: a, b, text.

    Nodes that share a key and whose fingerprints lie within the radius are joined first, on fingerprints alone. No similar
    pair lies across these rough groups, so each node sends its text to one place only, where the exact similarity decides. A
    rough group of more than ``group`` shingles is cut in parts, and each pair of parts meets in a task of its own.
    """
    members = nodes.select("node", F.lit(0).alias("t"), F.explode("bands").alias("k"))
    rough = written(components(links(members, nodes.select("node", *[f"w{i}" for i in range(WORDS)]), RADIUS)).select(F.col("node").alias("of"), F.col("root").alias("g")), "rough")
    wanted = written(nodes.join(rough, F.col("node") == F.col("of")).select("node", "g", "n", "na", "nb"), "wanted")
    sizes = wanted.groupBy("g").agg(F.sum("n").alias("all")).select(F.col("g").alias("sg"), F.ceil(2 * F.col("all") / F.lit(group)).cast("long").alias("parts"))
    placed = wanted.join(sizes, F.col("g") == F.col("sg")).withColumn("parts", F.when(F.col("parts") > 2, F.col("parts")).otherwise(1))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = placed.select("g", F.least("own", "other").alias("pa"), F.greatest("own", "other").alias("pb"), "node", "na", "nb")
    few = F.broadcast(placed) if wanted.count() <= MOST_SENT and not placed.where("pa != pb").head(1) else placed
    asked = rows.join(few, (F.col("a") == F.col("na")) & (F.col("b") == F.col("nb"))).select("g", "pa", "pb", "node", F.col("text").alias("raw"))
    met = asked.repartition("g", "pa", "pb").sortWithinPartitions("g", "pa", "pb", "node")
    return components(exact_links(met, size, least))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` with one row of each group of texts that are joined by similar pairs: the one with the smallest key.

    Texts with equal sets of shingles are one node, so exact copies cost nothing beyond it; texts without words (null, empty,
    blank) are one group; a text of any length counts whole. A null key is larger than any other. Of several rows with that key
    one stays: the one with the smallest hash of its values. Columns of any type and name are kept as they are; an empty table stays empty.
    """
    tag, other, nth = fresh(docs, "row_tag", "row_tag2", "row_nth")
    values = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.withColumns({tag: F.xxhash64(*hashable(docs)), other: F.xxhash64(F.lit(1), *hashable(docs))})
    raw = F.col(f"`{text}`").cast("binary").alias("text")
    rows = tagged.select(F.col(f"`{key}`").alias("id"), F.col(tag).alias("a"), F.col(other).alias("b"), raw)
    best = F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")
    firsts = [F.first(c).alias(c) for c in ("bands", *[f"w{i}" for i in range(WORDS)], "n")]
    nodes = written(with_sets(rows, "text", size).groupBy("node").agg(F.min(best).alias("best"), *firsts), "nodes")
    roots = near_groups(nodes.withColumns({"na": F.col("best.a"), "nb": F.col("best.b")}), rows.select("a", "b", "text"), size, least)
    ranked = nodes.select("node", "best").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    stays = ranked.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("best").alias("best")).select(F.col("best.a").alias("stay_a"), F.col("best.b").alias("stay_b"))
    once = Window.partitionBy(tag, other).orderBy(F.lit(1))
    kept = tagged.join(stays, (F.col(tag) == F.col("stay_a")) & (F.col(other) == F.col("stay_b")), "left_semi")
    return kept.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*values)
