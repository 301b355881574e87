"""SimHash near-duplicates: fingerprints of word shingles, compared in bit-sliced blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, hashable, slices, written
from .components import components, forest

#: Bits of a fingerprint, and the seed of the shingle hash.
BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
#: Shingle hashes whose bits are counted at a time.
COUNT_BLOCK = 1 << 16
#: Groups of at most so many share blocks of LANES pairs; larger ones are swept by one fingerprint after the other.
SMALL, LANES = 32, 1 << 14
#: The most nodes of one key that meet in one task.
GROUP = 1 << 15
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of ``size`` lower-cased words, repeats included; of the whole sequence if it is shorter."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    size = min(size, len(words))
    xxh = xxhash.xxh64_intdigest
    return np.array([xxh(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), COUNT_BLOCK):
        part = hashes[i : i + COUNT_BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """``docs`` with a signed 64-bit fingerprint of each whole text. Null, empty and blank texts have fingerprint zero."""
    raw, = fresh(docs, "raw")
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema], T.StructField(out, T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, raw):
            prints = np.array([fingerprint(shingle_hashes(t, size)) for t in texts], np.uint64).view(np.int64)
            keep = [i for i, f in enumerate(part.schema) if f.name != raw]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(prints)], names=[*[part.schema.field(i).name for i in keep], out])

    return docs.withColumn(raw, F.col(text).cast("binary")).mapInArrow(add, schema)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, words): row k holds bit k of all of them, 64 fingerprints in a word."""
    n, bits = len(prints), 64 * prints.shape[1]
    lanes = np.zeros((-(-n // 64) * 64, bits), np.uint8)
    lanes[:n] = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(n, bits // 8), axis=1)
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little")).view("<u8")


def near_lanes(differences: Iterator[np.ndarray], lanes: int, radius: int) -> np.ndarray:
    """The lanes with at most ``radius`` set bits over all planes of ``differences``.

    Two planes at a time enter the lowest plane of the counter through a carry-save adder, and the carries ripple through the
    planes above it; lanes that pass the counter stay in an overflow plane. The block is given up once every lane has passed the radius.
    """
    counter = over = None
    for k, (a, b) in enumerate(zip(differences, differences, strict=True)):
        if counter is None:
            counter, over = np.zeros((max(1, (radius + 1).bit_length()), len(a)), np.uint64), np.zeros(len(a), np.uint64)
        differ = a ^ b
        carry = a & b | counter[0] & differ
        counter[0] ^= differ
        for level in counter[1:]:
            level ^= carry
            carry &= ~level
        over |= carry
        if 2 * k >= radius and k % 8 == 7 and (over | above(counter, radius) == FULL).all():
            return np.zeros(0, np.int64)
    over |= above(counter, radius)
    return np.flatnonzero(np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little")[:lanes])


def above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is more than the radius: a comparison from the highest plane down."""
    more = np.zeros(counter.shape[1], np.uint64)
    same = ~more
    for level in range(len(counter) - 1, -1, -1):
        if radius >> level & 1:
            same = same & counter[level]
        else:
            more = more | same & counter[level]
            same = same & ~counter[level]
    return more


def within(block: np.ndarray, lanes: int, query: np.ndarray, radius: int) -> np.ndarray:
    """Places of a block's fingerprints at most ``radius`` bits from the query, all lanes at once."""
    flips = np.where(np.unpackbits(query.astype(">u8").view(np.uint8)), FULL, np.uint64(0))
    return near_lanes((plane ^ flip for plane, flip in zip(block, flips, strict=True)), lanes, radius)


def joined(prints: np.ndarray, radius: int, confirm: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) that join the same fingerprints as all pairs within the radius, of which ``confirm`` (query, places found)
    may leave some out: each one reached asks those not yet reached.

    What a query reaches leaves the block, so a family around one fingerprint costs few sweeps, and no link is formed twice.
    """
    u, v = [], []
    rest = np.arange(len(prints))
    while len(rest) > 1:
        asking, rest = [int(rest[0])], rest[1:]
        block, alive, held = planes(prints[rest]), np.ones(len(rest), bool), rest
        while asking and alive.any():
            found = within(block, len(held), prints[asking[-1]], radius)
            found = found[alive[found]]
            at = asking.pop()
            if confirm:
                found = np.searchsorted(held, confirm(at, held[found]))
            u.append(np.full(len(found), at))
            v.append(held[found])
            asking += held[found].tolist()
            alive[found] = False
            if 2 * alive.sum() < len(alive) and asking:
                held, alive = held[alive], np.ones(alive.sum(), bool)
                block = planes(prints[held])
        rest = held[alive]
    return (np.concatenate(u), np.concatenate(v)) if u else (rest[:0], rest[:0])


def joined_small(prints: np.ndarray, edges: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places) of many small groups, that lie between ``edges``: all their pairs share the lanes of common blocks."""
    u, v = [], []
    for size in np.unique(np.diff(edges)).tolist():
        starts = edges[:-1][np.diff(edges) == size]
        a, b = np.triu_indices(size, 1)
        for i in range(0, len(starts), max(1, LANES // max(1, len(a)))):
            own = starts[i : i + max(1, LANES // max(1, len(a))), None]
            x, y = (own + a).ravel(), (own + b).ravel()
            if len(x):
                near = near_lanes(iter(planes(prints[x] ^ prints[y])), len(x), radius)
                u.append(x[near])
                v.append(y[near])
    return (np.concatenate(u), np.concatenate(v)) if u else (edges[:0], edges[:0])


def block_keys(radius: int) -> list[tuple[int, int]]:
    """(mask, number) of the tables: the bits fall into radius + 2 blocks, of which two fingerprints at most ``radius`` apart share two."""
    edges = [BITS * i // (radius + 2) for i in range(radius + 3)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [(x | y, i) for i, (x, y) in enumerate(combinations(masks, 2))]


def block_members(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, t, k): each fingerprint under its key in every table. Two fingerprints that differ in at most ``radius`` bits agree on
    two of radius + 2 bit blocks, so each pair meets under one of the keys, whose groups stay small while fingerprints number billions."""
    signed = [(m - (1 << 64) if m >> 63 else m, i) for m, i in block_keys(radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("node").bitwiseAND(F.lit(m).cast("long")).alias("k")) for m, i in signed])
    return nodes.select("node", F.explode(keys).alias("x")).select("node", "x.t", "x.k")


def links(members: DataFrame, prints: DataFrame | None, radius: int, group: int = GROUP) -> DataFrame:
    """Links (u, v) that join the same nodes as all pairs within the radius that meet under a key; ``members``: (node, t, k),
    ``prints``: (node, and the longs of its fingerprint), or None if the node is its fingerprint.

    A task writes only a spanning forest of its groups' links, never all pairs. A key with more than ``group`` nodes is cut by
    a hash into parts, and each pair of parts meets in a task of its own.
    """
    sizes = members.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("t").alias("tt"), F.col("k").alias("kk"), "n")
    met = members.join(sizes, (members["t"] == sizes["tt"]) & (members["k"] == sizes["kk"])).select("node", "t", "k", "n")
    if prints is not None:
        words = [c for c in prints.columns if c != "node"]
        met = met.join(prints.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).drop("of")
    else:
        words = ["word"]
        met = met.withColumn("word", F.col("node"))
    parts = F.ceil(2 * F.col("n") / F.lit(group)).cast("long")
    met = met.withColumn("parts", F.when(F.col("n") > group, parts).otherwise(F.lit(1).cast("long")))
    met = met.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0).cast("long")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = ("t", "k", "a", "b")
    dealt = met.select("node", *words, "t", "k", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b")).repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], 0
        for nodes, own, edges in groups(batches, len(words)):
            found = joined(own, radius) if edges is None else joined_small(own, edges, radius)
            if len(found[0]):
                a, b = forest(nodes[found[0]], nodes[found[1]])
                u.append(a)
                v.append(b)
                n += len(a)
            if n > 1 << 18:
                yield out(u, v)
                u, v, n = [], [], 0
        if u:
            yield out(u, v)

    def out(u: list, v: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(np.concatenate(u), np.concatenate(v))], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long")


def groups(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(nodes, fingerprints, edges) of rows sorted by their last four columns: a large group alone with edges None, and
    the small groups of a batch together with the edges between them. A group goes on over batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(words + 5)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        key = np.stack(cols[-4:])
        starts = np.concatenate([[0], 1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))]) if key.shape[1] else np.zeros(1, int)
        yield from whole([c[: starts[-1]] for c in cols], starts, words)
        held = [c[starts[-1] :] for c in cols]
    if held is not None:
        yield from whole(held, np.array([0, len(held[0])]), words)


def whole(cols: list[np.ndarray], edges: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    prints = np.stack(cols[1 : words + 1], axis=1).view(np.uint64) if len(cols[0]) else np.zeros((0, words), np.uint64)
    size = np.diff(edges)
    for i in np.flatnonzero(size > SMALL).tolist():
        own = slice(edges[i], edges[i + 1])
        yield cols[0][own], prints[own], None
    few = np.flatnonzero((size > 1) & (size <= SMALL))
    if len(few):
        at = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in few.tolist()])
        yield cols[0][at], prints[at], np.concatenate([[0], np.cumsum(size[few])])


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` (all of ``docs`` but the text by default) with ``fingerprint`` (long), and ``component_id``: the smallest key of
    the rows reachable over links; and the names of the two columns.

    Equal fingerprints are one node, so copies cost nothing beyond it; rows without words share fingerprint zero and link like
    any other; null keys take part but are never the smallest unless all are null. An empty table stays empty.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = dict(zip(("fingerprint", "component_id"), fresh({*docs.columns, *keep}, "fingerprint", "component_id"), strict=True))
    fp, id_, t = fresh({*docs.columns, *names.values()}, "fp", "row_key", "row_text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(key).alias(id_), F.col(text).alias(t))
    prints = written(with_fingerprints(rows, t, names["fingerprint"], size).drop(t))
    nodes = prints.groupBy(F.col(names["fingerprint"]).alias("fp")).agg(F.min(id_).alias("low"))
    roots = components(links(block_members(nodes.select(F.col("fp").alias("node")), radius), None, radius))
    known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    known = written(known)
    lows = known.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("least"))
    named = known.join(lows, known["root"] == lows["r"]).select(F.col("fp").alias(fp), F.col("least").alias(names["component_id"]))
    return prints.join(named, F.col(names["fingerprint"]) == F.col(fp)).select(*[F.col(f"`{c}`") for c in keep], *names.values()), names


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest key.

    Of several rows with that key one stays: the one with the smallest hash of its values.
    """
    tag, other, nth = fresh(docs, "row_tag", "row_tag2", "row_nth")
    values = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.withColumns({tag: F.xxhash64(*hashable(docs)), other: F.xxhash64(F.lit(1), *hashable(docs))})
    found = cluster(tagged.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(tag).alias("a"), F.col(other).alias("b")), "id", "text", radius, size)[0]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")).alias("first")
    stays = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("own")).agg(first).select(F.col("first.a").alias("stay_a"), F.col("first.b").alias("stay_b"))
    once = Window.partitionBy(tag, other).orderBy(F.lit(1))
    kept = tagged.join(stays, (F.col(tag) == F.col("stay_a")) & (F.col(other) == F.col("stay_b")), "left_semi")
    return kept.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1).select(*values)
