"""Suffix-array dedup: bytes of long strings that start at two places go, found by a hash-compared suffix sort.

A sort of every suffix of the corpus would move every byte. Two equal strings of SIZE bytes also agree on the places that
winnowing selects in them (the least hashes of GRAM-byte strings), so only the suffixes at selected places are dealt out, by
the gram that they start with. Contexts that occur twice as a whole need no sort. The different contexts of a gram meet in
one group: there their suffixes, and their reversed prefixes, are sorted by a merge sort that compares two of them by a
binary search over prefix polynomial hashes, and the common extensions of neighbours say which strings occur twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices, written

SIZE = 200
GRAM = 64
#: Bytes that are hashed at a time, and contexts that are sorted at a time (or one group, if that has more).
BLOCK = 1 << 20
SORTED = 1 << 14
#: Different contexts that one group of a gram may have before it is split, and how many times more it may have for each further split.
CROWDED, CROWDED_STEP = 1000, 30
#: The base of the polynomial hashes; odd, so that it has an inverse.
BASE = 0x9E3779B97F4A7C15
SYMBOL = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def slide(a: np.ndarray, width: int, best: np.ufunc, pad: int) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by running values from both ends of blocks of that width."""
    n = len(a)
    b = np.full(-(-n // width) * width, pad, a.dtype)
    b[:n] = a
    b = b.reshape(-1, width)
    from_left = best.accumulate(b, axis=1).ravel()
    from_right = best.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(from_right[: n - width + 1], from_left[width - 1 : n])


class Winnower:
    def __init__(self, size: int = SIZE, gram: int = GRAM):
        self.size, self.gram = size, gram
        n = BLOCK + 4 * size + 1
        self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)

    def select(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, gram hashes) selected in texts that end at ``ends``: the least hashes of each string of ``size`` bytes in a text."""
        size, gram, margin, n = self.size, self.gram, 2 * self.size, len(data)
        for block in range(0, n, BLOCK):
            low, high = max(0, block - margin), min(n, block + BLOCK + margin)
            if high - low < size:
                continue
            d = data[low:high]
            prefix = np.zeros(len(d) + 1, np.uint64)
            np.cumsum(SYMBOL[d] * self.up[: len(d)], out=prefix[1:])
            h = mixed((prefix[gram:] - prefix[: len(d) - gram + 1]) * self.down[: len(d) - gram + 1])
            at = np.arange(low, high)
            left = ends[np.searchsorted(ends, at, "right")] - at if len(ends) < 64 else self.left(ends, low, high)
            h[left[: len(h)] < gram] = np.uint64(0xFFFFFFFFFFFFFFFF)
            width = size - gram + 1
            least = slide(h, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
            least[left[: len(least)] < size] = 0
            room = np.zeros(len(h) + width - 1, np.uint64)
            room[width - 1 : width - 1 + len(least)] = least
            places = np.flatnonzero((h == slide(room, width, np.maximum, 0)) & (h != 0)) + low
            mine = (places >= block) & (places < block + BLOCK)
            yield places[mine], h[places[mine] - low]

    @staticmethod
    def left(ends: np.ndarray, low: int, high: int) -> np.ndarray:
        first, last = np.searchsorted(ends, [low, high - 1], "right")
        own = ends[first : last + 1]
        return np.repeat(own, np.diff(np.concatenate([[low], np.minimum(own, high)]))) - np.arange(low, high)


#: Pairs of gram and context met twice that a task remembers; it forgets them all beyond that.
REMEMBERED = 1 << 20


def selected(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(key, ctx, rid, pos, twice) of all selected places; ``docs``: (rid, raw). ``ctx`` hashes the bytes around that a string over the gram can have.

    Contexts that a task meets twice are settled there: one place stands for them under the gram's key, with ``twice`` set; the
    others are dealt out under keys of their own. So copies, and text that repeats itself, make no hot key. Contexts of texts
    at hand count as equal if their bytes are; of those met before, the task keeps a digest of 128 bits beside the hash.
    """
    reach = size - gram

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(size, gram)
        digest, wide = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        settled: dict[int, bytes] = {}
        for part, texts in slices(batches, "raw"):
            rows = [i for i, t in enumerate(texts) if t and len(t) >= size]
            if not rows:
                continue
            whole = b"".join(texts[i] for i in rows)
            sizes = np.array([len(texts[i]) for i in rows])
            ends = np.cumsum(sizes)
            rids = part.column("rid").to_numpy(zero_copy_only=False)[rows]
            for places, keys in winnow.select(np.frombuffer(whole, np.uint8), ends):
                doc = np.searchsorted(ends, places, "right")
                start, end = ends[doc] - sizes[doc], ends[doc]
                low, high = np.maximum(start, places - reach), np.minimum(end, places + size)
                ctx = np.array([digest(whole[a:b], c) for a, b, c in zip(low.tolist(), high.tolist(), (places - low).tolist(), strict=True)], np.uint64)
                pos = places - start
                pair = mixed(mixed(keys) + ctx)
                met, first, which, n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                if len(settled) > REMEMBERED:
                    settled = {}
                stands, twice = np.zeros(len(pair), bool), np.zeros(len(pair), bool)
                stands[first] = True
                a, b = low.tolist(), high.tolist()
                names = met.tolist()
                heads = first[which]
                for i, j in zip(others := np.flatnonzero(~stands).tolist(), heads[others].tolist(), strict=True):
                    if whole[a[i] : b[i]] == whole[a[j] : b[j]]:
                        twice[i] = twice[j] = True
                    else:
                        stands[i] = True
                before = np.fromiter((x in settled for x in names), bool, len(names))
                for g in np.flatnonzero(before | twice[first]).tolist():
                    i = int(first[g])
                    mark = wide(whole[a[i] : b[i]])
                    if not before[g]:
                        settled[names[g]] = mark
                    elif settled[names[g]] == mark:
                        stands[i], twice[i] = False, True
                own = mixed(mixed(rids[doc].astype(np.int64).view(np.uint64)) + pos.astype(np.uint64) + np.uint64(1))
                keys = np.where(stands, keys, own)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(rids[doc]), pa.array(pos.astype(np.int32)), pa.array(twice)], names=["key", "ctx", "rid", "pos", "twice"])

    return docs.mapInArrow(find, "key long, ctx long, rid long, pos int, twice boolean")


class Contexts:
    """Different contexts of grams: rows of bytes from the gram on and (reversed) before it, with their lengths and groups."""

    def __init__(self, group: np.ndarray, raw: list[bytes], at: np.ndarray, size: int, gram: int):
        self.group, self.reach, self.gram = group, size - gram, gram
        self.sides = []
        for width in (size, size - gram):
            rows = np.zeros((len(raw), width), np.uint8)
            lens = np.zeros(len(raw), np.int64)
            for i, (r, a) in enumerate(zip(raw, at.tolist(), strict=True)):
                x = r[a:] if width == size else r[:a][::-1]
                rows[i, : len(x)] = np.frombuffer(x, np.uint8)
                lens[i] = len(x)
            hashes = np.zeros((len(raw), width + 1), np.uint64)
            np.cumsum(SYMBOL[rows] * powers(BASE, width), axis=1, out=hashes[:, 1:])
            self.sides.append((rows, lens, hashes))

    def sort(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Order by group and then suffix, and each one's common extension with the next (-1 between groups)."""
        rows, lens, hashes = self.sides[side]
        edges = np.concatenate([[0], 1 + np.flatnonzero(self.group[1:] != self.group[:-1]), [len(self.group)]])
        order: list[int] = []
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            order += self.sort_group(range(a, b), rows, lens, hashes)
        o = np.array(order)
        common = self.extension(o[:-1], o[1:], lens, hashes)
        checked = self.extension_by_bytes(o[:-1], o[1:], rows, lens)
        wrong = (checked != common) | ~self.in_order(o[:-1], o[1:], checked, rows, lens)
        if wrong.any():  # hashes of different bytes met: those groups are sorted by their bytes
            for g in np.unique(self.group[o[:-1][wrong]]).tolist():
                own = np.flatnonzero(self.group[o] == g)
                o[own] = sorted(o[own].tolist(), key=lambda i: rows[i, : lens[i]].tobytes())
            checked = self.extension_by_bytes(o[:-1], o[1:], rows, lens)
        return o, np.where(self.group[o[:-1]] == self.group[o[1:]], checked, -1)

    @staticmethod
    def sort_group(members: range, rows: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> list[int]:
        h = dict(zip(members, hashes[members.start : members.stop].tolist(), strict=True))
        n = dict(zip(members, lens[members.start : members.stop].tolist(), strict=True))

        def compare(i: int, j: int) -> int:
            a, b = h[i], h[j]
            low, high = 0, min(n[i], n[j])
            while low < high:
                mid = (low + high + 1) >> 1
                if a[mid] == b[mid]:
                    low = mid
                else:
                    high = mid - 1
            if low == n[i] or low == n[j]:
                return n[i] - n[j]
            return int(rows[i, low]) - int(rows[j, low])

        return sorted(members, key=cmp_to_key(compare))

    @staticmethod
    def extension(i: np.ndarray, j: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.minimum(lens[i], lens[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = hashes[i, mid] == hashes[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            high = np.maximum(low, high)
        return low

    @staticmethod
    def extension_by_bytes(i: np.ndarray, j: np.ndarray, rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
        differ = rows[i] != rows[j]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        return np.minimum(first, np.minimum(lens[i], lens[j]))

    def in_order(self, i: np.ndarray, j: np.ndarray, common: np.ndarray, rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
        at = np.minimum(common, rows.shape[1] - 1)
        ends = (common == lens[i]) | (common == lens[j])
        return (self.group[i] != self.group[j]) | np.where(ends, lens[i] <= lens[j], rows[i, at] < rows[j, at])

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """For each context how far strings that occur twice and hold the gram reach before and after it; -1: no such string.

        A string takes ``o`` bytes before the gram and reach - o after it. It occurs twice if another context is in the same
        class of both orders: as long as neighbours share so many bytes, they and all between are in one class.
        """
        classes = []
        for side in (0, 1):
            order, common = self.sort(side)
            classes.append((order, common))
        n = len(self.group)
        before, after = np.full(n, -1), np.full(n, -1)
        for o in range(self.reach + 1):
            own = []
            for (order, common), need in zip(classes, (self.gram + self.reach - o, o), strict=True):
                ids = np.empty(n, np.int64)
                ids[order] = np.concatenate([[0], np.cumsum(common < need)])
                ids[self.sides[len(own)][1] < need] = -1
                own.append(ids)
            able = np.flatnonzero((own[0] >= 0) & (own[1] >= 0))
            pair = own[0][able] * n + own[1][able]
            s = np.argsort(pair, kind="stable")
            same = pair[s][1:] == pair[s][:-1]
            twice = able[s[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(s) else able
            before[twice] = o
            after[twice] = np.maximum(after[twice], self.reach - o)
        return before, after


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of equal keys from sorted batches, at least SORTED rows of them at a time but for the last."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        keys = batch.column("key").to_numpy()
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if held and n + last >= SORTED and (last or keys[0] != held[-1].column("key")[-1].as_py()):
            yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
            held, n = [batch.slice(last)], len(keys) - last
        elif len(keys):
            held.append(batch)
            n += len(keys)
    if held:
        yield pa.Table.from_batches(held)


def sorted_spans(contexts: DataFrame, size: int, gram: int) -> DataFrame:
    """(rid, start, end) of the bytes that the sort finds in contexts (key, rid, pos, single, at, raw) sorted by key in each partition."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            pos, single, at = (table.column(c).to_numpy() for c in ("pos", "single", "at"))
            before, after = Contexts(table.column("key").to_numpy(), table.column("raw").to_pylist(), at, size, gram).repeated()
            found = np.flatnonzero((before >= 0) & single)
            start, end = pos[found] - before[found], pos[found] + gram + after[found]
            yield pa.RecordBatch.from_arrays([table.column("rid").combine_chunks().take(pa.array(found)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["rid", "start", "end"])

    return contexts.mapInArrow(find, "rid long, start int, end int")


def union(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans in order; spans that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], np.concatenate([reach[first[1:] - 1], reach[-1:]])], axis=1)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, keep: list[str] | None = None, crowded: int = CROWDED) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` (all of ``docs`` by default) with ``kept_raw`` (binary, the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``.

    Every byte of a ``size``-byte string that also starts elsewhere in the table goes, as judged on the input. Null and
    empty texts have no bytes, shorter texts keep all. Rows are told apart by their keys if these are distinct whole numbers, else
    by numbers given to them in a table that is written once; so repeated rows are places of their own strings. A text of any
    length counts whole; an empty table stays empty.
    """
    keep = docs.columns if keep is None else keep
    names = dict(zip(("kept_raw", "n_bytes", "n_removed", "n_spans"), fresh({*docs.columns, *keep}, "kept_raw", "n_bytes", "n_removed", "n_spans"), strict=True))
    kept = [F.col(f"`{c}`") for c in keep]
    ids = docs.agg(F.count("*"), F.count(key), F.countDistinct(key)).first()
    plain = len(set(ids)) == 1 and docs.schema[key].dataType in (T.LongType(), T.IntegerType())
    number, = fresh({*docs.columns, *keep, *names.values()}, "row_number")
    if not plain:
        docs = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rid = F.col(f"`{key}`").cast("long") if plain else F.col(number)
    rid_, raw, marks, spans = fresh({*docs.columns, *keep, *names.values()}, "rid", "raw", "marks", "spans")
    places = selected(docs.select(rid.alias("rid"), F.col(text).cast("binary").alias("raw")), size, gram)
    by_key, by_ctx = Window.partitionBy("key"), Window.partitionBy("key", "ctx")
    known = places.select(
        "key", "ctx", "rid", "pos",
        F.row_number().over(by_ctx.orderBy("rid", "pos")).alias("nth"),
        F.sum(F.when(F.col("twice"), 2).otherwise(1)).over(by_ctx).alias("n"),
        (F.min("ctx").over(by_key) != F.max("ctx").over(by_key)).alias("many"),
    )
    known = known.withColumn("different", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_key))
    splits = F.when(F.col("different") > crowded, F.ceil(F.log(F.col("different") / crowded) / F.log(F.lit(float(CROWDED_STEP))))).otherwise(0).cast("int")
    sort = F.when(F.col("many") & (F.col("nth") == 1), splits).otherwise(-1)
    marked = known.select("rid", "pos", "key", (F.col("n") > 1).alias("whole"), sort.alias("sort")).where("whole OR sort >= 0")
    of_doc = marked.groupBy("rid").agg(F.collect_list(F.struct("pos", "key", "whole", "sort")).alias("m")).select(F.col("rid").alias("of_rid"), F.col("m").alias(marks))
    rows = docs.select(*kept, rid.alias(rid_), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(raw))
    both = rows.join(of_doc, F.col(rid_) == F.col("of_rid"), "left").drop("of_rid")
    contexts = surroundings(both.where(F.col(marks).isNotNull()).select(F.col(rid_).alias("rid"), F.col(raw).alias("raw"), F.col(marks).alias("marks")), size, gram)
    found = sorted_spans(contexts.repartition("key").sortWithinPartitions("key"), size, gram)
    sorted_ = found.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("s")).select(F.col("rid").alias("of_rid"), F.col("s").alias(spans))
    all_ = both.join(sorted_, F.col(rid_) == F.col("of_rid"), "left").drop("of_rid", rid_)
    return remove(all_, keep, names, raw, marks, spans, size, gram), names


def cores(reach: int, splits: int) -> list[tuple[int, int]]:
    """Bytes before and after a gram of which every string over it takes at least one pair: it takes ``reach`` bytes beside
    the gram, so half of them on one side; of the rest again half on one side; and so on. After enough splits a core is a whole string."""
    found = {(0, 0): reach}
    for _ in range(splits):
        step: dict[tuple[int, int], int] = {}
        for (before, after), need in found.items():
            half = -(-need // 2)
            for core in ((before + half, after), (before, after + half)):
                step[core] = max(step.get(core, 0), need - half)
        found = step
    return sorted(found)


def surroundings(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """The contexts that have to be sorted, of rows (rid, raw, marks).

    A gram with a crowd of different contexts (a line that very many documents have) is split: its contexts are dealt out by
    longer cores, of which two that share a string share at least one. Nothing is left out, and no group stays crowded unless
    its members share that much.
    """
    reach = size - gram
    kinds = "key long, rid long, pos int, single boolean, at int, raw binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, split = xxhash.xxh3_64_intdigest, {0: [(0, 0)]}
        for part, texts in slices(batches, "raw"):
            rid = part.column("rid").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            lists = part.column("marks")
            flat, edges = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            pos, keys, whole, sort = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for i, t in enumerate(texts):
                own = np.flatnonzero(sort[edges[i] : edges[i + 1]] >= 0) + edges[i]
                for p, k, w, n in zip(pos[own].tolist(), keys[own].tolist(), whole[own].tolist(), sort[own].tolist(), strict=True):
                    low = max(0, p - reach)
                    raw = t[low : p + size]
                    for before, after in split.setdefault(n, split.get(n) or cores(reach, n)):
                        if n and (p - before < low or p + gram + after > low + len(raw)):
                            continue
                        at = k if not n else (digest(t[p - before : p + gram + after], before) >> 1)
                        for column, value in zip(out, (at, rid[i], p, not w, p - low, raw), strict=True):
                            column.append(value)
            kinds_ = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds_, strict=True)], names=["key", "rid", "pos", "single", "at", "raw"])

    return docs.mapInArrow(cut, kinds)


def remove(docs: DataFrame, keep: list[str], names: dict[str, str], raw: str, marks: str, spans: str, size: int, gram: int) -> DataFrame:
    reach = size - gram
    kinds = {"kept_raw": T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType()}
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *[T.StructField(names[k], v) for k, v in kinds.items()]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, raw):
            stay, n_removed, n_spans = [], [], []
            for t, m, s in zip(texts, part.column(marks).to_pylist(), part.column(spans).to_pylist(), strict=True):
                gone = [(max(0, x["pos"] - reach), min(len(t), x["pos"] + size)) for x in m or () if x["whole"]] + [(x["start"], x["end"]) for x in s or ()]
                gone = union(np.array(gone, np.int64).reshape(-1, 2))
                edges = [0, *gone.ravel().tolist(), len(t)]
                stay.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                n_removed.append(len(t) - len(stay[-1]))
                n_spans.append(len(gone))
            new = [pa.array(stay, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *new], names=schema.names)

    return docs.mapInArrow(apply, schema)
