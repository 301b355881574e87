"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The search symbols are words. For patterns of at least ``m`` words only each pattern's first ``m`` words enter the tables:
a shift table over blocks of ``b`` words says how far the window can move, a bucket for each first word and block that ends a
prefix lists the patterns to test, and a direct comparison of the words confirms an occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices

#: What parts words, and the case rule (A-Z only).
WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
FOLD = bytes(c if c in WORD_BYTES else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
WINDOW = 10
#: Bytes of benchmark text whose tables are held at once; a larger benchmark is searched in several rounds over the same rows.
#: Tables take about 80 times the text.
PATTERN_BYTES = 2 << 20


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text; all bytes from 0x80 belong to words."""
    return text.translate(FOLD).split() if text else []


def windows_of(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``size`` words, or the whole if it has fewer words but not none."""
    if len(words) >= size:
        yield from (tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    elif words:
        yield tuple(words)


class Matcher:
    """Wu-Manber tables for patterns (tuples of words) that all have at least ``m`` words."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        self.patterns = list(patterns)
        self.m = min(map(len, self.patterns))
        self.b = min(2, self.m)
        self.default = self.m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p in self.patterns:
            for end in range(self.b, self.m + 1):
                block = p[end - self.b : end] if self.b > 1 else p[end - 1]
                self.shift[block] = min(self.m - end, self.shift.get(block, self.default))
            self.bucket[p[0], p[self.m - self.b : self.m] if self.b > 1 else p[self.m - 1]].append(p)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        m, shift, bucket, default, two = self.m, self.shift, self.bucket, self.default, self.b > 1
        at, n = m - 1, len(words)
        while at < n:
            block = (words[at - 1], words[at]) if two else words[at]
            move = shift.get(block, default)
            if move:
                at += move
                continue
            start = at - m + 1
            for p in bucket.get((words[start], block), ()):
                if tuple(words[start : start + len(p)]) == p:
                    yield start, p
            at += 1


def tables(items: Iterable[tuple[int, bytes]], size: int = WINDOW) -> tuple[list[Matcher], dict[tuple[bytes, ...], list[int]]]:
    """Matchers for (item id, text) rows, long windows and short items apart so that these don't shorten the others' shifts; and each window's items."""
    owners: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
    for item, text in items:
        for w in set(windows_of(words_of(text), size)):
            owners[w].append(item)
    kinds = [[w for w in owners if len(w) == size], [w for w in owners if len(w) < size]]
    return [Matcher(k) for k in kinds if k], dict(owners)


def rounds(benchmark: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's rows in groups of at most ``most`` bytes (or one row); a partition at a time reaches the driver."""
    held, group = 0, []
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).where("t IS NOT NULL").toLocalIterator():
        t = bytes(row.t)
        if group and held + len(t) > most:
            yield group
            held, group = 0, []
        group.append((row.i, t))
        held += len(t)
    if group:
        yield group


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = PATTERN_BYTES, keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` (all of ``docs`` by default) with what was found, and the names of the added columns.

    Added: ``n_words``, ``spans`` (word ranges, half open, merged), ``items`` (ids of items with an occurring window, null ids
    left out). No row is moved: each round of patterns is one pass of the rows through the tables. Null and empty texts have
    no words; null benchmark texts have no windows; an empty benchmark finds nothing; copies of an item are found like it.
    Item ids that are no whole numbers are given as strings. An empty table stays empty.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = dict(zip(("n_words", "spans", "items"), fresh({*docs.columns, *keep}, "n_words", "spans", "items"), strict=True))
    raw, = fresh({*docs.columns, *names.values()}, "raw")
    id_kind = "bigint" if isinstance(benchmark.schema[item_id].dataType, T.IntegralType) else "string"
    benchmark = benchmark.withColumn(item_id, F.col(f"`{item_id}`").cast(id_kind))
    out = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias(raw), F.lit(None).cast("long").alias(names["n_words"]),
        F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)").alias(names["spans"]), F.expr(f"CAST(array() AS array<{id_kind}>)").alias(names["items"]),
    )
    none = True
    for group in rounds(benchmark, item_id, item_text, most):
        out, none = one_round(spark, out, group, raw, names, size), False
    if none:
        out = one_round(spark, out, [], raw, names, size)
    return out.drop(raw), names


def one_round(spark, docs: DataFrame, group: list[tuple[int, bytes]], raw: str, names: dict[str, str], size: int) -> DataFrame:
    held = spark.sparkContext.broadcast(group)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, owners = tables(held.value, size)
        for part, texts in slices(batches, raw):
            at = {k: part.schema.get_field_index(v) for k, v in names.items()}
            n_words, spans, items = [], [], []
            for t, old_spans, old_items in zip(texts, part.column(at["spans"]).to_pylist(), part.column(at["items"]).to_pylist(), strict=True):
                words = words_of(t)
                found, hit = [(x["start"], x["end"]) for x in old_spans], set(old_items)
                for m in matchers:
                    for start, p in m.find(words):
                        found.append((start, start + len(p)))
                        hit.update(i for i in owners[p] if i is not None)
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged(found)])
                items.append(sorted(hit))
            new = {at["n_words"]: pa.array(n_words, pa.int64()), at["spans"]: pa.array(spans, part.schema.field(at["spans"]).type), at["items"]: pa.array(items, part.schema.field(at["items"]).type)}
            yield pa.RecordBatch.from_arrays([new.get(i, part.column(i)) for i in range(part.num_columns)], names=part.schema.names)

    return docs.mapInArrow(find, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window. Rows without words (null, empty) stay, repeated rows fare alike, a
    text of any length is searched whole, columns of any name are kept, an empty table stays empty."""
    out, names = search(docs, benchmark)
    return out.where(F.size(names["spans"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
