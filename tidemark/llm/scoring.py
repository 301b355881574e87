"""Language-model scores: masked pseudo-likelihood of a bidirectional window network over the words of a corpus.

Every token is predicted from both sides. The network gives the chance of the token's class between the classes of its
neighbours; the corpus counts give the chance of the word within its class, and a model of spelling that of words outside the
vocabulary. Where both neighbours are rarer words, what else the corpus has between the same two is mixed in: these contexts
are held in full, dealt out over the executors, and grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, remove, slices, written
from .decontam import words_of

#: Classes: each of the most frequent words is one, all others fall into classes by their endings.
FREQUENT = 96
ENDINGS = 32
#: Words with a chance of their own within their class; the spelling says how likely any other is.
VOCABULARY = 50_000
#: A context is kept if both neighbours are outside so many most frequent words. So none holds more than this part of all tokens.
COMMON = 128
HIDDEN = 24
EPOCHS = 150
#: Distinct words that a task counts before it passes the counts on, and tokens that it deals out at a time.
COUNTED, DEALT, DEALT_ROWS = 400_000, 1 << 20, 1 << 16
#: Tokens of one part of the contexts, of which a task holds one at a time, and parts that a task deals with, so that tasks even out.
PART_TOKENS, PARTS_A_TASK = 1 << 19, 4
#: A context met as often elsewhere weighs as much as the network.
DOUBT = 1.0
#: In the spelling model a longer history that was seen so often weighs as much as the shorter one.
SPELL_DOUBT = 4.0
EDGE_HASH = np.uint64(0x5851F42D4C957F2D)


class Lexicon:
    """What a task knows of each word it met: its class, hash, whether it is common, and its log chance within its class."""

    def __init__(self, model: Model | None, frequent: list[bytes], endings: int):
        self.model, self.first, self.endings = model, len(frequent), endings
        self.size = len(frequent) + endings
        self.start(frequent)

    def start(self, frequent: list[bytes]) -> None:
        self.frequent, self.words = frequent, []
        self.at: dict[bytes, int] = {}
        self.kind, self.hash, self.common, self.within = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.float32)
        self.add(frequent)

    def class_of(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-2:]) % self.endings

    def add(self, words: list[bytes]) -> None:
        if not words:
            return
        known = len(self.at)
        self.words += words
        self.at |= zip(words, range(known, known + len(words)), strict=True)
        kind = np.arange(self.first) if not known else np.fromiter(map(self.class_of, words), np.int64, len(words))
        self.kind = np.concatenate([self.kind, kind])
        if self.model:
            self.hash = np.concatenate([self.hash, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))])
            self.common = np.concatenate([self.common, np.fromiter(map(self.model.common.__contains__, words), bool, len(words))])
            self.within = np.concatenate([self.within, self.model.within(words, kind)])

    def ids(self, words: list[bytes]) -> np.ndarray:
        """A number for each token, under which the arrays have the word."""
        out = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if len(new):
            missing = [words[i] for i in new.tolist()]
            self.add(sorted(set(missing)))
            out[new] = np.fromiter(map(self.at.__getitem__, missing), np.int64, len(missing))
        return out

    def sides(self, values: np.ndarray, ends: np.ndarray, edge) -> tuple[np.ndarray, np.ndarray]:
        """Each token's left and right neighbour in texts that end at ``ends``, ``edge`` outside of them."""
        left, right = np.concatenate([[edge], values[:-1]]).astype(values.dtype), np.concatenate([values[1:], [edge]]).astype(values.dtype)
        left[ends[:-1]] = edge
        right[ends[:-1] - 1] = edge
        return left, right

    def cells(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each token: the classes of its left neighbour, right neighbour (``size`` at the ends) and itself as one number."""
        t = self.kind[ids]
        left, right = self.sides(t, ends, self.size)
        return (left * (self.size + 1) + right) * self.size + t


def flat(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts, the ends of those that have any, and the numbers of words of all."""
    found = [words_of(t) for t in texts]
    n = np.array([len(w) for w in found], np.int64)
    return list(chain.from_iterable(found)), np.cumsum(n[n > 0]), n


def word_counts(docs: DataFrame, raw: str) -> DataFrame:
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for _, texts in slices(batches, raw):
            for t in texts:
                seen.update(words_of(t))
            if len(seen) > COUNTED:
                yield as_batch(seen)
                seen = Counter()
        yield as_batch(seen)

    def as_batch(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    return docs.select(raw).mapInArrow(tally, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words that occur at least so often that there are no more than ``most``, and twice, by count and bytes. The bound is found from
    a histogram of counts in steps of a 64th of a doubling, so that what reaches the driver does not grow with the partitions."""
    level = F.floor(F.log2("n") * 64).cast("int")
    counts = written(counts.where("n > 1").withColumn("level", level), "words")
    bound, total = None, 0
    for r in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        bound = r["level"]
    found = counts.where(F.col("level") >= bound).select("word", "n").collect() if bound is not None else []
    remove(counts)
    return sorted(((bytes(r.word), r.n) for r in found), key=lambda x: (-x[1], x[0]))


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Three successive bytes as one number for every byte of every word and its end, spaces before it; and the words' ends."""
    text = np.frombuffer(b"".join(b"  " + w + b" " for w in words), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 3
    cells = (text[:-2] << 16) | (text[1:-1] << 8) | text[2:]
    inner = np.ones(len(text), bool)
    starts = np.cumsum(size) - size
    inner[starts] = inner[starts + 1] = False
    return cells[inner[2:]], np.cumsum(size - 2)


def cell_counts(docs: DataFrame, raw: str, frequent: list[bytes], endings: int, vocabulary: set[bytes]) -> DataFrame:
    """(spelling, cell, n): counts of (left, right, token) classes, and of three successive bytes in tokens outside the vocabulary."""
    size = len(frequent) + endings

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen, own = Lexicon(None, frequent, endings), np.zeros((size + 1) ** 2 * size, np.int64), np.zeros(0, np.int64)
        for _, texts in slices(batches, raw):
            words, ends, _ = flat(texts)
            if words:
                ids = lexicon.ids(words)
                cells = lexicon.cells(ids, ends)
                seen += np.bincount(cells, minlength=len(seen))
                n = np.bincount(ids, minlength=len(lexicon.words))
                n[: len(own)] += own
                own = n
            if len(own) > COUNTED:
                yield from spelled(lexicon.words, own)
                lexicon.start(frequent)
                own = own[:0]
        yield from spelled(lexicon.words, own)
        at = np.flatnonzero(seen)
        yield from out(False, at, seen[at])

    def spelled(words: list[bytes], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        rare = [i for i, w in enumerate(words[: len(n)]) if n[i] and w not in vocabulary]
        if rare:
            cells, ends = trigrams([words[i] for i in rare])
            met, which = np.unique(cells, return_inverse=True)
            yield from out(True, met, np.bincount(which, np.repeat(n[rare], np.diff(ends, prepend=0))).astype(np.int64))

    def out(spelling: bool, cells: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(cells), 1 << 17):
            part = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells[part]), spelling)), pa.array(cells[part]), pa.array(n[part])], names=["spelling", "cell", "n"])

    return docs.select(raw).mapInArrow(tally, "spelling boolean, cell long, n long").groupBy("spelling", "cell").agg(F.sum("n").alias("n"))


class Spelling:
    """The chance of a word's bytes, each after the two before it, learned from counts of three successive bytes."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        order = np.argsort(cells)
        self.cells, self.counts = cells[order], counts[order].astype(np.float64)
        self.two, which = np.unique(self.cells >> 8, return_inverse=True)
        self.two_n = np.bincount(which, self.counts, len(self.two))
        pair, which = np.unique(self.cells & 0xFFFF, return_inverse=True)
        self.pair = np.zeros((256, 256))
        self.pair.ravel()[pair] = np.bincount(which, self.counts, len(pair))
        self.pair = (self.pair + SPELL_DOUBT / 256) / (self.pair.sum(axis=1, keepdims=True) + SPELL_DOUBT)

    @staticmethod
    def look(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(asked))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], 0.0)

    def log_chances(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        cells, ends = trigrams(words)
        seen, all_ = self.look(self.cells, self.counts, cells), self.look(self.two, self.two_n, cells >> 8)
        logs = np.log((seen + SPELL_DOUBT * self.pair.ravel()[cells & 0xFFFF]) / (all_ + SPELL_DOUBT))
        return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]))


class Network:
    """A hidden layer over the two neighbours, and a softmax over the masked token."""

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.size = size
        shapes = {"left": (size + 1, hidden), "right": (size + 1, hidden), "inner": (hidden,), "out": (hidden, size), "bias": (size,)}
        self.p = {k: (rng.normal(0, 0.1, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}

    def hidden(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.tanh(self.p["left"][left] + self.p["right"][right] + self.p["inner"])

    def log_chances(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = self.hidden(left, right) @ self.p["out"] + self.p["bias"]
        x -= x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    def table(self) -> np.ndarray:
        """Log chances of every class between every two neighbours."""
        n = self.size + 1
        context = np.arange(n * n)
        return self.log_chances(context // n, context % n).astype(np.float32)

    def train(self, cells: np.ndarray, counts: np.ndarray, epochs: int = EPOCHS) -> list[float]:
        """Adam on the corpus counts, all of them in every step: the order in which they came has no part in it. Returns the losses."""
        n = self.size + 1
        context, token = np.divmod(cells, self.size)
        met, row = np.unique(context, return_inverse=True)
        left, right = met // n, met % n
        target = np.zeros((len(met), self.size), np.float32)
        target[row, token] = counts / counts.sum()
        weight = target.sum(axis=1, keepdims=True)
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, epochs + 1):
            h = self.hidden(left, right)
            logs = self.log_chances(left, right)
            losses.append(float(-(target * logs).sum()))
            d = np.exp(logs) * weight - target
            dh = (d @ self.p["out"].T) * (1 - h * h)
            grads = {"out": h.T @ d, "bias": d.sum(axis=0), "inner": dh.sum(axis=0), "left": np.zeros_like(self.p["left"]), "right": np.zeros_like(self.p["right"])}
            np.add.at(grads["left"], left, dh)
            np.add.at(grads["right"], right, dh)
            rate = 0.05 * (1 - step / (epochs + 1)) + 0.002
            for k, g in grads.items():
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                self.p[k] -= (rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-9)).astype(np.float32)
        return losses


class Model:
    """The network, the words' counts within their classes, and the spelling of all other words."""

    def __init__(self, words: list[tuple[bytes, int]], frequent: int, endings: int, common: int, cells: np.ndarray, counts: np.ndarray, spelling: Spelling, epochs: int):
        self.frequent, self.endings = [w for w, _ in words[:frequent]], endings
        self.common = {w for w, _ in words[:common]}
        self.net = Network(len(self.frequent) + endings)
        if len(cells):
            self.net.train(cells, counts.astype(np.float64), epochs)
        own = Lexicon(None, self.frequent, endings)
        self.counts = dict(words[frequent:])
        self.of_class = np.bincount(cells % own.size, counts, own.size) if len(cells) else np.zeros(own.size)
        in_vocabulary = np.zeros(own.size)
        for w, n in self.counts.items():
            in_vocabulary[own.class_of(w)] += n
        #: Tokens of each class outside the vocabulary. Half a token more, so that no word is impossible.
        self.rare = np.maximum(0, self.of_class - in_vocabulary)
        self.rare[: len(self.frequent)] = 0
        self.spelling, self.tokens = spelling, int(self.of_class.sum())

    def within(self, words: list[bytes], kind: np.ndarray) -> np.ndarray:
        """Log chances of words within their classes: counts in the corpus; of other words their spelling, as a part of the
        spellings that fall into the class. One for a word that is a class."""
        out = np.zeros(len(words))
        known = np.fromiter((self.counts.get(w, 0) for w in words), np.float64, len(words))
        inner = kind >= len(self.frequent)
        have = inner & (known > 0)
        out[have] = np.log(known[have] / (self.of_class[kind[have]] + 0.5))
        new = np.flatnonzero(inner & (known == 0))
        part = (self.rare + 0.5) / (self.rare[len(self.frequent) :].sum() + 0.5 * self.endings)
        chance = np.minimum(0.0, self.spelling.log_chances([words[i] for i in new.tolist()]) - np.log(part[kind[new]]))
        out[new] = chance + np.log((self.rare[kind[new]] + 0.5) / (self.of_class[kind[new]] + 0.5))
        return out.astype(np.float32)


def fit(docs: DataFrame, text: str = "text", frequent: int = FREQUENT, endings: int = ENDINGS, epochs: int = EPOCHS, vocabulary: int = VOCABULARY, common: int = COMMON) -> Model:
    """The model of a whole corpus: two counts over all tokens of all rows.

    Words, of which those at least as frequent as a bound reach the driver, ``vocabulary`` at most; then (left, right, token)
    triples of classes, at most (size + 1)**2 * size rows whatever the input, and three successive bytes of all other words, at most 2**24.
    Null texts have no words. An empty corpus gives a model that knows nothing.
    """
    raw, = fresh(docs, "raw")
    rows = docs.select(F.col(f"`{text}`").cast("binary").alias(raw)).where(F.col(raw).isNotNull())
    top = most_frequent(word_counts(rows, raw), vocabulary)
    seen = cell_counts(rows, raw, [w for w, _ in top[:frequent]], endings, {w for w, _ in top}).orderBy("spelling", "cell").toArrow()
    spells = seen["spelling"].to_numpy()
    cells, counts = seen["cell"].to_numpy(), seen["n"].to_numpy()
    return Model(top, frequent, endings, common, cells[~spells], counts[~spells], Spelling(cells[spells], counts[spells]), epochs)


DEALT_KINDS = "part int, chunk long, a binary, b binary, c binary, own boolean"


def dealt(rows: DataFrame, model: Model, parts: int) -> DataFrame:
    """The contexts of ``rows`` (rid, raw), packed by part: (a) 40 bits of the context's hash and 24 of the word's, (b) the log
    chance without the context, (c) the place of its row in the chunk. One more row for each chunk (``own``) has (a) the rows' ids,
    (b) their sums of log chances and (c) their numbers of tokens."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, logs = Lexicon(model, model.frequent, model.endings), model.net.table().ravel()
        held, n_tokens, n_rows = [], 0, 0
        for part, texts in slices(batches, "raw"):
            rids = part.column("rid").to_numpy(zero_copy_only=False)
            if len(lexicon.words) > COUNTED:
                lexicon.start(model.frequent)
            for i in range(0, len(texts), DEALT_ROWS):
                if n_rows and (n_tokens > DEALT or n_rows + min(DEALT_ROWS, len(texts) - i) > DEALT_ROWS):
                    yield from pack(held)
                    held, n_tokens, n_rows = [], 0, 0
                own = rids[i : i + DEALT_ROWS]
                held.append((own, *measure(lexicon, logs, texts[i : i + DEALT_ROWS])))
                n_rows += len(own)
                n_tokens += len(held[-1][3])
        if held:
            yield from pack(held)

    def measure(lexicon: Lexicon, logs: np.ndarray, texts: list) -> tuple:
        words, ends, n = flat(texts)
        if not words:
            return np.zeros(len(n)), n, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.float16), np.zeros(0, np.int64)
        ids = lexicon.ids(words)
        log = logs[lexicon.cells(ids, ends)] + lexicon.within[ids]
        row = np.repeat(np.arange(len(n)), n)
        total = np.bincount(row, log, len(n))
        rare_left, rare_right = lexicon.sides(~lexicon.common[ids], ends, False)
        at = np.flatnonzero(rare_left & rare_right)
        left, right = (x[at] for x in lexicon.sides(lexicon.hash[ids], ends, EDGE_HASH))
        context = mixed(mixed(left) + right)
        return total, n, context, lexicon.hash[ids[at]], log[at].astype(np.float16), row[at]

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0, *[len(h[0]) for h in held]])
        rids, total, n, context, word, log, row = (np.concatenate([h[i] for h in held]) for i in range(7))
        row = row + np.repeat(before[:-1], [len(h[3]) for h in held])
        chunk = xxhash.xxh3_64_intdigest(rids.tobytes()) >> 1
        where = ((context >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(where, kind="stable")
        packed = (context[order] << np.uint64(24)) | (word[order] & np.uint64(0xFFFFFF))
        log, row = log[order], row[order].astype(np.uint16)
        met, starts = np.unique(where[order], return_index=True)
        ends = [*starts[1:].tolist(), len(order)][: len(starts)]
        out = [(int(p), chunk, packed[s:e].tobytes(), log[s:e].tobytes(), row[s:e].tobytes(), False) for p, s, e in zip(met.tolist(), starts.tolist(), ends, strict=True)]
        out.append((chunk % parts, chunk, rids.tobytes(), total.tobytes(), n.tobytes(), True))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        for i in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[i : i + 256], strict=True), kinds, strict=True)], names=["part", "chunk", "a", "b", "c", "own"])

    return rows.mapInArrow(deal, DEALT_KINDS)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gains(packed: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens whose context was met elsewhere, and what that adds to their log chances.

    Between the same two neighbours, ``n - 1`` of ``all - 1`` other tokens are this word: that part, weighed by how many there are,
    is mixed with the chance without the context. A token's own occurrence never counts for it.
    """
    order = np.argsort(packed)
    p = packed[order]
    if not len(p):
        return order, np.zeros(0)

    def runs(new: np.ndarray) -> np.ndarray:
        size = np.diff(np.flatnonzero(np.concatenate([[True], new, [True]])))
        return np.repeat(size, size)

    word, all_ = runs(p[1:] != p[:-1]), runs(p[1:] >> np.uint64(24) != p[:-1] >> np.uint64(24))
    met = np.flatnonzero(all_ > 1)
    word, others, base = word[met] - 1, all_[met] - 1, log[order[met]].astype(np.float64)
    weight = others / (others + DOUBT)
    return order[met], np.log(weight * word / others + (1 - weight) * np.exp(base)) - base


def contexts_added(deal: DataFrame) -> DataFrame:
    """(chunk, a, b, c, own): for each part and chunk the places of rows with what their contexts add; the chunks' own rows pass."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for part, chunk, a, b, c, own in zip(*columns, strict=True):
                if own:
                    yield out([(chunk, a, b, c, True)])
                    continue
                if part != last:
                    yield from settle(held)
                    held, last = [], part
                held.append((chunk, np.frombuffer(a, np.uint64), np.frombuffer(b, np.float16), np.frombuffer(c, np.uint16)))
        yield from settle(held)

    def settle(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            at, gain = gains(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            edges = np.cumsum([0, *[len(h[1]) for h in held]])
            rows = np.concatenate([h[3] for h in held])
            order = np.argsort(at)
            at, gain = at[order], gain[order]
            cuts = np.searchsorted(at, edges)
            made = []
            for i, h in enumerate(held):
                own = slice(cuts[i], cuts[i + 1])
                if cuts[i] < cuts[i + 1]:
                    met, which = np.unique(rows[at[own]], return_inverse=True)
                    made.append((h[0], met.tobytes(), np.bincount(which, gain[own], len(met)).tobytes(), b"", False))
            for i in range(0, len(made), 256):
                yield out(made[i : i + 256])

    def out(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "a", "b", "c", "own"])

    return deal.mapInArrow(add, "chunk long, a binary, b binary, c binary, own boolean")


def row_scores(added: DataFrame) -> DataFrame:
    """(rid, n, log) of rows sorted by chunk, each chunk's own row first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for _, a, b, c, own in zip(*columns, strict=True):
                if own:
                    if held:
                        yield out(*held)
                    held = np.frombuffer(a, np.int64), np.frombuffer(c, np.int64), np.frombuffer(b, np.float64).copy()
                else:
                    held[2][np.frombuffer(a, np.uint16)] += np.frombuffer(b, np.float64)
        if held:
            yield out(*held)

    def out(rid: np.ndarray, n: np.ndarray, log: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(n), pa.array(log)], names=["rid", "n", "log"])

    return added.mapInArrow(add, "rid long, n long, log double")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, parts: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` (all of ``docs`` by default) with ``n_tokens``, ``log_prob`` (the sum over all tokens of the whole text of the log
    chance of the token between its neighbours) and ``mean_log_prob``; and the names of these columns.

    The contexts of rarer words are those of ``docs`` itself, every token but the one that is predicted. Without tokens (null,
    empty, no word): 0, 0.0 and null. Rows with equal key and text count as often as they occur and score alike; a null key is a
    key. A text of any length counts whole; names that are taken get underscores; an empty table stays empty.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    names = dict(zip(("n_tokens", "log_prob", "mean_log_prob"), fresh({*docs.columns, *keep}, "n_tokens", "log_prob", "mean_log_prob"), strict=True))
    rid, other = fresh({*docs.columns, *names.values()}, "row_id", "row_of")
    id_ = F.xxhash64(f"`{key}`", f"`{text}`")
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(PARTS_A_TASK * shuffled, model.tokens // PART_TOKENS + 1)
    rows = docs.select(id_.alias("rid"), F.col(f"`{text}`").cast("binary").alias("raw"))
    deal = dealt(rows, model, parts).repartition(max(shuffled, parts // PARTS_A_TASK), "part").sortWithinPartitions("part")
    added = contexts_added(deal).repartition(shuffled, "chunk").sortWithinPartitions("chunk", F.desc("own"))
    scores = row_scores(added).groupBy("rid").agg(F.max("n").alias("n"), F.avg("log").alias("log"))
    scores = scores.select(F.col("rid").alias(other), F.col("n").alias(names["n_tokens"]), F.col("log").alias(names["log_prob"]))
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], id_.alias(rid)).join(scores, F.col(rid) == F.col(other))
    mean = F.when(F.col(names["n_tokens"]) > 0, F.col(names["log_prob"]) / F.col(names["n_tokens"])).alias(names["mean_log_prob"])
    return kept.select(*[F.col(f"`{c}`") for c in keep], names["n_tokens"], names["log_prob"], mean), names
