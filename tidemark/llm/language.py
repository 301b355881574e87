"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices

#: The sample that the network learns from: about this many documents of each language, and this many of their words.
DOCS_PER_LANGUAGE = 400
WORDS_PER_LANGUAGE = 20_000
#: Longest run of bytes that the network sees at once; a longer word is cut into such runs.
SEGMENT = 32
MOST_LANGUAGES = 200
HIDDEN = 12
STEPS = 700
BATCH = 256
#: Distinct words whose labels a worker keeps; it starts anew beyond that.
CACHE = 400_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent layers, one from each end of the segment, and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, c = hidden, max(1, len(languages))
        self.languages = languages
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * d)).astype(np.float32)
            self.p[f"u{side}"] = rng.normal(0, d**-0.5, (d, 3 * d)).astype(np.float32)
            self.p[f"o{side}"] = rng.normal(0, d**-0.5, (d, c)).astype(np.float32)
        self.p["bias"] = np.zeros(c, np.float32)
        self.d = d

    def run(self, side: str, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each byte of equally long segments, ``x``: (lanes, bytes) in the order of this side."""
        d, u = self.d, self.p[f"u{side}"]
        h = np.zeros((len(x), d), np.float32)
        states, tape = np.empty((x.shape[1], len(x), d), np.float32), []
        for t in range(x.shape[1]):
            i = self.p[f"x{side}"][x[:, t]]
            g = h @ u
            zr = sigmoid(i[:, : 2 * d] + g[:, : 2 * d])
            z, r = zr[:, :d], zr[:, d:]
            n = np.tanh(i[:, 2 * d :] + r * g[:, 2 * d :])
            new = n + z * (h - n)
            if keep:
                tape.append((h, z, r, n, g[:, 2 * d :]))
            h = states[t] = new
        return states, tape

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages at each byte: (bytes, lanes, languages)."""
        f, _ = self.run("f", x)
        b, _ = self.run("b", x[:, ::-1])
        return self.softmax(f @ self.p["of"] + b[::-1] @ self.p["ob"] + self.p["bias"])

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all bytes, by backpropagation through time; ``y``: the segments' languages."""
        f, ftape = self.run("f", x, True)
        b, btape = self.run("b", x[:, ::-1], True)
        delta = self.softmax(f @ self.p["of"] + b[::-1] @ self.p["ob"] + self.p["bias"])
        delta[:, np.arange(len(y)), y] -= 1
        delta /= delta.shape[0] * delta.shape[1]
        out = {"bias": delta.sum((0, 1))}
        for side, states, tape, dy, bytes_ in (("f", f, ftape, delta, x), ("b", b, btape, delta[::-1], x[:, ::-1])):
            d, u = self.d, self.p[f"u{side}"]
            out[f"o{side}"] = np.einsum("tld,tlc->dc", states, dy)
            gx, gu = np.zeros_like(self.p[f"x{side}"]), np.zeros_like(u)
            dh = np.zeros((len(x), d), np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                h, z, r, n, g = tape[t]
                dh = dh + dy[t] @ self.p[f"o{side}"].T
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * g * r * (1 - r)
                di = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(gx, bytes_[:, t], di)
                gu += h.T @ dg
                dh = dh * z + dg @ u.T
            out[f"x{side}"], out[f"u{side}"] = gx, gu
        return out

    def train(self, words: list[bytes], langs: np.ndarray, counts: np.ndarray, steps: int = STEPS, seed: int = 2) -> None:
        """Adam over batches of equally long segments; languages weigh the same, words by the root of their counts."""
        rng = np.random.default_rng(seed)
        size = np.fromiter(map(len, words), np.int64, len(words))
        weight = np.sqrt(counts.astype(np.float64))
        weight /= np.bincount(langs, weight, len(self.languages))[langs]
        by_size = {int(s): np.flatnonzero(size == s) for s in np.unique(size)}
        arrays = {s: np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(-1, s) for s, at in by_size.items()}
        share = np.array([weight[at].sum() * s for s, at in by_size.items()])
        sizes = list(by_size)
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            s = sizes[rng.choice(len(sizes), p=share / share.sum())]
            at, w = by_size[s], weight[by_size[s]]
            pick = rng.choice(len(at), BATCH, p=w / w.sum())
            rate = 0.02 * (1 - step / (steps + 1)) + 0.001
            for k, g in self.gradients(arrays[s][pick], langs[at[pick]]).items():
                one[k] += 0.1 * (g - one[k])
                two[k] += 0.01 * (g * g - two[k])
                self.p[k] -= (rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def segments(text: bytes) -> list[bytes]:
    """All bytes of the text but white space, in words of at most SEGMENT bytes."""
    words = text.lower().split()
    if words and max(map(len, words)) > SEGMENT:
        words = [w[i : i + SEGMENT] for w in words for i in range(0, len(w), SEGMENT)]
    return words


class Labeller:
    """Sums of the byte labels of segments, each distinct segment run once."""

    def __init__(self, net: Network):
        self.net, self.at, self.sums = net, {}, np.zeros((0, len(net.languages)))

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self.at) > CACHE:
            self.at, self.sums = {}, self.sums[:0]
        new = sorted({w for words in texts for w in words if w not in self.at}, key=len)
        rows, start = [], 0
        while start < len(new):
            end, n = start, len(new[start])
            while end < len(new) and len(new[end]) == n and end - start < 1 << 13:
                end += 1
            x = np.frombuffer(b"".join(new[start:end]), np.uint8).reshape(-1, n)
            rows.append(self.net.labels(x).sum(axis=0, dtype=np.float64))
            start = end
        for i, w in enumerate(new, len(self.at)):
            self.at[w] = i
        self.sums = np.concatenate([self.sums, *rows])

    def pooled(self, words: list[bytes]) -> np.ndarray:
        """Mean label over all bytes."""
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return self.sums[at].sum(axis=0) / sum(map(len, words))


def fit(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE, words: int = WORDS_PER_LANGUAGE, steps: int = STEPS) -> Network:
    """A network trained on rows (key, text, lang): about ``per_language`` of each language's rows, taken by a hash of the key,
    and of these the ``words`` most frequent segments. Rows with a null key, text or language are not learned from. Of more than
    MOST_LANGUAGES languages the most frequent are learned."""
    labelled = labelled.where("key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    seen = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(seen)
    if not languages:
        return Network([])
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(per_language / seen[lang]))])
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / (1 << 20)
    sample = labelled.where(draw < share[F.col("lang")]).select("lang", F.explode(F.split(F.col("text"), r"[ \t-\r]+")).alias("w")).where("w != ''")
    ranked = sample.groupBy("lang", "w").count().withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "w")))
    rows = ranked.where(F.col("at") <= words).orderBy("lang", "at").collect()
    known = {lang: i for i, lang in enumerate(languages)}
    flat = [(s, known[r["lang"]], r["count"]) for r in rows for s in segments(r["w"].encode())]
    net = Network(languages)
    if flat:
        net.train([x[0] for x in flat], np.array([x[1] for x in flat]), np.array([x[2] for x in flat]), steps)
    return net


def predict(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``keep`` (all of ``docs`` by default) with the language of each whole text and its mean probability over the bytes.

    The two columns come last; underscores go before a name that is taken.
    A null text, a text without a letter, and any text if nothing was learned: ``und`` with score 0. Ties go to the first
    language in alphabetical order. Repeated rows are labelled alike; a text of any length is labelled whole; an empty table stays empty.
    """
    keep = docs.columns if keep is None else keep
    lang, score = fresh(keep, lang, score)
    raw, = fresh({*docs.columns, lang, score}, "raw")
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net)
        for part, texts in slices(batches, raw):
            words = [segments(t) if t and net.languages and LETTER.search(t.decode("utf-8", "replace")) else [] for t in texts]
            labeller.learn(words)
            langs, scores = [], []
            for w in words:
                p = labeller.pooled(w) if w else None
                best = None if p is None else int(p.argmax())
                langs.append(UNKNOWN if best is None else net.languages[best])
                scores.append(0.0 if best is None else float(min(1.0, p[best])))
            kept = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, lang, score])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias(raw)).mapInArrow(label, schema)
