"""Token counts by a linear longest-match automaton (after Song et al., 2021), without building the pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, slices

#: The mark that a word starts with, as in the vocabulary's pieces.
START = "▁"
#: A vocabulary larger than this is refused: it is sent to every worker.
MOST_BYTES = 64 << 20
#: Distinct words whose counts a worker keeps; it starts anew beyond that.
CACHE = 500_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def pieces_of(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model, in order of id: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """A trie of the pieces; for each node, where matching goes on if the next character has no branch, and how many tokens that pops.

    A character that no piece can start with, or that starts only longer pieces that don't follow, counts as one token for
    each of its UTF-8 bytes (byte pieces). Each character moves down one branch and each failure link moves up, so a word
    takes time in proportion to its length.
    """

    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][c]
            whole[node] = whole[node] or node > 0
        self.fail, self.pops = [0] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for c, node in self.next[up].items():
                queue.append(node)
                if whole[node]:
                    self.pops[node] = 1
                elif not up:
                    self.pops[node] = len(c.encode())
                else:
                    self.fail[node], popped = self.step(self.fail[up], c)
                    self.pops[node] = self.pops[up] + popped

    def step(self, node: int, c: str) -> tuple[int, int]:
        """The node after one more character, and the tokens popped on the way."""
        popped = 0
        while True:
            if (to := self.next[node].get(c)) is not None:
                return to, popped
            if not node:
                return 0, popped + len(c.encode())
            popped += self.pops[node]
            node = self.fail[node]

    def count(self, word: str) -> int:
        node = n = 0
        for c in word:
            node, popped = self.step(node, c)
            n += popped
        while node:
            n += self.pops[node]
            node = self.fail[node]
        return n


def count(docs: DataFrame, pieces: list[str], text: str = "text", keep: list[str] | None = None, words: str = "n_words", tokens: str = "n_tokens") -> DataFrame:
    """``keep`` (all of ``docs`` by default) with the words and tokens of each whole text.

    Words are parted by ASCII white space, case and all other characters count as they are. Null, empty and blank texts have
    no words and no tokens; repeated rows count alike; a text of any length counts whole; an empty table stays empty. The two
    columns come last; underscores go before a name that is taken.
    """
    if sum(len(p.encode()) for p in pieces) > MOST_BYTES:
        raise ValueError("the vocabulary is too large to send to every worker")
    keep = docs.columns if keep is None else keep
    words, tokens = fresh(keep, words, tokens)
    raw, = fresh({*docs.columns, words, tokens}, "raw")
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], T.StructField(words, T.LongType()), T.StructField(tokens, T.LongType())])
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton(held.value), {}
        for part, texts in slices(batches, raw):
            if len(known) > CACHE:
                known = {}
            n_words, n_tokens = [], []
            for t in texts:
                split = t.split() if t else []
                for w in {w for w in split if w not in known}:
                    known[w] = automaton.count(START + w.decode("utf-8", "replace"))
                n_words.append(len(split))
                n_tokens.append(sum(map(known.__getitem__, split)))
            kept = [part.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*keep, words, tokens])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias(raw)).mapInArrow(add, schema)
