"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Only DataFrame functions touch the rows. What reaches the driver is one count for each pattern of votes, at most
3 ** len(RULES) rows however large the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: White space that parts words, symbol characters, and the base thresholds.
SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Detectors vote bad or abstain, the last two vote good or abstain: no sign of one fault says nothing about another.
RULES = ("symbols", "capitals", "word_length", "repeats", "repeated_lines", "line_ends", "prose", "ordinary")
#: A rule is taken to be right so often before any text is seen; as if so many texts had shown it.
TRUSTED, TRUSTED_TEXTS = 0.85, 20.0
#: No rule counts as worse than this or as certain.
WORST, BEST = 0.55, 0.999
EM_ROUNDS = 100
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ended")


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` (all of ``docs`` by default) with the measures of each whole text, and the names of their columns.

    Repeated three-word windows are found within the row: the windows' hashes are compared as a set, and only a text with
    an equal pair has its windows sorted by hash, equal neighbours marked and the words they cover counted. Nothing is
    shuffled. A null text counts as empty: all measures 0.
    """
    keep = docs.columns if keep is None else keep
    taken = {*docs.columns, *keep}
    names = dict(zip(FEATURES, fresh(taken, *FEATURES), strict=True))
    t, words, lines, hashes, pairs, places = fresh({*taken, *names.values()}, "t", "words", "lines", "hashes", "pairs", "places")
    kept = [F.col(f"`{c}`") for c in keep]
    one = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(t))
    two = one.select(
        *kept, t,
        F.filter(F.split(t, SPACE), lambda w: w != "").alias(words),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias(lines),
    )
    w = F.col(words)
    last = F.size(w) - 3
    three = two.select(
        *kept,
        F.size(w).cast("long").alias(names["n_words"]),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias(names["word_chars"]),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias(names["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(names["n_dup_lines"]),
        F.size(lines).cast("long").alias(names["n_lines"]),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias(names["n_upper"]),
        F.size(F.filter(lines, lambda x: x.rlike(r"""[.!?:;"»”…]\s*$"""))).cast("long").alias(names["n_ended"]),
        F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).alias(hashes),
    )
    h = F.col(hashes)
    rest = [names[f] for f in FEATURES if f != "n_repeat_words"]
    four = three.select(*kept, *rest, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias(pairs))
    p = F.col(pairs)
    alike = F.filter(p, lambda x, i: (x["h"] == F.get(p, i - 1)["h"]) | (x["h"] == F.get(p, i + 1)["h"]))
    five = four.select(*kept, *rest, F.sort_array(F.transform(alike, lambda x: x["p"])).alias(places))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
    step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"), x.alias("at"))
    repeated = F.coalesce(F.aggregate(places, start, step)["n"], F.lit(0).cast("long"))
    six = five.select(*kept, *[repeated.alias(names[f]) if f == "n_repeat_words" else names[f] for f in FEATURES])
    return six, names


def votes(n: dict[str, str]) -> dict[str, Column]:
    """A rule's vote: 1 good, -1 bad, 0 abstains."""
    c = {k: F.col(v).cast("double") for k, v in n.items()}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))

    symbols, capitals, length = c["n_symbols"] / words, c["n_upper"] / F.greatest(c["word_chars"], F.lit(1.0)), c["word_chars"] / words
    repeats, repeated, ended = c["n_repeat_words"] / words, F.when(c["n_lines"] >= 3, c["n_dup_lines"] / lines).otherwise(0.0), c["n_ended"] / lines
    bad = lambda test: F.when(test, -1).otherwise(0)
    good = lambda test: F.when(test, 1).otherwise(0)
    tests = (
        bad(symbols > 0.1),
        bad(capitals > 0.3),
        bad((length < 2.5) | (length > 12)),
        bad(repeats > 0.3),
        bad(repeated > 0.3),
        bad(ended < 0.1),
        good((ended > 0.5) & (symbols < 0.05) & (capitals < 0.15)),
        good((length > 3.0) & (length < 9.0) & (symbols < 0.1) & (repeats < 0.2) & (capitals < 0.2)),
    )
    return dict(zip(RULES, tests, strict=True))


def estimate(counts: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS) -> list[float]:
    """EM of a model in which each text is good or bad (alike likely before the votes) and each rule's vote is right with a
    chance of its own: those chances. Whether a rule votes at all says nothing. The order of the patterns is fixed, so equal
    counts give equal estimates; no patterns give the chances that the rules start from."""
    patterns = sorted(counts)
    right = [TRUSTED] * len(RULES)
    for _ in range(rounds):
        good = {p: posterior(right, p) for p in patterns}
        new = []
        for j in range(len(RULES)):
            agreed, voted = TRUSTED * TRUSTED_TEXTS, TRUSTED_TEXTS
            for p in patterns:
                if p[j]:
                    agreed += counts[p] * (good[p] if p[j] > 0 else 1 - good[p])
                    voted += counts[p]
            new.append(min(BEST, max(WORST, agreed / voted)))
        moved = max(abs(a - b) for a, b in zip(new, right, strict=True))
        right = new
        if moved < 1e-12:
            break
    return right


def weights(right: list[float]) -> list[float]:
    """What a rule's vote adds to, or takes from, the log odds of good."""
    return [math.log(a / (1 - a)) for a in right]


def posterior(right: list[float], pattern: tuple[int, ...]) -> float:
    return 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights(right), pattern, strict=True))))


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> tuple[DataFrame, dict[str, str]]:
    """``keep`` of ``docs`` with the measures, ``base_failed``, ``quality`` (chance of good, 0 to 1) and ``kept``.

    A text under LEAST_WORDS words or with more than MOST_REPEATED per cent of its words in repeated windows fails the base
    and is not kept; of the others those with quality of at least ``threshold`` are. The rules' chances come from all rows
    that pass the base; a text on which no rule votes has quality 0.5 and is kept. Null and empty texts fail the base; an empty table stays empty.
    Repeated rows are judged alike and count each; a text of any length counts whole; names that are taken get underscores.
    """
    rows, names = measured(docs, text, keep)
    names |= dict(zip(("base_failed", "quality", "kept"), fresh(rows, "base_failed", "quality", "kept"), strict=True))
    rule, = fresh({*rows.columns, *names.values()}, "votes")
    n, r = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    failed = (n < LEAST_WORDS) | (100 * r > MOST_REPEATED * n)
    rows = written(rows.withColumns({names["base_failed"]: failed, rule: F.array(*votes(names).values())}), "measured")
    seen = rows.where(~F.col(names["base_failed"])).groupBy(rule).count().collect()
    right = estimate({tuple(x[0]): x[1] for x in seen})
    odds = F.lit(0.0)
    for j, w in enumerate(weights(right)):
        odds = odds + F.lit(w) * F.get(rule, F.lit(j))
    quality = 1 / (1 + F.exp(-odds))
    rows = rows.withColumn(names["quality"], quality)
    return rows.withColumn(names["kept"], ~F.col(names["base_failed"]) & (F.col(names["quality"]) >= threshold)).drop(rule), names


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject: null, empty and short texts fail the base and go, repeated rows fare alike,
    a text of any length counts whole, columns of any name are kept, an empty table stays empty."""
    rows, names = judge(docs, text)
    return rows.where(names["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
