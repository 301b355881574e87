"""Near-duplicates by five-word shingles against a plain comparison of all pairs."""

from itertools import combinations

import numpy as np

import corpus_pipeline
from tidemark.llm import near


def plain(texts: dict) -> set:
    """The smallest key of each component of the pairs with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in texts.items():
        words = (t or "").encode().lower().split()
        n = min(5, len(words))
        sets[d] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    root = {d: d for d in texts}
    for a, b in combinations(sorted(texts), 2):
        both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * all_ and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def test_stage_finds_edited_copies(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == sorted(plain(texts))


def test_families_at_the_edge_of_similarity(spark):
    rng = np.random.default_rng(5)
    texts, d = {}, 0
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(8):
            words = list(base)
            for i in rng.integers(0, 120, rng.integers(0, 5)):
                words[i] = f"e{rng.integers(0, 10**6)}"
            texts[d] = " ".join(words)
            d += 1
    texts |= {d: None, d + 1: " ", d + 2: "one two", d + 3: "ONE  two", d + 4: "two one"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in near.keep_one(df).collect()} == plain(texts)
    assert near.keep_one(df.limit(0)).count() == 0
