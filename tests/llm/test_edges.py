"""Nulls, empty and very long texts, repeated rows, empty tables and clashing extra columns; other operators against plain versions."""

import math
import re
import zlib
from collections import Counter

import brute
from test_near import plain as near_survivors
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, language, lines, mixing, quality, scoring, sharding, suffixes, tokens
from tidemark.llm.queries import QUERIES

PASSAGE = " ".join(f"passage{i} of the many words that return" for i in range(12))
LONG = "Sentence number one is here, and the next one follows. " * 4000
TEXTS = [
    (1, f"Start of one.\n{PASSAGE}\nEnd of one.", "en"),
    (2, f"Other start\n{PASSAGE}\nother end", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \t\n ", "en"),
    (6, "123 456 !!!", "de"),
    (7, LONG, "en"),
    (8, "x" * 5000, "en"),
    (None, f"No key here {PASSAGE}", "en"),
    (9, "same row\nsame row\nline three\nline four", "fr"),
    (9, "same row\nsame row\nline three\nline four", "fr"),
    (10, "before\nsame row\nsame row\nline three\nline four\nafter", None),
    (11, "ÀÉÎ öüß ΑΒΓ 漢字 word word", "fr"),
]
CLASH = ["n_words", "shard", "slot", "spans", "items", "raw", "rid", "votes", "words", "t", "kept_text", "lines", "copy", "rate", "order", "quality", "kept", "score", "lang_pred", "gone", "marks"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    return df.withColumns({c: F.lit(c) for c in CLASH}).repartition(3).cache()


def key(x):
    return str(x)


def test_decontam(spark, docs):
    items = [(1, PASSAGE), (2, "word word"), (2, "LINE three"), (3, None), (4, ""), (5, "not there at all"), (None, "same row")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    want = brute.contamination([(i, t) for i, (_, t, _) in enumerate(TEXTS)], items)
    for most in (1 << 20, 10):
        found, n = decontam.search(docs, bench, most=most)
        assert found.columns == [*docs.columns, *n.values()]
        got = sorted((key(r.doc_id), r[n["n_words"]], sum(s.end - s.start for s in r[n["spans"]]), tuple(r[n["items"]])) for r in found.collect())
        assert got == sorted((key(d), want[i][0], len(want[i][1]), tuple(sorted(x for x in want[i][2] if x is not None))) for i, (d, _, _) in enumerate(TEXTS))
    assert decontam.clean(docs, bench).columns == docs.columns
    assert decontam.clean(docs, bench.limit(0)).count() == len(TEXTS)
    assert decontam.search(docs.limit(0), bench)[0].count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_matcher_finds_what_a_plain_search_finds(seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}".encode() for i in range(4)]
    pats = {tuple(vocab[i] for i in rng.integers(0, 4, rng.integers(1, 6))) for _ in range(6)}
    words = [vocab[i] for i in rng.integers(0, 4, 300)]
    found = list(decontam.Matcher(pats).find(words))
    assert sorted(found) == sorted((i, p) for p in pats for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)


def test_shards(spark, docs):
    placed = sharding.number(sharding.assign(docs, 5, "doc_id", "own_shard", "own_grown"), "own_shard", "doc_id", ("text",), "own_slot")
    rows = placed.collect()
    assert Counter(key(r.doc_id) for r in rows) == Counter(key(d) for d, _, _ in TEXTS)
    for s in range(5):
        own = sorted(r.own_slot for r in rows if r.own_shard == s)
        assert own == list(range(len(own)))
    assert all(r.own_shard == brute.jump(r.doc_id or 0, 5) and r.own_grown == brute.jump(r.doc_id or 0, 6) for r in rows)
    assert sharding.number(sharding.assign(docs.limit(0).drop("shard", "slot"))).count() == 0
    clash = sharding.number(sharding.assign(docs.limit(3)), "_shard")
    assert clash.columns == [*docs.columns, "_shard", "_slot"] and {r.shard for r in clash.collect()} == {"shard"}


def test_shards_of_string_keys(spark):
    df = spark.createDataFrame([(f"key {i % 50}",) for i in range(300)] + [(None,)] * 2, "doc_id string")
    rows = sharding.assign(df, 8, grown_col="grown").collect()
    assert len({(r.doc_id, r.shard) for r in rows}) == 51 and len({r.shard for r in rows}) == 8
    assert all(r.grown in (r.shard, 8) for r in rows)
    assert {r.shard for r in rows if r.doc_id is None} == {brute.jump(0, 8)}


def test_decontam_with_string_ids(spark):
    df = spark.createDataFrame([(1, "it has a few words"), (2, "others")], "doc_id long, text string")
    bench = spark.createDataFrame([("b", "few words"), ("a", "a few"), ("c", "none")], "item_id string, text string")
    found, n = decontam.search(df, bench)
    assert {r.doc_id: r[n["items"]] for r in found.collect()} == {1: ["a", "b"], 2: []}


STRANGE = [*TEXTS, (12, " ".join(f"word{i}" for i in range(60)) + ".", "en"), (13, "".join(f"w{i}x{i * i} " for i in range(30000)), "en"), (13, "".join(f"w{i}x{i * i} " for i in range(30000)), "en")]


def test_stages_on_strange_tables(spark, tmp_path):
    """Every stage of the pipeline on nulls in every column, repeated rows, very long texts, clashing names, a map column, and an empty table."""
    import corpus_pipeline

    spark.createDataFrame([(1, "word3 word4 word5 word6"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = spark.createDataFrame(STRANGE, "doc_id long, text string, lang string").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s"))
    rows = rows.withColumns({c: F.lit(c) for c in (*CLASH, "row_tag", "node", "a b")}).withColumn("notes", F.create_map(F.lit("k"), F.col("doc_id")))
    total = rows.count()
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        got = out.collect()
        left[name] = Counter(r.doc_id for r in got)
        extra = ["_shard", "_slot"] if name == "shards" else []
        assert out.columns == [*rows.columns, *extra]
        assert all(r.shard == "shard" and r.n_words == "n_words" and r.notes == {"k": r.doc_id} for r in got)
        assert stage(spark, rows.limit(0), str(tmp_path)).count() == 0
    assert left["quality_rules"] == {12: 1}
    ordered = sorted(STRANGE, key=lambda x: (x[0] is None, x[0] or 0))
    stay = near_survivors({i: t for i, (_, t, _) in enumerate(ordered)})
    assert left["near_duplicates"] == Counter(ordered[i][0] for i in stay)
    assert left["decontamination"][12] == 0 and sum(left["decontamination"].values()) == total - 1
    assert sum(left["shards"].values()) == total


def test_jump_moves_only_to_the_new_shard():
    keys = np.arange(-5000, 5000)
    for n in (1, 2, 7, 31):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all()
        assert abs((b == n).mean() - 1 / (n + 1)) < 0.02


def test_slots_do_not_depend_on_buckets(spark, monkeypatch):
    df = sharding.assign(spark.range(500).withColumnRenamed("id", "doc_id"))
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.number(df).collect()}
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 3)
    assert a == {r.doc_id: (r.shard, r.slot) for r in sharding.number(df).collect()}


def test_suffix_dedup(spark, docs):
    want = Counter()
    for (d, t, _), (stay, gone, runs) in zip(TEXTS, brute.repeats([t for _, t, _ in TEXTS]), strict=True):
        want[key(d), len((t or "").encode()), gone, runs, stay] += 1
    found, n = suffixes.dedup(docs)
    assert found.columns == [*docs.columns, *n.values()]
    got = Counter((key(r.doc_id), r[n["n_bytes"]], r[n["n_removed"]], r[n["n_spans"]], bytes(r[n["kept_raw"]])) for r in found.collect())
    assert got == want
    assert suffixes.dedup(docs.limit(0))[0].count() == 0


@pytest.mark.parametrize("seed,size,gram,crowded", [(0, 40, 12, 1000), (1, 30, 20, 1000), (2, 24, 8, 1), (3, 40, 33, 1), (0, 40, 12, 3), (4, 40, 12, 0.001)])
def test_suffix_dedup_of_random_pieces(spark, seed, size, gram, crowded):
    rng = np.random.default_rng(seed)
    pieces = ["".join(rng.choice(list("abcé"), rng.integers(3, 50))) for _ in range(12)]
    texts = ["".join(pieces[i] for i in rng.integers(0, 12, rng.integers(0, 12))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute.repeats(texts, size)
    found, n = suffixes.dedup(df, size=size, gram=gram, crowded=crowded)
    assert {r.doc_id: (bytes(r[n["kept_raw"]]), r[n["n_removed"]], r[n["n_spans"]]) for r in found.collect()} == dict(enumerate(want))


def test_suffix_sort_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(8)
    at = rng.integers(0, 5, 80)
    raw = [bytes(rng.choice(list(b"ab"), a).tolist()) + b"GGGG" + bytes(rng.choice(list(b"ab"), rng.integers(0, 5)).tolist()) for a in at.tolist()]
    group = np.sort(rng.integers(0, 6, 80))
    want = suffixes.Contexts(group, raw, at, 8, 4).repeated()
    monkeypatch.setattr(suffixes, "SYMBOL", np.full(256, 3, np.uint64))
    got = suffixes.Contexts(group, raw, at, 8, 4).repeated()
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and (want[0] >= 0).any()


def test_line_dedup(spark, docs):
    found, n = lines.dedup(docs, window=3)
    assert found.columns == [*docs.columns, *n.values()]
    got = {key(r.doc_id): (r[n["kept_text"]], r[n["n_lines"]], r[n["n_removed"]], r[n["n_runs"]]) for r in found.collect()}
    assert got["10"] == ("before\nafter", 6, 4, 1)
    assert got["9"][2] == 0 and got["3"] == (None, 0, 0, 0) and got["4"] == ("", 1, 0, 0)
    assert lines.dedup(docs.limit(0))[0].count() == 0


@pytest.mark.parametrize("seed,window", [(0, 1), (1, 2), (2, 3), (3, 4)])
def test_line_dedup_of_random_lines(spark, seed, window):
    rng = np.random.default_rng(seed)
    texts = ["\n".join(rng.choice(["a", "b", "", "c d"], rng.integers(1, 12))) for _ in range(50)]
    seen, want = set(), {}
    for d, t in enumerate(texts):
        ls, gone = t.split("\n"), set()
        for i in range(len(ls) - window + 1):
            w = tuple(ls[i : i + window])
            if w in seen:
                gone.update(range(i, i + window))
            seen.add(w)
        want[d] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone), sum(i - 1 not in gone for i in gone))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found, n = lines.dedup(df, window=window)
    assert {r.doc_id: (r[n["kept_text"]], r[n["n_removed"]], r[n["n_runs"]]) for r in found.collect()} == want


def test_quality(spark, docs):
    rows, n = quality.judge(docs)
    assert rows.columns == [*docs.columns, *n.values()]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((key(r.doc_id), *[r[n[c]] for c in names]) for r in rows.collect()) == Counter((key(d), *brute.quality(t)) for d, t, _ in TEXTS)
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(docs.limit(0))[0].count() == 0


def test_em_finds_a_rule_that_is_often_wrong():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.5
    right = [0.95, 0.9, 0.6, 0.9, 0.9, 0.9, 0.9, 0.9]
    votes = np.array([np.where(rng.random(20000) < a, truth, ~truth) for a in right]).T * 2 - 1
    votes[rng.random(votes.shape) < 0.3] = 0
    got = quality.estimate(Counter(map(tuple, votes.tolist())))
    assert np.abs(np.array(got) - right).max() < 0.02


def test_em_overturns_the_verdict_of_equal_weights():
    """Two rules that are hardly better than chance say bad, one that is nearly always right says good."""
    rng = np.random.default_rng(1)
    truth = rng.random(100000) < 0.5
    right = [0.6, 0.58, 0.97, 0.9, 0.9, 0.9, 0.9, 0.9]
    votes = np.array([np.where(rng.random(100000) < a, truth, ~truth) for a in right]).T * 2 - 1
    votes[rng.random(votes.shape) < 0.5] = 0
    pattern = (-1, -1, 1, 0, 0, 0, 0, 0)
    start = [quality.TRUSTED] * len(quality.RULES)
    assert quality.posterior(start, pattern) < 0.5 < quality.posterior(quality.estimate(Counter(map(tuple, votes.tolist()))), pattern)
    same = (votes == pattern).all(axis=1)
    assert same.sum() > 20 and truth[same].mean() > 0.8


def test_language(spark, docs):
    train = docs.select(F.col("doc_id").alias("key"), "text", "lang")
    net = language.fit(train, steps=5)
    assert net.languages == ["de", "en", "fr"]
    rows = language.predict(docs, net).withColumnsRenamed({"_lang_pred": "own_lang", "_score": "own_score"}).collect()
    for r in rows:
        none = r.text is None or not any(c.isalpha() for c in r.text)
        assert (r.own_lang == "und") == none and 0 <= r.own_score <= 1
    assert {r.own_lang for r in language.predict(docs, language.fit(train.limit(0)), lang="own_lang", score="own_score").collect()} == {"und"}


def test_gradients_of_the_recurrent_network():
    net = language.Network(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.random.default_rng(1).integers(97, 100, (4, 5)), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(net.labels(x)[:, np.arange(4), y]).mean()
    grads = net.gradients(x, y)
    for k, at in (("xf", (98, 2)), ("xb", (97, 7)), ("uf", (1, 4)), ("ub", (2, 8)), ("of", (0, 1)), ("ob", (2, 2)), ("bias", (1,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-3
        up = loss()
        net.p[k][at] = old - 1e-3
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-4, k


def test_mixing(spark):
    df = spark.createDataFrame([(i, "big" if i < 3000 else "small" if i < 3300 else None, i) for i in range(3400)], "doc_id long, source string, copy long").repartition(5)
    out = mixing.mix(df, {"big": 1.0, "small": 2.0}, total=1800, copy="nth", order="place").collect()
    n = Counter(r.source for r in out)
    assert set(n) == {"big", "small"} and abs(n["big"] - 600) < 100 and abs(n["small"] - 1200) < 140
    times = Counter(r.doc_id for r in out)
    for d in range(3400):
        rate = 0.2 if d < 3000 else 4.0 if d < 3300 else 0.0
        u, k, total = mixing.uniform(str(d)), 0, math.exp(-rate)
        while total < u:
            k += 1
            total += math.exp(-rate) * rate**k / math.factorial(k)
        assert times[d] == k
    assert Counter(r.source for r in mixing.mix(df).collect()).keys() == {"big", "small", None}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix(df, {"none": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"small": 1.0}, total=10**8)


def test_inverse_poisson_has_the_right_mean():
    rng = np.random.default_rng(1)
    for mean in (0.01, 1.0, 30.0, 499.0):
        got = mixing.inverse_poisson(rng.random(20000), np.full(20000, mean))
        assert abs(got.mean() - mean) < 5 * math.sqrt(mean / 20000) and abs(got.var() / mean - 1) < 0.1


@pytest.fixture(scope="module")
def pieces():
    return tokens.pieces_of(tokens.VOCABULARY)


def greedy(word, pieces, longest):
    n = i = 0
    while i < len(word):
        for end in range(min(len(word), i + longest), i, -1):
            if word[i:end] in pieces:
                n, i = n + 1, end
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_automaton(pieces):
    held, longest = set(pieces), max(map(len, pieces))
    auto = tokens.Automaton(pieces)
    rng = np.random.default_rng(2)
    words = ["", "a", "internationalisation", "漢字", "naïve", "xXxX", "☃snow", "aaaaaaaaab", *["".join(rng.choice(list("abcdefghiestnré漢☃"), rng.integers(1, 30))) for _ in range(2000)]]
    for w in words:
        assert auto.count("▁" + w) == greedy("▁" + w, held, longest), w
    odd = ["ab", "abcd", "bc", "b", "cde", "▁", "dé"]
    auto = tokens.Automaton(odd)
    for _ in range(3000):
        w = "".join(rng.choice(list("abcdeé▁"), rng.integers(0, 12)))
        assert auto.count(w) == greedy(w, set(odd), 4), w


def test_automaton_agrees_with_a_word_piece_tokenizer(pieces):
    from tokenizers import Tokenizer, models

    vocab = {p: i for i, p in enumerate(dict.fromkeys([*pieces, "[UNK]"]))}
    other = Tokenizer(models.WordPiece(vocab=vocab, unk_token="[UNK]", continuing_subword_prefix="", max_input_chars_per_word=1000))
    auto = tokens.Automaton(pieces)
    for w in ("▁the", "▁unbelievably", "▁thstinnt", "▁éèaiai", "▁dividedly", "▁xqzv"):
        ids = other.encode(w, add_special_tokens=False).tokens
        if "[UNK]" not in ids:
            assert auto.count(w) == len(ids)


def test_token_counts(spark, docs, pieces):
    held, longest = set(pieces), max(map(len, pieces))
    rows = tokens.count(docs, pieces, words="own_words", tokens="own_tokens").collect()
    for r in rows:
        words = brute.WORD5.findall(r.text or "")
        assert (r.own_words, r.own_tokens) == (len(words), sum(greedy("▁" + w, held, longest) for w in words))


def plain_scores(texts, model, endings):
    """Scores by the definition: class between the neighbours' classes, word in its class, and what else stands between the same two rarer words."""
    words = [re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    seen = Counter(w for ws in words for w in ws)
    size = len(model.frequent) + endings
    kind = {w: model.frequent.index(w) if w in model.frequent else len(model.frequent) + zlib.crc32(w[-2:]) % endings for w in seen}
    of_class, rare = Counter(), Counter()
    for w, n in seen.items():
        of_class[kind[w]] += n
        rare[kind[w]] += 0 if w in model.counts or w in model.frequent else n
    tri, two, one = Counter(), Counter(), Counter()
    for w, n in seen.items():
        if w not in model.counts and w not in model.frequent:
            x = b"  " + w + b" "
            for i in range(2, len(x)):
                tri[x[i - 2 : i + 1]] += n
                two[x[i - 1 : i + 1]] += n
                one[x[i - 1 : i]] += n
    history = Counter()
    for x, n in tri.items():
        history[x[:2]] += n

    def spelled(w):
        x, out = b"  " + w + b" ", 0.0
        for i in range(2, len(x)):
            short = (two[x[i - 1 : i + 1]] + 4 / 256) / (one[x[i - 1 : i]] + 4)
            out += math.log((tri[x[i - 2 : i + 1]] + 4 * short) / (history[x[i - 2 : i]] + 4))
        return out

    def within(w):
        k = kind[w]
        if w in model.frequent:
            return 0.0
        if w in model.counts:
            return math.log(seen[w] / (of_class[k] + 0.5))
        part = (rare[k] + 0.5) / (sum(rare.values()) + 0.5 * endings)
        return min(0.0, spelled(w) - math.log(part)) + math.log((rare[k] + 0.5) / (of_class[k] + 0.5))

    between, out = Counter(), []
    around = [list(zip([None, *ws[:-1]], ws, [*ws[1:], None])) for ws in words]
    held = lambda a, b: a is not None and b is not None and a not in model.common and b not in model.common
    for ws in around:
        between.update((a, b, w) for a, w, b in ws if held(a, b))
    all_ = Counter()
    for (a, b, _), n in between.items():
        all_[a, b] += n
    for ws in around:
        total = 0.0
        for a, w, b in ws:
            left, right = (size if x is None else kind[x] for x in (a, b))
            log = float(model.net.log_chances(np.array([left]), np.array([right]))[0, kind[w]]) + within(w)
            if held(a, b) and all_[a, b] > 1:
                others = all_[a, b] - 1
                weight = others / (others + 1)
                log = math.log(weight * (between[a, b, w] - 1) / others + (1 - weight) * math.exp(log))
            total += log
        out.append((len(ws), total))
    return out


def test_lm_scores(spark, docs):
    """Against an independent plain version, with rows that repeat, nulls, clashing names, many chunks and parts."""
    extra = [(900 + i, f"the red {w} jumps over a {w} fence while zebras sing {w} tunes", None) for i, w in enumerate(("fox", "fox", "cat", "qzx"))]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(a, b) for a, b, _ in extra], "doc_id long, text string"))
    rows = rows.withColumn("text", F.when(F.length("text") < 3000, F.col("text"))).withColumn("log_prob", F.lit("own")).repartition(3)
    model = scoring.fit(rows, frequent=8, endings=4, epochs=40, vocabulary=20, common=3)
    seen = Counter(w for r in rows.collect() for w in decontam.words_of((r.text or "").encode()))
    level = Counter({w: math.floor(math.log2(n) * 64) for w, n in seen.items() if n > 1})
    bound = min(x for x in level.values() if sum(y >= x for y in level.values()) <= 20)
    assert [*model.frequent, *model.counts] == sorted((w for w, x in level.items() if x >= bound), key=lambda w: (-seen[w], w))
    found, n = scoring.score(rows, model, parts=7)
    assert n["log_prob"] == "_log_prob"
    got = found.collect()
    assert len(got) == rows.count()
    for r, (k, total) in zip(got, plain_scores([r.text for r in got], model, 4), strict=True):
        assert r[n["n_tokens"]] == k and r.log_prob == "own"
        assert abs(r[n["log_prob"]] - total) < 4e-3 * max(1, k)
        assert (r[n["mean_log_prob"]] is None) == (not k)
    none = rows.limit(0)
    assert scoring.score(none, scoring.fit(none, epochs=2))[0].count() == 0


def test_lm_query_tells_words_and_repeats_apart(spark, sf):
    """Every word counts: gibberish with the right endings scores far below the text, and a document that the corpus has twice above one that it has once."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = scoring.fit(docs, epochs=40)
    rng = np.random.default_rng(1)
    letters = list("bcdfghjklmnpqrstvwxz")
    clean = [(r.doc_id, r.text) for r in docs.where("text is not null and length(text) > 800").orderBy("doc_id").limit(12).collect()]
    scramble = lambda m: "".join(rng.choice(letters, len(m[0]) - 2)) + m[0][-2:]
    made = [(10_000 + d, re.sub(r"[a-z]{5,}", scramble, t)) for d, t in clean] + [(20_000 + d, f"{t.split()[0]} {w}") for d, t in clean[:1] for w in ("thing", "fixing")]
    rows = docs.unionByName(spark.createDataFrame([*made, *[(30_000 + d, t) for d, t in clean]], docs.schema))
    found, n = scoring.score(rows, model)
    got = {r.doc_id: r[n["mean_log_prob"]] for r in found.collect()}
    assert all(got[10_000 + d] < got[d] - 1 for d, _ in clean)
    once = {r.doc_id: r[n["mean_log_prob"]] for r in scoring.score(rows.where("doc_id < 30000"), model)[0].collect()}
    gain = [got[d] - once[d] for d, _ in clean]
    assert min(gain) > 0 and np.mean(gain) > 0.3
    assert all(abs(got[30_000 + d] - got[d]) < 1e-9 for d, _ in clean)
    pair = [r[n["mean_log_prob"]] for r in found.where("doc_id between 20000 and 29999").collect()]
    assert len(set(pair)) == 2


def test_lm_learns_and_prefers_what_it_has_seen():
    rng = np.random.default_rng(4)
    words = [b"a", b"b", b"c", b"d"]
    lexicon = scoring.Lexicon(None, words, 1)
    of = lambda text: lexicon.cells(lexicon.ids(text), np.array([len(text)]))
    text = [words[i % 4] for i in range(4000)]
    cells, n = np.unique(of(text), return_counts=True)
    net = scoring.Network(lexicon.size, 8)
    losses = net.train(cells, n.astype(float), 150)
    assert losses[-1] < 0.1 < losses[0]
    logs = net.table().ravel()
    assert logs[of(text[:40])].sum() > logs[of([words[i] for i in rng.integers(0, 4, 40)])].sum() + 20


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, stage(spark, frame, sf).cache()
        left[name] = frame.collect()
        if name != "shards":
            assert frame.columns == before.columns
    kept = {r.doc_id for r in QUERIES["op10_quality"](spark, sf).collect() if r.kept}
    assert {r.doc_id for r in left["quality_rules"]} == kept
    single = near_survivors({d: docs[d] for d in kept})
    assert sorted(r.doc_id for r in left["near_duplicates"]) == sorted(single)
    clean = {d for d, (_, hit, _) in brute.contamination([(d, docs[d]) for d in single], items).items() if not hit}
    assert sorted(r.doc_id for r in left["decontamination"]) == sorted(clean)
    source = Counter(r.source for r in left["decontamination"])
    rate = {s: len(clean) / len(source) / n for s, n in source.items()}
    want = Counter()
    for r in left["decontamination"]:
        want[r.doc_id] += int(mixing.inverse_poisson(np.array([mixing.uniform(str(r.doc_id))]), np.array([rate[r.source]]))[0])
    assert Counter(r.doc_id for r in left["source_mixing"]) == +want
    assert all(r.shard == brute.jump(r.doc_id, 8) and r.text == docs[r.doc_id] for r in left["shards"])
    assert Counter(r.doc_id for r in left["shards"]) == +want
