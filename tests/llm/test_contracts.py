"""The queries with a fixed contract, over the whole small tables, against plain versions."""

import hashlib
import zlib

import brute
import pytest

from tidemark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    return docs, items


def test_op2(spark, sf, tables):
    docs, _ = tables
    rows = QUERIES["op2_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (brute.jump(r.doc_id, 8), brute.jump(r.doc_id, 9))
        assert r.grown_shard in (r.shard, 8)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op3(spark, sf, tables):
    docs, items = tables
    want = brute.contamination(docs.items(), items)
    rows = QUERIES["op3_decontamination"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, ids = want[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(ids), digest, bool(hit))
    assert any(r.contaminated for r in rows)


def test_op5(spark, sf, tables):
    docs, _ = tables
    prints = {d: brute.simhash(t) for d, t in docs.items()}
    want = brute.linked(prints)
    rows = QUERIES["op5_simhash"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", want[d]) for d in docs}


def test_op10(spark, sf, tables):
    docs, _ = tables
    rows = QUERIES["op10_quality"](spark, sf).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {d: brute.quality(t) for d, t in docs.items()}
    assert not any(r.kept for r in rows if r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if labels.get(r.doc_id) == 0 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert not junk or sum(r.kept for r in junk) <= 0.5 * len(junk)


def test_op4(spark, sf, tables):
    docs, _ = tables
    ids = list(docs)
    want = dict(zip(ids, brute.repeats([docs[i] for i in ids]), strict=True))
    rows = QUERIES["op4_suffix_dedup"](spark, sf).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert got == {i: (len((docs[i] or "").encode()), want[i][1], want[i][2], hashlib.sha256(want[i][0]).hexdigest()) for i in ids}


def test_op8(spark, sf, tables):
    docs, _ = tables
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_language"](spark, sf).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)
