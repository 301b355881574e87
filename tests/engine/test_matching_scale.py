"""Matches at scale: pairs come out of their join once each and meet no shuffle after it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching
from tidemark.plans import catalog as queries

SUBS, NOTES, TOPICS = "sub_id long, branch_ids array<string>, topic_ids array<string>", "notice_key long, branch_tags array<string>, topic_tags array<string>, is_tools boolean", "id string, match_topic string, branches array<string>"


def example():
    """Tables and the true pairs: notices with several rows, tags that are null or doubled, subscriptions to kinds beside topics."""
    r = random.Random(3)
    topics = [("t1", None, ["A"]), ("t2", None, ["*"]), ("t3", "t1", ["*"]), ("t4", None, ["B", "C"])]
    some = lambda xs, n: [r.choice(xs) for _ in range(r.randint(0, n))]
    subs = [(i, some("ABC", 3), some(["t1", "t2", "t3", "t4", "gone", "all:new", "all:tools", "all:notices"], 3)) for i in range(60)]
    notes = [(r.randint(0, 60), some("ABC", 2) if r.random() < 0.9 else None, some(["t1", "t2", "t4", "category:tools"], 2) if r.random() < 0.9 else None, r.choice([True, False, None])) for _ in range(90)]
    scope, pairs = {i: (m or i, b) for i, m, b in topics}, set()
    for s, branches, asked in subs:
        want = {(b, scope[t][0]) for t in asked if t in scope for b in branches if "*" in scope[t][1] or b in scope[t][1]}
        for k, b, t, tools in notes:
            kind = "all:tools" if tools or "category:tools" in (t or []) else "all:notices"
            if want & {(x, y) for x in b or [] for y in t or []} or kind in asked or "all:new" in asked:
                pairs.add((s, k))
    return subs, notes, topics, pairs


@pytest.mark.parametrize("size", [2, 4096])
def test_pairs_of_odd_tables(spark, monkeypatch, size):
    monkeypatch.setattr(matching, "PART_NOTICES", size)
    subs, notes, topics, pairs = example()
    subs, notes, topics = spark.createDataFrame(subs, SUBS), spark.createDataFrame(notes, NOTES), spark.createDataFrame(topics, TOPICS)
    got = [tuple(x) for x in matching.match_pairs(subs, notes, topics).collect()]
    assert len(got) == len(pairs) and set(got) == pairs
    batched = notes.withColumn("batch", F.col("notice_key") % 3)
    log = subs.select("sub_id", (F.col("sub_id") * 2 % 3).alias("batch"))
    left = [tuple(x) for x in matching.undelivered_matches(subs, batched, topics, log).collect()]
    assert sorted(left) == sorted((s, k) for s, k in pairs if (s * 7 + k) % 3)
    paid = {x.sub_id: (x.ids, x.n) for x in matching.payloads(subs, notes, topics, most=4).collect()}
    assert paid == {s: (sorted(k for q, k in pairs if q == s)[:4], sum(q == s for q, _ in pairs)) for s in {s for s, _ in pairs}}
    done = subs.where("sub_id % 3 = 0").crossJoin(spark.range(4).select(F.col("id").alias("batch"))).select("sub_id", "batch")
    new, pool = notes.withColumn("batch", F.col("notice_key") % 4).where("notice_key % 3 != 0"), notes.where("notice_key % 2 = 1")
    fresh = {(s, k) for s, k in pairs if k % 3 and s % 3}
    day = {(s, k) for s, k in pairs if k % 2 and s in {s for s, _ in fresh}}
    grouped = [tuple(x) for x in matching.delivery_groups(subs, new, pool, topics, done).collect()]
    assert sorted(grouped) == sorted((*p, p in fresh) for p in fresh | day)


@pytest.mark.parametrize("name", ["match_pairs", "undelivered_pairs", "delivery_groups"])
def test_pairs_meet_no_shuffle(spark, sf, name):
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    above = []
    for line in plan:  # from the top down to the join that makes the pairs
        above.append(line)
        if "Join" in line:
            break
    assert "part#" in above[-1] and not re.search("Exchange|Aggregate", "\n".join(above)), "\n".join(above)


@pytest.mark.parametrize("batches", [False, True])
def test_files_of_pairs_are_small(spark, tmp_path, batches):
    none = F.array().cast("array<string>")
    subs = spark.range(1011).select(F.col("id").alias("sub_id"), none.alias("branch_ids"), F.array(F.lit("all:notices")).alias("topic_ids"))
    notes = spark.range(6000).select(F.col("id").alias("notice_key"), none.alias("branch_tags"), none.alias("topic_tags"), F.lit(False).alias("is_tools"), (F.col("id") % 2).alias("batch"))
    topics = spark.createDataFrame([], TOPICS)
    log = spark.range(500).select(F.col("id").alias("sub_id"), F.lit(0).cast("long").alias("batch"))
    found = matching.undelivered_matches(subs, notes, topics, log) if batches else matching.match_pairs(subs, notes, topics)
    found.write.parquet(f"{tmp_path}/pairs")
    of = {r.sub_id: (r.n, r.most) for r in spark.read.parquet(f"{tmp_path}/pairs").groupBy("sub_id").agg(F.count("*").alias("n"), F.count_distinct("notice_key").alias("most")).collect()}
    assert of == {i: (3000, 3000) if batches and i < 500 else (6000, 6000) for i in range(1011)}
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert size < 0.3 * sum(n for n, _ in of.values())


def test_payloads_make_no_pairs(spark, sf):
    plan = queries.QUERIES["payload_ids"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "part#" not in plan and "WindowGroupLimit" in plan
