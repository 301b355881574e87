"""Snapshots after a dead writer, changes that name a key twice, pages that leave elements open, lists with a page missing."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import matching, rows
from tidemark.sources import html, sinks, tables


def test_a_writer_that_dies_stops_no_other(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "snap")
    assert sinks.publish(spark, root, {"t": spark.range(2)}, 0) == 1
    spark.range(9).write.parquet(f"{root}/v=2-dead/t")  # files of a version that was never marked
    assert sinks.current_version(spark, root) == 1
    assert sinks.publish(spark, root, {"t": spark.range(3)}, 1) == 2
    assert sinks.load(spark, root, ["t"])[1]["t"].count() == 3
    monkeypatch.setattr(sinks, "current_version", lambda *_: 1)  # a writer that looked before the other's marker was there
    with pytest.raises(sinks.Stale):
        sinks.publish(spark, root, {"t": spark.range(4)}, 1)
    monkeypatch.undo()
    assert sinks.load(spark, root, ["t"])[1]["t"].count() == 3
    assert tables.previous(spark, root, 1, "t").count() == 2 and tables.previous(spark, root, 3, "t") is None


def test_a_key_changed_twice_stays_one_row(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, day int")
    changes = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (3, "z", 7), (3, "w", 8)], "k int, v string, day int")
    got = {r.k: (r.v, r.day) for r in rows.upsert(base, changes, "k", ["day"], ["day"]).collect()}
    assert got == {1: ("y", 1), 2: ("b", 2), 3: ("w", 8)}
    laid = rows.overlay(base, changes, "k", ["v"], order=["day"])
    assert sorted(tuple(r) for r in laid.collect()) == [(1, "y", 1, True), (2, "b", 2, False)]
    twice = spark.createDataFrame([("u", "one"), ("u", "two")], "key string, f string")
    asked = spark.createDataFrame([("u", "v")], "p string, q string")
    assert rows.two_probes(asked, twice, "key", "p", "q", ["f"]).count() == 1


def test_open_elements_hide_no_text(spark):
    pages = spark.createDataFrame([(1, "<noscript>a <p>text of the page</p>"), (2, "<noscript>hidden</noscript><p>shown</p>"), (3, "<ul><li>outer<ul><li>inner</li></ul><a href='x'>y</a></li></ul>")], "page_id int, html string")
    n = html.nodes(pages).cache()
    texts = {r.page_id: r.text for r in html.text_of(n).collect()}
    assert "text of the page" in texts[1] and texts[2] == "shown"
    assert [r.row for r in n.where("tag = 'a'").collect()] == [1]


def test_a_missing_page_is_an_error(spark, tmp_path):
    (tmp_path / "p1.json").write_text('[{"id": 1}]')
    spark.dataSource.register(tables.PagedJson)
    reader = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", "2").option("tries", "1")
    with pytest.raises(Exception, match="no answer"):
        reader.load().collect()


def test_kinds_meet_in_parts(spark):
    notes = spark.range(500).select(F.col("id").alias("notice_key"), F.array().cast("array<string>").alias("branch_tags"), F.array().cast("array<string>").alias("topic_tags"), (F.col("id") % 3 == 0).alias("is_tools"))
    subs = spark.createDataFrame([(1, [], ["all:new"]), (2, [], ["all:tools"]), (3, [], ["all:notices", "all:tools"])], "sub_id int, branch_ids array<string>, topic_ids array<string>")
    catalog = spark.createDataFrame([], "id string, match_topic string, branches array<string>")
    n = {r.sub_id: r["count"] for r in matching.match_pairs(subs, notes, catalog).groupBy("sub_id").count().collect()}
    assert n == {1: 500, 2: 167, 3: 500}


def test_only_closed_references_are_decoded(spark):
    pages = spark.createDataFrame([(1, "<p>a&amp;&amp b &copy 1 &lt;c&gt; &#233; &#233x</p><a href='/x?a=1&amp;copy=2&b=3'>t &amp u</a>")], "page_id int, html string")
    n = html.nodes(pages)
    assert html.text_of(n).first().text == "a&&amp b &copy 1 <c> é &#233x t &amp u"
    assert [r.href for r in n.where("tag = 'a'").collect()] == ["/x?a=1&copy=2&b=3"]
