"""Classifier, matching, state, sources, sinks and streams on examples."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify, matching, reports, rows, selection, state
from tidemark.sources import html, sinks, tables
from tidemark.streaming import jobs

D = datetime.date


@pytest.mark.parametrize("title,body,want", [
    ("露營訓練班", "", "training"), ("社區服務日", "", "service"), ("追蹤挑戰賽(服務邀請)", "", "service"), ("全港錦標賽", "", "competition"), ("大會操失物認領安排", "", "announcement"),
    ("2026年香港童軍大會操", "", "activity"), ("香港童軍大會操步操比賽成績公布", "", "competition"), ("總部公告", "社會服務", "announcement"), ("比賽成績公布", "", "competition"),
    ("青年獎勵計劃簡介會", "", "training"), ("優異旅團獎勵計劃", "訓練班", "announcement"), ("同樂日", "挑戰賽", "activity"), ("童軍消防(服務組)專章訓練班", "", "training"),
    ("羽毛球會-入會表格", "訓練班", "announcement"), ("通告一覽", "訓練班", "announcement"), ("九龍通告【2026年10月】", "訓練班", "announcement"), ("皮革藝術", "成績公佈", "announcement"),
    ("皮革藝術", "參加訓練班", "training"), ("", "開放日", "activity"), ("皮革藝術", "開放日", "announcement"), ("科技之行", "探訪", "activity"),
])
def test_classifier(spark, title, body, want):
    df = spark.createDataFrame([(title, body)], "title string, body string")
    assert classify.classify(df, "title", "body").first().category.id == want


def test_classifier_sources_and_topics(spark):
    df = spark.createDataFrame([("x", "Tool Box"), ("大露營同樂日", "a")], "title string, source string")
    got = classify.classify(df, "title", None, "source", tools_sources=["Tool Box"]).select("category", classify.category_topic(F.col("category")).alias("t")).collect()
    assert [r.t for r in got] == ["category:tools", "activity:big-camp"] and got[1].category.evidence == ["同樂日", "大露營"]


NAMES = {"小童軍": "小童軍", "幼童軍": "幼童軍", "童軍": "童軍", "深資童軍": "深資童軍", "樂行童軍": "樂行童軍", "領袖": "領袖"}


@pytest.mark.parametrize("audience,want", [
    ("深資童軍", ["深資童軍"]), ("幼童軍及童軍", ["幼童軍", "童軍"]), ("15歲以上之童軍成員", ["童軍", "深資童軍", "樂行童軍"]), ("18歲或以上之童軍成員", ["深資童軍", "樂行童軍"]),
    ("童軍支部或以上成員", ["童軍", "深資童軍", "樂行童軍"]), ("所有成員", list(NAMES)), ("教練員", ["領袖"]), ("18歲以下", []), ("", []),
])
def test_sections(spark, audience, want):
    df = spark.createDataFrame([(audience,)], "a string")
    assert df.select(classify.sections(F.col("a"), NAMES)).first()[0] == sorted(want)


def test_course_topics(spark):
    catalog = spark.createDataFrame([("c1", "露營章", "course", ["野營技巧"], []), ("c2", "風帆章", "course", [], ["滑浪風帆章"]), ("c3", "", "course", ["獨木舟教練"], [])], "id string, label string, kind string, aliases array<string>, exclude array<string>")
    n = spark.createDataFrame([("a", "童軍露營訓練班", ""), ("b", "滑浪風帆章考驗", ""), ("c", "地質班", "持有獨木舟教練資歷優先"), ("d", "獨木舟教練班", "")], "notice_key string, title_form string, text_form string")
    got = {(r.notice_key, r.topic_id) for r in classify.course_topics(n, catalog).collect()}
    assert got == {("a", "c1"), ("d", "c3")}


def test_matching_never_crosses_pairs(spark):
    catalog = spark.createDataFrame([("t1", None, ["A"]), ("t2", None, ["B"]), ("t3", "t1", ["*"])], "id string, match_topic string, branches array<string>")
    subs = spark.createDataFrame([("s1", ["A", "B"], ["t1", "t2"]), ("s2", ["B"], ["t3"]), ("s3", [], ["all:new"]), ("s4", ["A"], ["gone"]), ("s5", ["B"], ["all:notices"])], "sub_id string, branch_ids array<string>, topic_ids array<string>")
    notes = spark.createDataFrame([("n1", ["A"], ["t2"], False), ("n2", ["A"], ["t1"], False), ("n3", ["B"], ["t1"], False), ("n4", [], [], True)], "notice_key string, branch_tags array<string>, topic_tags array<string>, is_tools boolean")
    got = {tuple(r) for r in matching.match_pairs(subs, notes, catalog).collect()}
    assert got == {("s1", "n2"), ("s2", "n3"), *[("s3", f"n{i}") for i in range(1, 5)], *[("s5", f"n{i}") for i in range(1, 4)]}
    bad = {r.sub_id: r.error for r in matching.valid_preferences(subs, ["t1", "t2", "t3"], ["A", "B"]).collect()}
    assert bad == {"s1": None, "s2": None, "s3": None, "s4": "topics", "s5": None}
    faults = matching.catalog_faults(spark.createDataFrame([("A", "a"), ("A", "b")], "id string, label string"), catalog.withColumn("label", F.lit("")))
    assert {r.fault for r in faults.collect()} == {"duplicate id", "missing label", "unknown branch"}
    silent = matching.already_notified(subs, spark.createDataFrame([("s1", D(2026, 1, 1))], "sub_id string, batch_date date"), F.lit("2026-01-01").cast("date"))
    assert {r.sub_id for r in silent.collect() if r.silent} == {"s1"}
    assert {r.id for r in matching.visible_topics(catalog.withColumn("legacy", F.col("id") == "t2"), F.array(F.lit("A"))).collect()} == {"t1", "t3"}
    assert spark.range(1).select(matching.failures_are_systemic(F.lit(2), F.lit(4)), matching.failures_are_systemic(F.lit(3), F.lit(4))).first()[:] == (False, True)


def test_state_guards(spark):
    one = lambda n, day: spark.createDataFrame([(f"u{i}", day) for i in range(n)], "url string, public_on date")
    today = F.lit("2026-01-01").cast("date")
    old = F.lit("2025-01-01").cast("date")
    assert state.blast_guarded(one(3, D(2026, 1, 1)), today, F.lit(False), old).where(F.col("public_on") == today).count() == 3
    assert state.blast_guarded(one(10, D(2026, 1, 1)), today, F.col("url") == "u1", old).where(F.col("public_on") == today).count() == 1
    kept, shrunk = state.shrink_guarded(one(2, D(2026, 1, 1)), one(9, D(2026, 1, 1)))
    assert shrunk and kept.count() == 9
    kept, shrunk = state.shrink_guarded(one(8, D(2026, 1, 1)), one(9, D(2026, 1, 1)))
    assert not shrunk and kept.count() == 8
    with pytest.raises(ValueError):
        state.shrink_guarded(one(0, None), one(3, D(2026, 1, 1)))
    fp = spark.createDataFrame([("a", "1"), ("b", "2")], "source string, fingerprint string")
    done = spark.createDataFrame([("a", "9", 0, False), ("b", "8", 3, False), ("c", "7", 2, True)], "source string, fingerprint string, assets int, failed boolean")
    assert {tuple(r) for r in state.stored_fingerprints(fp, done).collect()} == {("a", "1"), ("b", "8")}
    s = spark.createDataFrame([("u1", D(2025, 1, 1), None, None), ("u2", D(2025, 1, 1), None, None)], "url string, first_public date, known_day date, delisted_on date")
    seen = spark.createDataFrame([("u1", True), ("u3", False)], "url string, visible boolean")
    pub = spark.createDataFrame([("u1", D(2025, 1, 1))], "url string, public_on date")
    got = {r.url: (r.delisted_on, r.pending) for r in state.next_state(s, pub, seen, today).collect()}
    assert got == {"u1": (None, False), "u2": (D(2026, 1, 1), False), "u3": (None, True)}
    fixes = spark.createDataFrame([("u1", "舊名", "夏令營訓練班"), ("u2", "別名", "（一）日期：")], "url string, listing_title string, title string")
    rows_ = spark.createDataFrame([("u1", "舊名"), ("u2", "別名"), ("u3", "x")], "url string, title string")
    assert {tuple(r) for r in state.title_fixes(rows_, fixes).collect()} == {("u1", "夏令營訓練班", "corrected"), ("u2", "別名", "reverted"), ("u3", "x", None)}


PAGE = """<html><body><script>var a = "</p>";</script><h2>Activity notices</h2><table><tr><td>Row title of one</td><td><a href="/a.pdf">here</a></td></tr></table>
<ul><li>Second row <a href="b.pdf" title="T"></a></li></ul><a data-id="7" href="">Card seven</a><a data-id="7" href="">again</a><p>Title of frame</p><iframe src="https://drive.google.com/file/d/XyZ/preview"></iframe>
<meta http-equiv="refresh" content="0; URL='https://x.org/c.pdf?a=1;b=2'"></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<p>only text</p>")], "page_id int, html string")
    n = html.nodes(pages).cache()
    assert {(r.href, r.text) for r in html.anchors(n).collect()} == {("/a.pdf", "here"), ("b.pdf", "T")}
    assert {(r.href, r.title) for r in html.row_titles(n).collect()} == {("/a.pdf", "Row title of one"), ("b.pdf", "Second row")}
    assert {(r.href, r.how) for r in html.detail_assets(n).collect()} == {("/a.pdf", "a"), ("b.pdf", "a"), ("https://drive.google.com/file/d/XyZ/preview", "iframe"), ("https://x.org/c.pdf?a=1;b=2", "refresh")}
    assert [r.title for r in html.nearest_text(n).collect()] == ["Title of frame"]
    assert [(r.card_id, r.title, r.href) for r in html.cards(n).collect()] == [("7", "Card seven", "/notice/?nid=7")]
    assert {r.page_id for r in html.fingerprints(n).collect()} == {1, 4}
    assert {r.page_id: r.text for r in html.text_of(n).collect()}[4] == "only text"
    assert html.listing_pages(n, r"\.pdf$", 1).count() == 1
    p = spark.createDataFrame([('x {"title":"A {b}","pdf":"","link":"l"} y {bad} {"title":"C","pdf":"p"}',)], "payload string")
    assert [(r.title, r.href) for r in html.payload_rows(p, "payload", "title string, pdf string, link string").collect()] == [("A {b}", "l"), ("C", "p")]
    t = spark.createDataFrame([("No. 1: Camp; No. 2: Hike;",)], "t string").select(html.text_notices(F.col("t"), r"No\. (\d+): (\w+);", ("no", "name"))).first()[0]
    assert [(x.no, x.name) for x in t] == [("1", "Camp"), ("2", "Hike")]
    items = spark.createDataFrame([(1, 10), (2, 99)], "id int, asset_id int")
    assert html.joined_assets(items, spark.createDataFrame([(10, "u")], "id int, url string")).count() == 1


def test_snapshots_swap_or_fail(spark, tmp_path):
    root = str(tmp_path / "snap")
    a, b = spark.range(3), spark.range(5)
    assert sinks.current_version(spark, root) == 0
    assert sinks.publish(spark, root, {"t": a, "u": b}, 0) == 1
    with pytest.raises(sinks.Stale):
        sinks.publish(spark, root, {"t": b}, 0)
    with pytest.raises(sinks.Invalid):
        sinks.publish(spark, root, {"t": b}, 1, {"t": {"small": F.col("id") < 2}})
    assert sinks.publish(spark, root, {"t": b}, 1, {"t": {"small": F.col("id") < 9}}) == 2
    version, held = sinks.load(spark, root, ["t"])
    assert (version, held["t"].count()) == (2, 5)
    assert tables.previous(spark, root + "/none", 1) is None
    assert sinks.drop_old(spark, root, 1) == [1]


def test_cache_documents(spark, tmp_path):
    path = str(tmp_path / "cache.json")
    row = {"title": "t", "pdf_url": "p", "date": "2026-01-01"}
    (tmp_path / "cache.json").write_text(json.dumps({"data": {"S": [row, {"title": "no address"}]}, "notices": [row, row]}, indent=1))
    assert [(r.source_site, r.pdf_url) for r in tables.notices(spark, path).collect()] == [("S", "p")]
    (tmp_path / "cache.json").write_text(json.dumps({"notices": [dict(row, source_site="F")]}))
    assert [r.source_site for r in tables.notices(spark, path).collect()] == ["F"]
    assert tables.json_or_empty(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "fp.json").write_text(json.dumps({"S": "1", "T": "2"}))
    assert tables.fingerprints(spark, str(tmp_path / "fp.json")).count() == 2


def test_paged_json(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"p{i}.json").write_text(json.dumps([{"id": i, "title": f"t{i}", "link": "l", "date": "d"}]))
    (tmp_path / "p3.json").write_text("[]")
    spark.dataSource.register(tables.PagedJson)
    df = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", "3").load()
    assert sorted(r.id for r in df.collect()) == [1, 2]


def test_greedy_distinct(spark):
    df = spark.createDataFrame([("d", 1, "u", "t"), ("d", 2, "u", "x"), ("d", 3, "v", "t"), ("d", 4, "w", "x"), ("e", 1, "u", "t"), ("d", 5, "", ""), ("d", 6, "", "")], "day string, ord int, url string, title string")
    assert sorted((r.day, r.ord) for r in rows.greedy_distinct(df, "day", "ord", "url", "title").collect()) == [("d", 1), ("d", 4), ("d", 5), ("d", 6), ("e", 1)]


def test_junk_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "12"), ("a", "Real title"), ("a", ""), ("b", "Real")], "s string, title string")
    got = reports.junk_report(df, "s", reports.is_junk(F.col("title")), "title").collect()
    assert [(r.s, r.n, r.junk, r.samples) for r in got] == [("a", 3, 2, ["", "12"])]
    assert reports.freshness(df.limit(0).withColumn("d", F.current_date()), "s", F.col("d"), F.current_date()).count() == 6
    assert reports.funnel(spark.createDataFrame([], "event string, count long")).first().rate == 0
    assert reports.coverage(df.limit(0), ["title"]).first().any_pct == 0
    assert selection.diversified(df.limit(0).withColumn("c", F.lit("training")), ["s"], "c", ["title"]).count() == 0


def stream_of(spark, tmp_path, batches, schema):
    src = tmp_path / "src"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(src))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def test_streams_agree_with_batches(spark, tmp_path):
    schema = "url string, observed_on date, visible boolean"
    batches = [[("a", D(2026, 1, 1), False), ("b", D(2026, 1, 1), True)], [("a", D(2026, 1, 2), True), ("b", D(2026, 1, 2), False)], [("b", D(2026, 1, 3), True), ("a", D(2026, 1, 3), True)]]
    stream = stream_of(spark, tmp_path, batches, schema)
    q = jobs.publication_stream(stream).writeStream.format("memory").queryName("published").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {tuple(r) for r in jobs.publication_batch(spark.createDataFrame([r for b in batches for r in b], schema)).collect()}
    assert {tuple(r) for r in spark.table("published").collect()} == want == {("a", D(2026, 1, 2)), ("b", D(2026, 1, 1)), ("b", D(2026, 1, 3))}


def test_deliveries_are_recorded_once(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[("s", "n"), ("s", "n")], [("s", "n"), ("s", "m")]], "sub_id string, notice_key string")
    table = str(tmp_path / "deliveries")
    for _ in range(2):
        jobs.deliver_once(stream, table, ["sub_id", "notice_key"], str(tmp_path / "ck")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [("s", "m"), ("s", "n")]


def test_late_duplicates(spark, tmp_path):
    t = datetime.datetime
    stream = stream_of(spark, tmp_path, [[("k", t(2026, 1, 1)), ("k", t(2026, 1, 2))], [("k", t(2026, 1, 3)), ("j", t(2026, 1, 3))]], "k string, ts timestamp")
    q = jobs.first_in_window(stream, ["k"], "ts").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["j", "k"]
