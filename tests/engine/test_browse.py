import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.audience import audience
from tidemark.functions.text import nfkc
from tidemark.operators import browse

NAMES = {"小童軍": "小童軍", "幼童軍": "幼童軍", "童軍": "童軍", "深資童軍": "深資童軍", "樂行童軍": "樂行童軍", "領袖": "領袖"}


@pytest.mark.parametrize("title,audience_,section,want", [
    ("幼童軍日營", "", "幼童軍", True), ("幼童軍日營", "", "童軍", False), ("幼童軍日營", "深資童軍", "幼童軍", False), ("日營", "所有成員", "領袖", True), ("香港童軍總會公告", "", "童軍", False),
])
def test_section_filter(spark, title, audience_, section, want):
    df = spark.createDataFrame([(title, audience_)], "t string, a string")
    assert df.select(browse.for_section(F.col("t"), F.col("a"), section, NAMES)).first()[0] is want


def test_categories_and_windows(spark):
    df = spark.createDataFrame([([("activity", "competition")],), ([("training", None)],), ([],), (None,)], "c array<struct<id:string,subtype:string>>")
    assert [r[0] for r in df.select(browse.categories(F.col("c"))).collect()] == [["competition"], ["training"], ["announcement"], ["announcement"]]
    d = datetime.date
    df = spark.createDataFrame([(d(2026, 1, 1), False), (d(2026, 1, 8), False), (d(2026, 1, 8), True), (d(2026, 1, 7), True), (None, False), (d(2025, 12, 31), False)], "d date, tool boolean")
    show = lambda w: [bool(r[0]) for r in df.select(browse.in_window(F.col("d"), F.lit("2026-01-08").cast("date"), w, F.col("tool"))).collect()]
    assert show("week") == [True, True, False, False, False, False]
    assert show("today") == [False, True, True, False, False, False]
    assert all(show("all"))


def test_lists(spark):
    urls = spark.createDataFrame([("https://x.org/é a.pdf",), ("https://x.org/b",)], "url string")
    asked = spark.createDataFrame([("https://x.org/b",), ("https://x.org/c",), ("https://x.org/é a.pdf",)], "url string")
    assert browse.allowed(asked, urls).count() == 2
    assert browse.listed(asked, urls.limit(0)).count() == 3
    df = spark.createDataFrame([("https://push.example.com/x", "A" * 87, "B" * 22), ("http://push.example.com/x", "", ""), ("https://evil.com/x", "A" * 87, "B" * 22), ("https://example.com/x", "!", "B" * 22), (None, None, None)], "e string, p string, a string")
    assert [r[0] for r in df.select(browse.valid_subscription(F.col("e"), F.col("p"), F.col("a"), ["example.com"])).collect()] == [None, "endpoint", "host", "p256dh", "endpoint"]


@pytest.mark.parametrize("text,want", [
    ("歡迎各合資格的人士\n參加資格：深資童軍及樂行童軍\n報名：領袖", "深資童軍、樂行童軍"), ("致：各旅領袖", "領袖"), ("沒有說明", None), ("對象：所有成員", None), ("", None),
    ("對象:\n(1)幼童軍\n(2)領袖\n費用:家長", "幼童軍、領袖"), ("參加資格：15歲以上之童軍成員", "童軍、深資童軍、樂行童軍"), ("參加資格：18歲或以上之童軍成員", "深資童軍、樂行童軍"),
    ("參加資格：12歲或以上各支部成員", "各支部成員（12歲或以上）、童軍、深資童軍、樂行童軍"), ("參加資格：年滿12歲的各支部成員", "各支部成員（年滿12歲）"), ("對象：幼童軍領袖，須獲家長同意", "領袖"), ("2.1 11至26歲的童軍、深資童軍或樂行童軍支部成員;\n2.2 持有證書\n截止日期：", "深資童軍、樂行童軍、童軍"),
    ("致：香港童軍中心十樓", None), ("致：各旅長\n知會：領袖", None), ("參加對象：童軍支部或以上成員", "童軍、深資童軍、樂行童軍"), ("參加資格：已完成領袖基本訓練班之會務委員", "會務委員"),
])
def test_audience(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").withColumn("form", nfkc(F.col("t")))
    assert df.select(audience(F.col("form"))).first()[0] == want
