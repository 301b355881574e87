"""Text, address, date, fee and key rules on examples."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, keys, money, text, urls


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def table(spark, fn, cases, kind="string"):
    got = apply(spark, fn, [a for a, _ in cases], kind)
    assert list(zip([a for a, _ in cases], got, strict=True)) == cases


def test_keys(spark):
    df = spark.createDataFrame([("源", "https://x/é.pdf"), ("", ""), (None, None), ("a", "b")], "s string, u string")
    for r in df.select("s", "u", keys.notice_key("s", "u").alias("k"), keys.notice_id("s", "u").alias("i")).collect():
        raw = f"{r.s or ''}\x1f{r.u or ''}".encode()
        h = 0xCBF29CE484222325
        for b in raw:
            h = ((h ^ b) * 0x100000001B3) & ((1 << 64) - 1)
        assert (r.k, r.i) == (hashlib.sha256(raw).hexdigest(), f"{h:016x}")
    df = spark.createDataFrame([("a.pdf", "p"), ("", "p"), (None, " q "), (" ", None)], "pdf_url string, url string")
    assert [r[0] for r in df.select(keys.effective_url()).collect()] == ["a.pdf", "p", "q", ""]


def test_normal_forms(spark):
    table(spark, text.normalize_text, [("  ＡＢ&amp;Ｃ  d​ ", "AB&C d"), (None, ""), ("一　二", "一 二")])
    table(spark, text.match_text, [("傑出 服務奬", "傑出服務獎"), ("Camp Fire", "campfire")])
    table(spark, text.compact_title, [("「渡假 營」通告", "度假營"), ("A-b C!", "abc")])


def test_titles(spark):
    table(spark, lambda c: text.clean_title(c), [
        ("[夏令營通告.pdf]", "夏令營通告"), ("TPN/CIR/VS/2627/003 露營訓練班", "露營訓練班"), ("Drive, 領袖訓練班 - 通告07.10", "領袖訓練班"),
        ("遠足活動 - >>連結<<", "遠足活動"), ("下載", None), (">>連結<<", None), ("12/06/2026", None), ("5 June 2026", None), ("截止日期：", None), ("abc", None),
        ("https://example.org/a.pdf", None), ("深資 活動名稱: 靜觀工作坊 活動日期: 2026年", "靜觀工作坊"), ("%E9%9C%B2%E7%87%9F%E6%B4%BB%E5%8B%95", "露營活動"), (None, None),
    ])
    table(spark, text.looks_opaque, [("1Um6PXr5OXZa5bg4zJIPQIrVJDs-mTdh6", True), ("2026-07-18_annual-meeting.pdf", False), ("short", False), ("周年大會通告周年大會通告周年大會", False)])
    table(spark, lambda c: text.trimmed(c, 5), [("abcdefg", "abcd…"), (" a  b ", "a b")])
    table(spark, text.slug, [("Hello, World!", "hello-world"), ("!!!", "notice")])
    table(spark, text.unbalanced_brackets, [("(a)「b」", False), ("a)", True), ("（x", False), ("『x", True)])


def test_headings(spark):
    table(spark, text.looks_like_table_row, [("13, 17, 20 地質導賞", True), ("2026 Oct 10 班", True), ("50周年紀念活動", False), ("17 風帆研習班", True)])
    table(spark, text.looks_like_clause, [("2.1 11至26歲的成員;", True), ("成員活動", False)])
    table(spark, text.looks_like_address, [("長康邨康美樓C301室", True), ("Flat C301, Hong Mei House", True), ("露營訓練班通告", False)])
    table(spark, text.heading_of, [("香港區\n（一）日期：\n17 表格\n夏令營訓練班通告\n其他", "夏令營訓練班通告"), ("", None)])
    df = spark.createDataFrame([("夏令營訓練班", "夏令營訓練班通告\n日期"), ("完全不同的名稱", "夏令營訓練班通告\n日期"), ("某某名稱活動", "")], "l string, d string")
    assert [tuple(r.reconciled) for r in text.reconciled(df, "l", "d").collect()] == [("夏令營訓練班", "verified"), ("夏令營訓練班通告", "corrected"), ("某某名稱活動", "unverified")]
    sim = spark.createDataFrame([("abcdefgh", "abcdefgh"), ("abcdefgh", "abcdefghij"), ("abcd", "abxy"), ("", "a")], "a string, b string").select(text.title_similarity(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in sim] == [1.0, 1.0, 0.5, 0.0]
    table(spark, text.mojibake_repaired, [("é".encode().decode("latin-1"), "é"), ("plain", "plain"), (None, None)])


def test_urls(spark):
    u = "https://WWW.Example.org:8080/A/b.PDF?utm_source=x&id=3&v=2#frag"
    table(spark, urls.sanitize, [(u, "https://WWW.Example.org:8080/A/b.PDF?id=3"), ("https://drive.google.com/open?id=abc&usp=s", "https://drive.google.com/file/d/abc/view"), ("", ""), (None, "")])
    table(spark, urls.canonical, [(u, "example.org/A/b.PDF?utm_source=x&id=3&v=2"), ("https://x.org/路 徑", "x.org/路 徑")])
    table(spark, urls.extension, [(u, ".pdf"), ("https://x.org/a", ""), ("a.tar.gz", ".gz")])
    table(spark, urls.is_download, [(u, True), ("https://x.org/a.png?download=1", False), ("https://x.org/?attachment_id=4", True), ("https://drive.google.com/file/d/1/view", True), ("https://x.org/a", False), (None, False)])
    table(spark, urls.collapse_double_pdf, [("https://x.org/a.pdf.PDF?q=1", "https://x.org/a.pdf?q=1"), ("https://x.org/a.pdf", "https://x.org/a.pdf")])
    table(spark, lambda c: urls.known_double_pdf(c, ["x.org"]), [("https://x.org/circular/a.pdf.pdf", "https://x.org/circular/a.pdf"), ("https://y.org/circular/a.pdf.pdf", "https://y.org/circular/a.pdf.pdf")])
    table(spark, urls.drive_direct, [("https://drive.google.com/file/d/AbC-1/view?usp=x", "https://drive.google.com/uc?export=download&id=AbC-1"), ("https://x.org/a", "https://x.org/a")])
    table(spark, urls.tail_title, [("https://x.org/files/annual-meeting_notice.pdf", "annual meeting notice"), ("https://drive.google.com/file/d/1Um6PXr5OXZa5bg4zJIPQIrVJDs/view", None), ("https://x.org/", None)])
    table(spark, urls.skip_reason, [("https://x.org/a.docx", ".docx"), ("https://x.org/a.verylongext", "no file ending")])
    table(spark, urls.without_slash, [(" https://x.org/a// ", "https://x.org/a")])
    table(spark, urls.is_enrichable, [("https://x.org/a.pdf", True), ("https://x.org/?wpdmdl=12", True), ("https://x.org/a", False)])
    pairs = [("https://x.org/a/b", "c.pdf", "https://x.org/a/c.pdf"), ("https://x.org/", "//y.org/z", "https://y.org/z"), ("https://x.org/", "mailto:a", None), ("https://x.org/", "#top", None), ("https://x.org/", None, None)]
    df = spark.createDataFrame(pairs, "b string, h string, want string")
    assert all(r.o == r.want for r in df.withColumn("o", urls.resolve(F.col("b"), F.col("h"))).collect())
    places = [("https://x.org/notice/?nid=207", "/notice/?nid={id}", True), ("https://x.org/notice/?nid=a", "/notice/?nid={id}", False), ("https://x.org/a.pdf", "/notice/?nid={id}", False), ("https://x.org/n/5", "https://x.org/n/{id}", True), ("https://x.org/n", "", False)]
    df = spark.createDataFrame(places, "u string, t string, want boolean")
    assert all(r.o == r.want for r in df.withColumn("o", urls.is_placeholder(F.col("u"), F.col("t"))).collect())
    df = spark.createDataFrame([("https://x.org?a=1&n=old", ["i", "j"])], "s string, i array<string>")
    assert df.select(urls.results_url(F.col("s"), F.col("i"))).first()[0] == "https://x.org/?a=1&n=i,j"


def test_dates(spark):
    table(spark, dates.find_date, [
        ("2026 年 6 月 30 日", "2026-06-30"), ("由2026/6/3起", "2026-06-03"), ("30-06-2026", "2026-06-30"), ("2026年13月40日", None), ("2026-12-34 或 31/12/2026", "2026-12-31"), ("", None), (None, None),
    ])
    table(spark, lambda c: dates.deadline(c), [
        ("日期：2026年1月1日\n截止日期：\n2026年6月30日", "2026-06-30"), ("截止：2026-05-05\n截止報名日期：2026-06-06", "2026-06-06"), ("活動2026年1月1日", None),
        ("必須於2026年11月30日（星期一）或之前交回", "2026-11-30"), ("報名已截止", "已截止"), ("", None),
    ])
    rows = [([[["日期", "截止日期"], ["2026年1月1日", "2026年2月2日"]]], "2026-02-02"), (None, None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, t array<array<array<string>>>, want string")
    assert all(r.o == r.want for r in df.withColumn("o", dates.deadline(F.lit(""), F.col("t"))).collect())
    df = spark.sql("SELECT timestamp'2026-01-08 00:00:00' AS now, date'2026-01-01' AS d, timestamp'2025-12-31 17:00:00' AS utc")
    r = df.select(dates.still_shown(F.col("d"), F.col("now"), 7).alias("a"), dates.still_shown(F.col("d"), F.col("now") + F.expr("INTERVAL 1 SECOND"), 7).alias("b"), dates.civil_day(F.col("utc")).alias("c"), dates.iso_date(F.lit("2026-02-30x")).alias("e")).first()
    assert (r.a, r.b, str(r.c), r.e) == (True, False, "2026-01-01", None)


@pytest.mark.parametrize("line,want", [
    ("費用全免", "全免"), ("費用：港幣 120 元正", "HK$120"), ("費用：$100、$50 資助後", "HK$50"), ("費用：$100（非會員$150）", "HK$100 / HK$150"), ("費用：＄200.00", "HK$200.00"), ("名額：30", None), ("費用：$0", None),
])
def test_fee(spark, line, want):
    assert spark.createDataFrame([(line,)], "v string").select(money.fee(F.col("v"))).first()[0] == want


def test_fee_tables_and_labels(spark):
    df = spark.createDataFrame([("", [[["日期", "費用($)"], ["1", ""], ["2", "160"]]])], "v string, t array<array<array<string>>>")
    assert df.select(money.fee(F.col("v"), F.col("t"))).first()[0] == "HK$160"
    table(spark, money.has_fee_label, [("費用：", True), ("費用發放方式", False), ("", False)])
    table(spark, money.normal_fee, [("USD$10", "US$10"), ("10元", "HK$10"), ("面議", "面議"), ("", None)])
    table(spark, lambda c: money.label_scope(c, ("資格",), 2, ("報名",), ("合資格",)), [("歡迎合資格人士\n資格：成員\n另\n報名：x", "成員 另"), ("無", None)])
