"""Rules over written examples: each row of ``part`` takes one example by its key, so that every rule runs over the whole table.

The SQL states what each example must give; the query runs the rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audience, dates, keys, money, text, urls
from ..operators import browse, classify, reports, selection, tagging
from ..sources import html
from .registry import ORACLE_SQL, QUERIES, Tables

KEY = "p_partkey"


def literal(x: str | bool | None) -> str:
    if x is None:
        return "NULL"
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else f"'{str(x).lower()}'"


def cases(name: str, rule: Callable[..., Column], examples: Sequence[tuple], kind: str = "string", first: Callable[[Column], Column] | None = None) -> None:
    """``examples``: (argument, ..., result). ``{n}`` in texts becomes the row's key. ``first``: what needs Python, done to the first argument before the rule."""
    width = len(examples[0]) - 1

    def run(spark, sf_dir: str) -> DataFrame:
        n = F.col(KEY)

        def argument(i: int) -> Column:
            out = None
            for at, example in enumerate(examples):
                value = example[i]
                c = F.lit(value) if not isinstance(value, str) else F.replace(F.lit(value), F.lit("{n}"), n.cast("string"))
                test = n % len(examples) == at
                out = F.when(test, c) if out is None else out.when(test, c)
            return out if i else out.cast(kind)

        rows = Tables(spark, sf_dir).part.select(KEY, *[argument(i).alias(f"a{i}") for i in range(width)])
        if first:
            rows = rows.withColumn("a0", first(F.col("a0")))
        return rows.select(KEY, rule(*[F.col(f"a{i}") for i in range(width)]).cast("string").alias("result"))

    QUERIES[name] = run
    whens = " ".join(f"WHEN {at} THEN replace({literal(e[-1])}, '{{n}}', {KEY}::VARCHAR)" for at, e in enumerate(examples))
    ORACLE_SQL[name] = f"SELECT {KEY}, CASE {KEY} % {len(examples)} {whens} END AS result FROM part"


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def listed(*rules: Callable[..., Column]) -> Callable[..., Column]:
    """Several rules of the same arguments, one after the other."""
    return lambda *a: F.concat_ws("|", *[F.coalesce(r(*a).cast("string"), F.lit("-")) for r in rules])


SECTIONS = {"小童軍": "小童軍", "幼童軍": "幼童軍", "童軍": "童軍", "深資童軍": "深資童軍", "樂行童軍": "樂行童軍", "領袖": "領袖"}

# Addresses.
cases("url_is_download", urls.is_download, [
    ("https://x.org/{n}.PDF?utm_source=x#f", True), ("https://x.org/{n}.docx", True), ("https://x.org/{n}.csv", True), ("https://x.org/{n}.png?download=1", False), ("https://x.org/{n}.webm?attachment_id=4", False),
    ("https://x.org/?attachment_id={n}", True), ("https://drive.google.com/file/d/{n}/view", True), ("https://www.dropbox.com/s/{n}?dl=1", True), ("https://x.org/download/{n}", True), ("https://x.org/a{n}", False), ("https://x.org/{n}.css?download=1", True), (None, False),
])
cases("url_is_article", lambda u, t: urls.is_article(u, F.lit("https://X.org/"), t), [
    ("https://x.org/news/{n}", "Camp {n}", True), ("https://y.org/news/{n}", "Camp", False), ("https://x.org/", "Camp", False), ("https://x.org/{n}.pdf", "Camp", False), ("https://x.org/{n}.jpg", "Camp", False), ("https://x.org/in/{n}", "Login", False), ("ftp://x.org/a/{n}", "Camp", False),
])
cases("url_placeholder", urls.is_placeholder, [
    ("https://x.org/notice/?nid={n}", "/notice/?nid={id}", True), ("https://x.org/notice/?nid=a{n}", "/notice/?nid={id}", False), ("https://x.org/{n}.pdf", "/{id}.pdf", False), ("https://x.org/n/{n}", "https://x.org/n/{id}", True), ("https://x.org/n/{n}", "", False),
])
cases("url_enrichable", lambda u: urls.is_enrichable(u, ["files.x.org"]), [
    ("https://x.org/{n}.pdf", True), ("https://x.org/get/?wpdmdl={n}", True), ("https://x.org/a{n}", False), ("https://drive.google.com/file/d/a{n}/view", True), ("https://files.x.org/{n}", True), ("https://x.org/{n}.docx", False),
])
cases("url_double_pdf", lambda u: urls.known_double_pdf(u, ["x.org"]), [
    ("https://x.org/circular/{n}.pdf.pdf", "https://x.org/circular/{n}.pdf"), ("https://x.org/circular/{n}.PDF.pdf?q=1", "https://x.org/circular/{n}.pdf?q=1"), ("https://y.org/circular/{n}.pdf.pdf", "https://y.org/circular/{n}.pdf.pdf"), ("https://x.org/other/{n}.pdf.pdf", "https://x.org/other/{n}.pdf.pdf"), ("https://x.org/circular/{n}.pdf", "https://x.org/circular/{n}.pdf"),
])
cases("url_drive_direct", urls.drive_direct, [
    ("https://drive.google.com/file/d/A-{n}/view?usp=x", "https://drive.google.com/uc?export=download&id=A-{n}"), ("https://drive.google.com/open?id=B_{n}", "https://drive.google.com/uc?export=download&id=B_{n}"), ("https://x.org/file/d/{n}", "https://x.org/file/d/{n}"), ("https://drive.google.com/drive/{n}", "https://drive.google.com/drive/{n}"),
])
cases("url_resolve", urls.resolve, [
    ("https://x.org/a/b", "c{n}.pdf", "https://x.org/a/c{n}.pdf"), ("https://x.org/a/", "../{n}", "https://x.org/{n}"), ("https://x.org/", "//y.org/{n}", "https://y.org/{n}"), ("https://x.org/", "mailto:{n}", None), ("https://x.org/", "#{n}", None), ("https://x.org/a", "https://z.org/{n}", "https://z.org/{n}"), ("https://x.org/a", "?p={n}", "https://x.org/a?p={n}"), ("https://x.org/", "javascript:go()", None),
])
cases("url_tail_title", urls.tail_title, [
    ("https://x.org/files/annual-meeting_notice.pdf", "annual meeting notice"), ("https://x.org/%E9%9C%B2%E7%87%9F%E6%B4%BB%E5%8B%95/view", "露營活動"), ("https://drive.google.com/file/d/1Um6PXr5OXZa5bg4zJIPQIrVJDs/view", None), ("https://x.org/", None),
])
cases("url_skip_reason", urls.skip_reason, [("https://x.org/{n}.docx", ".docx"), ("https://x.org/a.verylongending", "no file ending"), ("https://x.org/a{n}", "no file ending"), ("https://x.org/{n}.MP4", ".mp4")])
cases("url_results", lambda u, a: urls.results_url(u, F.array(a, F.lit("z"))), [
    ("https://x.org?a=1&n=old", "{n}", "https://x.org/?a=1&n={n},z"), ("https://x.org/p#f", "{n}", "https://x.org/p?n={n},z#f"), ("https://x.org/p?n=1&n=2", "{n}", "https://x.org/p?n={n},z"),
])
cases("url_without_slash", urls.without_slash, [(" https://x.org/{n}// ", "https://x.org/{n}"), ("https://x.org/{n}", "https://x.org/{n}"), (None, "")])
cases("url_attachment", keys.effective_url, [("{n}.pdf", "page", "{n}.pdf"), ("", " p{n} ", "p{n}"), (None, "p", "p"), (" ", None, "")])

# Texts and titles.
cases("text_normal_forms", listed(text.normalize_text, text.match_text), [
    ("  ＡＢ&amp;Ｃ  d​ {n}", "AB&C d {n}|ab&cd{n}"), ("傑出　服務奬", "傑出 服務奬|傑出服務獎"), ("Camp&nbsp;Fire {n}", "Camp Fire {n}|campfire{n}"), (None, "|"), ("敎歳", "敎歳|教歲"),
])
cases("text_compact_title", text.compact_title, [("「渡假 營」通告", "度假營"), ("A-b C{n}!", "abc{n}"), ("夏令營通告通告", "夏令營通告"), (None, "")])
cases("text_clean_title", lambda c: text.clean_title(c), [
    ("[夏令營通告.pdf]", "夏令營通告"), ("TPN/CIR/VS/2627/003 露營訓練班", "露營訓練班"), ("Drive, 領袖訓練班 - 通告07.10", "領袖訓練班"), ("遠足活動 - >>連結<<", "遠足活動"), ("下載", None), (">>連結<<", None), ("12/06/2026", None), ("5 June 2026", None),
    ("截止日期：", None), ("abc", None), ("https://example.org/{n}.pdf", None), ("深資 活動名稱: 靜觀工作坊 活動日期: 2026年", "靜觀工作坊"), ("%E9%9C%B2%E7%87%9F%E6%B4%BB%E5%8B%95", "露營活動"), (None, None),
])
cases("text_generic_title", lambda c: text.is_generic_title(c), [("download", True), ("[ 按此下載 ]", True), ("", True), ("https://x.org/{n}", True), ("夏令營 {n}", False), ("Details", True)])
cases("text_opaque", text.looks_opaque, [("1Um6PXr5OXZa5bg4zJIPQIrVJDs-mTdh6", True), ("2026-07-18_annual-meeting.pdf", False), ("short{n}", False), ("周年大會通告周年大會通告周年大會", False)])
cases("text_trimmed", lambda c: text.trimmed(c, 5), [("abcdefg", "abcd…"), (" a  b ", "a b"), ("abcd efg", "abcd…"), (None, ""), ("abcde", "abcde")])
cases("text_slug", text.slug, [("Hello, World {n}!", "hello-world-{n}"), ("!!!", "notice"), ("露營 Camp", "露營-camp"), ("_a_", "_a_")])
cases("text_brackets", text.unbalanced_brackets, [("(a)「b」", False), ("a)", True), ("(x", True), ("『x", True), ("【{n}】", False), (")(", True)])
cases("text_table_row", text.looks_like_table_row, [("13, 17, 20 地質導賞", True), ("2026 Oct 10 班", True), ("50周年紀念活動", False), ("17 風帆研習班", True), ("夏令營", False)])
cases("text_clause", text.looks_like_clause, [("2.1 11至26歲的成員;", True), ("成員活動", False)])
cases("text_address", text.looks_like_address, [("長康邨康美樓C301室", True), ("Flat C301, Hong Mei House", True), ("露營訓練班通告", False)])
cases("text_heading", text.heading_of, [("香港區\n（一）日期：\n17 表格\n夏令營訓練班通告\n其他", "夏令營訓練班通告"), ("", None), ("長康邨康美樓C301室\n周年大會通告", "周年大會通告"), (None, None)])
cases("text_mojibake", text.mojibake_repaired, [("Ã©", "é"), ("plain {n}", "plain {n}"), (None, None)])
cases("text_junk_title", reports.is_junk, [("12", True), ("Real title {n}", False), ("", True), (" 7 ", True)])
cases("text_effective_variants", lambda c: joined(text.title_variants(c)), [("露營活動", "露營活動"), ("露營活動通告 - 第二期活動", "露營活動通告 - 第二期活動|露營活動通告|第二期活動")])

cases("text_listing_suffix", text.without_listing_suffix, [("夏令營訓練班 - 通告07.10", "夏令營訓練班"), ("夏令營訓練班 - >>下載連結<<", "夏令營訓練班"), ("夏令營訓練班 — https://x.org/{n}", "夏令營訓練班"), ("營 - 通告12", "營 - 通告12"), ("夏令營訓練班", "夏令營訓練班"), (None, "")])
cases("text_bad_fragment", text.has_bad_fragment, [("café {n}", True), ("夏令營 {n}", False), ("20°", True), ("ã", True)])
cases("page_charset", text.charset, [("big5", "utf-8", "utf-8"), ("big5", "big5", "cp950"), ("cp950", "cp1251", "cp950"), ("utf-8", "big5", "utf-8"), (None, "GB18030", "gb18030"), (None, "cp1251", "utf-8"), ("", "", "utf-8"), (None, "utf_8", "utf_8")])
cases("page_decoded", lambda h, c: text.decoded(F.unhex(h), c), [("A4A4", "cp950", "中"), ("E4B8AD", "utf-8", "中"), ("D6D0", "gbk", "中"), ("E9", "latin-1", "é"), ("E9", "utf-8", "�")])


cases("text_salvaged_title", text.title_from_row, [
    ("12/06/2026 童軍 夏令營訓練班 所有成員 接受報名", "夏令營訓練班"), ("2026年6月3日 深資童軍遠足活動 活動/訓練", "深資童軍遠足活動"), ("行政通告", None), ("TPN/CIR/VS", None), ("KSD2627", None), ("5 June 2026 領袖訓練班 已經結束", "領袖訓練班"),
    ("特別通告第 12/26 號 周年大會通告", "周年大會通告"), ("", None), (None, None), ("2026-06-03 幼童軍 同樂日活動 幼童軍, 家長", "同樂日活動"),
])

# Dates, deadlines and fees.
cases("date_found", dates.find_date, [
    ("2026 年 6 月 30 日 {n}", "2026-06-30"), ("由2026/6/3起", "2026-06-03"), ("30-06-2026", "2026-06-30"), ("2026年13月40日", None), ("2026-12-34 或 31/12/2026", "2026-12-31"), ("2026年2月30日，2026-03-01", "2026-03-01"), ("", None), (None, None),
])
cases("date_deadline", lambda c: dates.deadline(c), [
    ("日期：2026年1月1日\n截止日期：\n2026年6月30日", "2026-06-30"), ("截止：2026-05-05\n截止報名日期：2026-06-06", "2026-06-06"), ("活動2026年1月1日", None), ("必須於2026年11月30日（星期一）或之前交回", "2026-11-30"), ("報名已截止", "已截止"), ("", None), ("截止日期：待定\n截止：2026年7月1日", "2026-07-01"),
])
cases("date_iso", lambda c: dates.iso_date(c), [("2026-01-31T10:00:00", "2026-01-31"), ("2026-02-30x", None), (" 2026-03-01", "2026-03-01"), ("soon {n}", None), (None, None)])
cases("fee_labels", money.has_fee_label, [("費用：", True), ("材料費($)", True), ("費用發放方式", False), ("", False), ("名額：{n}", False), ("費用", True)])
cases("fee_normal", money.normal_fee, [("USD$10", "US$10"), ("{n}元", "HK${n}"), ("面議", "面議"), ("港幣 {n} 元正", "HK${n}"), ("費用全免", "全免"), ("", None)])
cases("fee_in_tables", lambda c: money.fee(F.lit(""), F.from_json(c, "array<array<array<string>>>")), [
    ('[[["日期", "費用($)"], ["1", ""], ["2", "160"]]]', "HK$160"), ('[[["日期", "費"], ["1", "160"]]]', None), ('[[["費用發放方式"], ["160"]]]', None), ('[[["材料費"], ["待定"], ["$80"]]]', "HK$80"), ('[[["按金"], ["500"]]]', None), (None, None),
])
cases("table_column", lambda c: joined(dates.column_values(F.from_json(c, "array<array<array<string>>>"), "截止")), [
    ('[[["日期", "截止日期"], ["a", "b"], ["c", " d "]]]', "b|d"), ('[[["日期"], ["a"]]]', ""), ('[[["x"], ["截止"], ["y"]], [["截止"], ["z"]]]', "y|z"),
])
cases("deadline_in_tables", lambda c: dates.deadline(F.lit("截止日期：2026年9月9日"), F.from_json(c, "array<array<array<string>>>")), [('[[["日期", "截止日期"], ["2026年1月1日", "2026年2月2日"]]]', "2026-02-02"), ('[[["日期"], ["2026年1月1日"]]]', "2026-09-09"), (None, "2026-09-09")])
cases("label_scope", lambda c: money.label_scope(c, ("資格",), 2, ("報名",), ("合資格",)), [("歡迎合資格人士\n資格：成員\n另\n報名：x", "成員 另"), ("無", None)])

# Audiences, sections and categories.
cases("audience_names", audience.audience, [
    ("歡迎各合資格的人士\n參加資格：深資童軍及樂行童軍\n報名：領袖", "深資童軍、樂行童軍"), ("致：各旅領袖", "領袖"), ("沒有說明", None), ("對象:\n(1)幼童軍\n(2)領袖\n費用:家長", "幼童軍、領袖"), ("參加資格：15歲以上之童軍成員", "童軍、深資童軍、樂行童軍"),
    ("參加資格：18歲或以上之童軍成員", "深資童軍、樂行童軍"), ("參加資格：年滿12歲的各支部成員", "各支部成員（年滿12歲）"), ("對象：幼童軍領袖，須獲家長同意", "領袖"), ("2.1 11至26歲的童軍、深資童軍或樂行童軍支部成員;\n2.2 持有證書\n截止日期：", "深資童軍、樂行童軍、童軍"),
    ("致：香港童軍中心十樓", None), ("致：各旅長\n知會：領袖", None), ("參加對象：童軍支部或以上成員", "童軍、深資童軍、樂行童軍"), ("參加資格：已完成領袖基本訓練班之會務委員", "會務委員"), ("參加對象：非童軍成員之公眾", "公眾"), (None, None),
], first=text.nfkc)
cases("audience_scope", audience.scope, [("前言\n申請資格：甲\n乙\n（三）日期：1月\n丙", "甲 乙"), ("資格：丁\n名額：5", "丁"), ("受文者：各旅長", "各旅長"), ("", None)], first=text.nfkc)
cases("section_ids", lambda c: joined(classify.sections(c, SECTIONS)), [("深資童軍", "深資童軍"), ("教練員", "領袖"), ("18歲以下", ""), ("幼童軍團", "幼童軍"), ("", "")])
cases("section_ages", lambda c: F.concat_ws("/", *[joined(x) for x in audience.sections_by_age(c)]), [
    ("15歲以上之童軍成員", "童軍|深資童軍|樂行童軍/"), ("15歲以上\n童軍成員", "童軍|深資童軍|樂行童軍/"), ("21歲或以上，一二三四五六七八九十一二三四五六七八九十一二三成員", "/"), ("21歲或以上，一二三四五六七八九十一二三四五六七八九十一成員", "樂行童軍/"), ("幼童軍或以上", "/幼童軍|童軍|深資童軍|樂行童軍"), ("18歲以下成員", "/"),
])
cases("section_filter", lambda t, a: browse.for_section(t, a, "幼童軍", SECTIONS), [("幼童軍日營", "", True), ("幼童軍日營", "深資童軍", False), ("日營", "所有成員", True), ("香港童軍總會公告", "", False)])
cases("masked_hits", lambda c: joined(classify.term_hits(classify.masked(c, ("成績公布",)), ("公布", "公告"))), [("成績公布", ""), ("成績公布及公告", "公告"), ("公布", "公布")])
cases("badge_forms", lambda c: F.concat_ws("|", F.size(classify.badge_forms(c)).cast("string"), F.get(classify.badge_forms(c), F.lit(0))), [("露營章", "12|露營專章"), ("獎章", "0"), ("露營", "0")])
cases("reference_document", lambda a, b: classify.is_reference(a, b), [("訓練班行事曆", "", True), ("通告【2026年10月】", "", True), ("訓練班", "章程", False), ("", "章程", True), ("露營{n}", "", False)])
cases("requirement_only", lambda a: classify.requirement_only(a, F.lit("獨木舟教練")), [("地質班持有獨木舟教練資歷優先", True), ("獨木舟教練班現正招生", False), ("由獨木舟教練擔任。本會另外開辦新一期課程名為獨木舟教練班歡迎各位報名", False)])
cases("text_notices", lambda c: F.to_json(html.text_notices(c, r"No\. (\d+): (\w+);", ("no", "name"))), [("No. {n}: Camp; No. 2: Hike;", '[{"no":"{n}","name":"Camp"},{"no":"2","name":"Hike"}]'), ("none", "[]")])
cases("brace_objects", lambda c: joined(html.brace_objects(c)), [('x {"a":{n},"b":"}"} y {bad} {"c":{"d":1}}', '{"a":{n},"b":"}"}|{"c":{"d":1}}'), ("", "")])
cases("drive_entries", lambda c: joined(html.drive_entries(c)), [('<a href="/file/d/abcdefghij{n}/view"> /file/d/abcdefghij{n}/ /file/d/short/', "abcdefghij{n}"), ("", "")])
cases("refresh_target", html.refresh_target, [("0; URL='https://x.org/{n}?a=1;b=2'", "https://x.org/{n}?a=1;b=2"), ("5", ""), (None, "")])
cases("store_kind", lambda a, b: browse.store_kind(a, b), [("x", "tools", "tool"), ("x", "Games", "game"), ("遊戲", "", "game"), ("x", "", "tool")])
cases("subscription_error", lambda e: browse.valid_subscription(e, F.lit("A" * 87), F.lit("B" * 22), ["example.com"]), [("https://push.example.com/{n}", None), ("http://push.example.com/x", "endpoint"), ("https://evil.com/x", "host"), ("https://notexample.com/x", "host"), (None, "endpoint")])
cases("story_category", selection.story_category, [
    ("大會操失物認領安排", "announcement"), ("香港童軍大會操步操比賽", "competition"), ("香港童軍大會操工作人員", "service"), ("香港童軍大會操", "activity"), ("成績公布", "competition"), ("總部公告", "announcement"), ("優異旅團獎勵計劃", "announcement"), ("青年獎勵計劃", "training"),
    ("同樂日比賽", "activity"), ("專章(服務組)訓練班", "training"), ("義工招募", "service"), ("龍舟邀請賽隊員招募", "competition"), ("取錄名單", "announcement"), ("羽毛球會招收會員", "announcement"), ("燒烤派對", "activity"), ("皮革藝術", "other"),
])


def classified(name: str, examples: Sequence[tuple[str, str, str]]) -> None:
    """The whole classifier, topic and evidence included."""
    def run(spark, sf_dir: str) -> DataFrame:
        at = F.col(KEY) % len(examples)
        pick = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in examples]), at.cast("int") + 1)
        rows = Tables(spark, sf_dir).part.select(KEY, pick(0).alias("title"), pick(1).alias("body"))
        return classify.classify(rows, "title", "body").select(KEY, classify.category_topic(F.col("category")).alias("result"))

    QUERIES[name] = run
    whens = " ".join(f"WHEN {i} THEN {literal(e[2])}" for i, e in enumerate(examples))
    ORACLE_SQL[name] = f"SELECT {KEY}, CASE {KEY} % {len(examples)} {whens} END AS result FROM part"


classified("notice_category", [
    ("露營訓練班", "", "category:training"), ("社區服務日", "", "category:service"), ("追蹤挑戰賽(服務邀請)", "", "category:service"), ("全港錦標賽", "", "category:competition"), ("大會操失物認領安排", "", "category:announcement"), ("2026年香港童軍大會操", "", "activity:other"),
    ("香港童軍大會操步操比賽成績公布", "", "category:competition"), ("總部公告", "社會服務", "category:announcement"), ("比賽成績公布", "", "category:competition"), ("青年獎勵計劃簡介會", "", "category:training"), ("優異旅團獎勵計劃", "訓練班", "category:announcement"), ("同樂日", "挑戰賽", "activity:other"),
    ("羽毛球會-入會表格", "訓練班", "category:announcement"), ("通告一覽", "訓練班", "category:announcement"), ("皮革藝術", "參加訓練班", "category:training"), ("", "開放日", "activity:other"), ("皮革藝術", "開放日", "category:announcement"), ("大露營同樂日", "", "activity:big-camp"), ("營火會", "", "activity:campfire"),
])

TOPICS = [
    ("category:training", "訓練", "category", ["*"], [], [], "", None), ("category:service", "服務", "category", ["*"], [], [], "", None), ("activity:other", "其他", "category", ["*"], [], [], "", None),
    ("c1", "露營章", "course", ["童軍"], ["野營技巧"], [], "技能", None), ("c2", "風帆章", "course", ["童軍", "深資童軍"], [], ["滑浪風帆章"], "技能", None), ("c3", "露營", "course", ["幼童軍"], [], [], "", None),
    ("t1", "童軍訓練", "training", ["童軍"], [], [], "", "t9"), ("t2", "童軍技能", "training", ["童軍"], [], [], "技能", None), ("t3", "木章", "training", ["領袖"], ["木章"], [], "", None), ("t4", "領袖訓練", "training", ["領袖"], [], [], "", "c1"),
]
TOPIC_FIELDS = "id string, label string, kind string, branches array<string>, aliases array<string>, exclude array<string>, section string, excludes_topic string"
# Title, text, audience, hint; then sections and topics.
TAGGED = [
    ("童軍露營訓練班", "", "", "", "童軍", "c1,category:training,t1,t2"),
    ("露營訓練班", "", "", "", "幼童軍|童軍", "c1,c3,category:training,t1,t2"),
    ("露營訓練班", "", "幼童軍", "", "幼童軍", "c3,category:training"),
    ("滑浪風帆章考驗", "", "", "童軍", "童軍", "category:training,t1,t2"),
    ("露營訓練班行事曆", "", "童軍", "", "童軍", ""),
    ("木章課程", "", "領袖", "", "領袖", "category:training,t3,t4"),
    ("地質訓練班", "持有野營技巧資歷優先", "童軍", "", "童軍", "category:training,t1,t2"),
    ("社區服務日", "", "童軍", "領袖", "童軍", "category:service"),
    ("皮革藝術", "", "", "", "", ""),
]


def notice_tags(spark, sf_dir: str) -> DataFrame:
    at = F.col(KEY) % len(TAGGED)
    pick = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in TAGGED]), at.cast("int") + 1)
    rows = Tables(spark, sf_dir).part.select(F.col(KEY).alias("notice_key"), *[pick(i).alias(n) for i, n in enumerate(("title", "text", "audience", "hint"))], F.lit("s").alias("source"))
    topics = spark.createDataFrame(TOPICS, TOPIC_FIELDS)
    out = tagging.tagged(rows, topics, SECTIONS)
    return out.select(F.col("notice_key").alias(KEY), F.array_join(F.array_sort("branch_tags"), "|").alias("sections"), F.array_join("subscription_tags", ",").alias("topics"))


QUERIES["notice_tags"] = notice_tags
ORACLE_SQL["notice_tags"] = f"SELECT {KEY}, CASE {KEY} % {len(TAGGED)} " + " ".join(f"WHEN {i} THEN {literal(e[4])}" for i, e in enumerate(TAGGED)) + f" END AS sections, CASE {KEY} % {len(TAGGED)} " + " ".join(f"WHEN {i} THEN {literal(e[5])}" for i, e in enumerate(TAGGED)) + " END AS topics FROM part"


# Pages: one for each row of the table, written from its key.
PAGE = (
    '<html><head><script>var a = "</p>";</script></head><body><h2>Notices of {n}</h2><table><tr><td>Row title {n}</td><td><ul><li>inner</li></ul><a href="/{n}.pdf">here</a></td></tr></table>'
    '<ul><li>Second row {n} <a href="b{n}.pdf" title="T{n}"></a></li></ul><a data-id="7{n}" href="">Card {n}</a><a data-id="7{n}" href="">again</a>'
    '<p>Title of frame {n}</p><iframe src="https://x.org/frame/{n}"></iframe><a href="/list?page=2">2</a><a href="/list?page=3">3</a><a href="/list?page=2">again</a>'
    '<meta http-equiv="refresh" content="0; URL=\'https://x.org/{n}.pdf\'"></body></html>'
)


def made_pages(spark, sf_dir: str) -> DataFrame:
    n = F.col(KEY).cast("string")
    return html.nodes(Tables(spark, sf_dir).part.select(KEY, F.replace(F.lit(PAGE), F.lit("{n}"), n).alias("html")), KEY)


def of_pages(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(made_pages(spark, sf_dir))
    ORACLE_SQL[name] = sql


of_pages("page_row_titles", lambda f: html.row_titles(f, KEY).where("row > 0").select(KEY, "href", "title"), f"SELECT {KEY}, '/' || {KEY} || '.pdf' AS href, 'Row title ' || {KEY} AS title FROM part UNION ALL SELECT {KEY}, 'b' || {KEY} || '.pdf', 'Second row ' || {KEY} FROM part")
of_pages("page_link_texts", lambda f: html.anchors(f).where("row > 0").select(KEY, "href", "text"), f"SELECT {KEY}, '/' || {KEY} || '.pdf' AS href, 'here' AS text FROM part UNION ALL SELECT {KEY}, 'b' || {KEY} || '.pdf', 'T' || {KEY} FROM part")
of_pages("page_cards", lambda f: html.cards(f, KEY).select(KEY, "card_id", "title", "href"), f"SELECT {KEY}, '7' || {KEY} AS card_id, 'Card ' || {KEY} AS title, '/notice/?nid=7' || {KEY} AS href FROM part")
of_pages("page_frames", lambda f: html.nearest_text(f, KEY).select(KEY, "href", "title"), f"SELECT {KEY}, 'https://x.org/frame/' || {KEY} AS href, 'Title of frame ' || {KEY} AS title FROM part")
of_pages("page_listings", lambda f: html.listing_pages(f, "page=", 1, KEY).select(KEY, "href"), f"SELECT {KEY}, '/list?page=2' AS href FROM part")
of_pages("page_assets", lambda f: html.detail_assets(f, KEY).where("how != 'a'").select(KEY, "href", "how"), f"SELECT {KEY}, 'https://x.org/frame/' || {KEY} AS href, 'iframe' AS how FROM part UNION ALL SELECT {KEY}, 'https://x.org/' || {KEY} || '.pdf', 'refresh' FROM part")


def payload_rows(spark, sf_dir: str) -> DataFrame:
    n = F.col(KEY).cast("string")
    payload = F.replace(F.lit('x {"title":"A {b} {n}","pdf":"","link":"l{n}"} y {bad} {"title":"C","pdf":"p{n}"}'), F.lit("{n}"), n)
    rows = Tables(spark, sf_dir).part.select(KEY, payload.alias("payload"))
    return html.payload_rows(rows, "payload", "title string, pdf string, link string").select(KEY, "title", "href")


QUERIES["payload_rows"] = payload_rows
ORACLE_SQL["payload_rows"] = f"SELECT {KEY}, 'A {{b}} ' || {KEY} AS title, 'l' || {KEY} AS href FROM part UNION ALL SELECT {KEY}, 'C', 'p' || {KEY} FROM part"


def asset_joins(spark, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    items = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("asset_id"))
    assets = t.part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("url"))
    return html.joined_assets(items, assets).select("l_orderkey", "l_linenumber", "asset_url")


QUERIES["asset_joins"] = asset_joins
ORACLE_SQL["asset_joins"] = "SELECT l_orderkey, l_linenumber, p_name AS asset_url FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 25"
