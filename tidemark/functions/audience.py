"""Who a notice is for: the words of its eligibility field, and the names in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as t
from .text import VARIANTS, compact, let

# Patterns of labels, of the fields after them, of numbered clauses, and of addressees; what is no participant; and the names that count.
EXPLICIT = r"(?<![一-鿿])(?:參加資格|參加對象|入會資格|受資助資格|資助對象|申請資格|參選資格|提名資格|甄選資格|受獎資格)\s*[:：]?"
WEAK = r"^(?:[（(]?[一二三四五六七八九十\d]+[）)、.]\s*)?(?:對象|資格)\s*[:：]"
BOUNDARY = (
    r"^(?:[（(]?[一二三四五六七八九十\d]+[）)、.]\s*)?"
    r"(?:班領導人資格|會議形式|考驗形式|學習時數|課程內容|資助金額|資助範圍|"
    r"發放款項|費用|收費|名額|報名|截止|日期|時間|地點|內容|服飾|服裝|備註|注意|查詢)"
)
HEADED = r"^[（(][一二三四五六七八九十]+[）)].*[:：]"
CLAUSE = r"^(?:\d{1,2}(?:\.\d{1,2})+|[（(]?\d{1,2}[）).、]|[（(][一二三四五六七八九十]{1,3}[）)])\s*\S"
SECTION_NAMES = "小童軍|幼童軍|深資童軍|樂行童軍|童軍"
MEMBERS = "成員|資格|對象|人士|參加者"
ADDRESSEE = r"^(?:致|受文者)\s*[:：]\s*(.+)$"
ADDRESS_TERMS = ("辦事處", "香港童軍中心", "柯士甸道", "西貢公路", "郵政信箱", "樓", "室")
ADDRESSEE_TERMS = ("旅長", "負責領袖", "領袖", "隊長", "成員", "童軍人士", "童軍旅", "會務委員", "家長")
NO_PARTICIPANTS = (
    (r"(?:獲得|取得|獲)?(?:家長|監護人)(?:(?:或|及|[/／])(?:家長|監護人))?(?:的)?(?:簽署)?(?:同意書|同意)", ""),
    (r"(?:完成|考獲)(?:了)?[^；;。\n]{0,60}?(?:訓練班|訓練課程|課程)(?:[（(][^）)]*[）)])?", ""),
    (r"(?<![小幼資行])童軍(?:成員編號|紀錄冊|領袖基本訓練班|運動基本原則(?:訓練班)?)", ""),
    (r"(?:小童軍|幼童軍|深資童軍|樂行童軍|童軍)(?:支部)?(?:各級)?(?:團團長|團長|領袖)", "領袖"),
    (r"非(?:小童軍|幼童軍|深資童軍|樂行童軍|童軍)(?:成員)?", ""),
    (r"教練員", "領袖"),
)
NAMES = ("小童軍", "幼童軍", "深資童軍", "樂行童軍", "童軍", "領袖", "家長", "成年成員", "會務委員", "公眾", "受薪職員", "家屬", "團執行委員會主席", "學校旅負責老師")
BROAD = "各(?:級)?支部成員|各級童軍成員"
BROAD_AGE = r"(?:年滿|年齡(?:為)?)(\d+)歲|(?:\d+)歲或以上"
LINES_AFTER, CLAUSE_LINES, CLAUSES_AFTER, ADDRESSEE_LINES = 16, 40, 4, 15

NONE = "CAST(array() AS array<string>)"


def sections_by_age(text: Column) -> tuple[Column, Column]:
    """Sections that 'N years or above' near a member word implies, and those that 'SECTION or above' does. ``text``: NFKC form."""
    ages = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,2})\s*歲\s*(?:或以上|以上)(?=(?s:.){0,22}?(?:童軍|成員|支部))"), 1), lambda a: a.cast("int"))
    tops = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(top).alias("top")) for s, top in t.AGE_SECTIONS.items()])
    by_age = F.transform(F.filter(tops, lambda x: F.exists(ages, lambda a: x["top"] >= a)), lambda x: x["s"])
    order = F.array(*[F.lit(s) for s in t.SECTIONS])
    named = F.regexp_extract_all(text, F.lit(r"(小童軍|幼童軍|深資童軍|樂行童軍|童軍)(?:支部)?\s*(?:或以上|以上)"), 1)
    above = F.array_distinct(F.flatten(F.transform(named, lambda n: F.slice(order, F.array_position(order, n).cast("int"), F.lit(len(t.SECTIONS))))))
    return by_age, above


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_line(lines: Column, test: Callable[[Column], Column]) -> Column:
    """The place of the first line that passes, from 0; null if none does."""
    places = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.get(F.filter(places, lambda i: F.coalesce(test(F.get(lines, i)), F.lit(False))), F.lit(0))


def until(lines: Column, ends: Callable[[Column], Column]) -> Column:
    """The lines before the first that ends them."""
    return let(first_line(lines, ends), lambda at: F.when(at.isNull(), lines).otherwise(F.slice(lines, F.lit(1), at)))


def addressees(text: Column) -> Column:
    """Whom a letter is to: the first such line at its start, unless that is a postal address without a role; null if there is none."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, ADDRESSEE_LINES)
    named = F.transform(lines, lambda x: F.regexp_extract(compact(x), ADDRESSEE, 1))
    return F.get(F.filter(named, lambda x: (x != "") & (~x.rlike("|".join(ADDRESS_TERMS)) | x.rlike("|".join(ADDRESSEE_TERMS)))), F.lit(0))


def scope(text: Column) -> Column:
    """``text``: NFKC form, in a column of its own (what needs Python can't stand in a lambda). The words of the eligibility field: after a sure label, else after a plain one at a line's start, up to the next field; else a
    numbered clause with an age, a section and a member word near the start; else the addressees. Null if there is none of these: rather none than a guess."""
    def labelled(lines: Column, pattern: str) -> Column:
        def found(at: Column) -> Column:
            rest = F.regexp_extract(F.get(lines, at), f"^.*?(?:{pattern.removeprefix('^')})(.*)$" if not pattern.startswith("^") else f"{pattern}(.*)$", 1)
            below = until(F.slice(lines, at + 2, F.lit(LINES_AFTER)), lambda x: x.rlike(BOUNDARY) | x.rlike(HEADED))
            return F.when(at.isNotNull(), stripped(F.array_join(F.concat(F.array(rest), below), " ")))

        return let(first_line(lines, lambda x: x.rlike(pattern)), found)

    def clause(lines: Column) -> Column:
        def found(at: Column) -> Column:
            below = until(F.slice(lines, at + 2, F.lit(CLAUSES_AFTER)), lambda x: x.rlike(BOUNDARY) | ~x.rlike(CLAUSE))
            return F.when(at.isNotNull(), stripped(F.array_join(F.concat(F.array(F.get(lines, at)), below), " ")))

        return let(first_line(F.slice(lines, 1, CLAUSE_LINES), lambda x: x.rlike(CLAUSE) & x.contains("歲") & x.rlike(SECTION_NAMES) & x.rlike(MEMBERS)), found)

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"), lambda x: stripped(compact(x)))
    in_field = let(lines, lambda x: F.coalesce(labelled(x, EXPLICIT), labelled(x, WEAK), clause(x)))
    return F.coalesce(in_field, addressees(text))


def audience_in(words: Column) -> Column:
    """The names in the words of an eligibility field, joined; null if there are none.

    Consents, courses to have done and papers are no participants; a section's leader is a leader. 'All sections' stays one
    name with its age. An age or a section 'or above' adds the sections that it implies, and a bare section name beside an age
    is then no section.
    """
    def cleaned(c: Column) -> Column:
        for pattern, by in NO_PARTICIPANTS:
            c = F.regexp_replace(c, pattern, by)
        return c

    def named(c: Column) -> Column:
        def step(acc: Column, name: Column) -> Column:
            there = F.contains(acc["rest"], name)
            return F.struct(F.when(there, F.replace(acc["rest"], name, F.lit(""))).otherwise(acc["rest"]).alias("rest"), F.when(there, F.concat(acc["found"], F.array(name))).otherwise(acc["found"]).alias("found"))

        found = F.aggregate(F.array(*[F.lit(n) for n in NAMES]), F.struct(c.alias("rest"), F.expr(NONE).alias("found")), step)["found"]
        age = F.regexp_extract(c, BROAD_AGE, 0)
        every = F.concat(F.lit("各支部成員"), F.when(age != "", F.concat(F.lit("（"), age, F.lit("）"))).otherwise(""))
        return F.when(c.rlike(BROAD), F.concat(F.array(every), F.array_except(found, F.array(F.lit("童軍"))))).otherwise(found)

    youth = F.array(*[F.lit(s) for s in t.SECTIONS])
    others = "|".join(s for s in t.SECTIONS if s != "童軍")
    by_age, above = sections_by_age(F.translate(words, *VARIANTS))

    def joined(c: Column) -> Column:
        found = F.when((F.size(by_age) > 0) & ~c.rlike(others), F.array_except(named(c), youth)).otherwise(named(c))
        implied = F.filter(youth, lambda s: F.array_contains(by_age, s) | F.array_contains(above, s))
        return F.nullif(F.array_join(F.array_union(found, implied), "、"), F.lit(""))

    return F.when(words.isNotNull(), let(cleaned(compact(words)), joined))


def audience(text: Column) -> Column:
    """Names in the scope of a text in NFKC form."""
    return audience_in(scope(text))
