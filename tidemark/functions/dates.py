"""Dates and deadlines in text, and inclusive day windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact, let

# The civil day of the data, date shapes (pattern, groups of year, month and day) in order of trust, and labels of deadlines.
ZONE = "Asia/Hong_Kong"
SHAPES = (
    (r"(20\d{2})年(\d{1,2})月(\d{1,2})日", (1, 2, 3)),
    (r"(20\d{2})年(\d{1,2})月(\d{1,2})", (1, 2, 3)),
    (r"(20\d{2})[-/](\d{1,2})[-/](\d{1,2})", (1, 2, 3)),
    (r"(\d{1,2})[-/](\d{1,2})[-/](20\d{2})", (3, 2, 1)),
)
LABEL = "截止"
SURE_LABELS = ("截止日期", "截止報名日期", "報名截止日期", "截止報名")
CLOSED = "已截止"
BEFORE = "(?:或之前|之前|前(?:交回|遞交|提交|呈交|寄回|寄交|回覆|電郵|傳真))"


def find_date(text: Column) -> Column:
    """The first valid date by the order of the shapes, as YYYY-MM-DD; null if none is valid. Impossible days fall through."""
    def tries(c: Column) -> Column:
        found = []
        for pattern, order in SHAPES:
            y, m, d = (F.regexp_extract(c, pattern, i) for i in order)
            found.append(F.when(c.rlike(pattern), F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")))
        return F.coalesce(*found)

    return let(compact(text), tries)


def first_of(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def deadline(text: Column, tables: Column | None = None) -> Column:
    """A deadline: a table's column for it, else a line with a sure label, else any line with the label (each with the two
    lines after it), else a date 'or before', else 'closed'; null if nothing says so."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    block = lambda i: F.array_join(F.slice(lines, i + 1, F.lit(3)), " ")
    line = lambda i: compact(F.get(lines, i))
    labelled = F.filter(at, lambda i: line(i).contains(LABEL))
    sure = F.filter(labelled, lambda i: line(i).rlike("|".join(SURE_LABELS)))
    pattern = r"(20\d{2}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)[^。；\n]{0,16}?" + BEFORE
    date_before = lambda t: find_date(F.nullif(F.regexp_extract(compact(t), pattern, 1), F.lit("")))
    near = F.filter(at, lambda i: line(i).rlike(BEFORE))
    around = lambda i: F.coalesce(date_before(F.get(lines, i)), date_before(F.concat(F.coalesce(F.get(lines, i - 1), F.lit("")), F.get(lines, i))), date_before(F.concat(F.get(lines, i), F.coalesce(F.get(lines, i + 1), F.lit("")))))
    options = [
        first_of(F.transform(sure, lambda i: find_date(block(i)))),
        first_of(F.transform(labelled, lambda i: find_date(block(i)))),
        first_of(F.transform(near, around)),
        F.when(F.exists(labelled, lambda i: compact(block(i)).contains(CLOSED)), F.lit(CLOSED)),
    ]
    if tables is not None:
        options.insert(0, find_date(F.get(column_values(tables, LABEL), F.lit(0))))
    return F.coalesce(*options)


def column_values(tables: Column, header: str, head_rows: int = 4) -> Column:
    """Non-empty cells under the first header cell that matches, table after table. ``tables``: arrays of rows of cells."""
    def of_table(rows: Column) -> Column:
        heads = F.slice(rows, 1, head_rows)
        cells = F.flatten(F.transform(heads, lambda row, i: F.transform(row, lambda cell, j: F.struct(i.alias("row"), j.alias("col"), cell.alias("cell")))))
        head = F.get(F.filter(cells, lambda x: compact(x["cell"]).rlike(header)), F.lit(0))
        body = F.slice(rows, head["row"] + 2, F.greatest(F.size(rows), F.lit(1)))
        return F.when(head.isNotNull(), F.transform(body, lambda row: F.trim(F.get(row, head["col"])))).otherwise(F.array().cast("array<string>"))

    return F.filter(F.flatten(F.transform(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), of_table)), lambda x: x.isNotNull() & (x != ""))


def iso_date(c: Column) -> Column:
    """The date that the first ten characters spell, or null."""
    return F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd")


def civil_day(ts: Column) -> Column:
    """The civil day of an instant (sessions run in UTC)."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def within_days(day: Column, today: Column, days: int) -> Column:
    """Both ends count: from ``days`` before today to today."""
    return day.between(F.date_sub(today, days), today)


def still_shown(day: Column, now: Column, days: int) -> Column:
    """A day is shown until exactly ``days`` times 24 hours after its start; that instant counts."""
    return F.unix_micros(now) - F.unix_micros(F.to_timestamp(day)) <= days * 86_400_000_000
