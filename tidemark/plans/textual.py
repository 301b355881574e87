"""Queries of text, address and page rules over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text, urls
from ..operators import classify, reports, rows
from ..sources import html
from ..streaming import jobs
from .registry import Tables, query

# Term lists for the driver's four languages: data, as the classifier's own lists are.
RULES = (("junk", ("license", "copyright")), ("german", (" und ", " der ")), ("french", (" les ", " des ")), ("spanish", (" los ", " del ")), ("english", (" the ", " of ")))


def listed(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in terms) + "]"


CASE = " ".join(f"WHEN len(list_filter({listed(v)}, lambda w: contains(lower(text), w))) > 0 THEN '{k}'" for k, v in RULES)
EVIDENCE = " ".join(f"WHEN len(list_filter({listed(v)}, lambda w: contains(lower(text), w))) > 0 THEN array_to_string(list_filter({listed(v)}, lambda w: contains(lower(text), w)), '|')" for k, v in RULES)


@query(f"SELECT doc_id, CASE {CASE} ELSE 'other' END AS category, CASE {EVIDENCE} ELSE '' END AS evidence FROM documents")
def priority_classifier(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.lower("text").alias("low"))
    hits = d.select("doc_id", *[classify.term_hits(F.col("low"), v).alias(k) for k, v in RULES])
    c = classify.category([(classify.has(F.col(k)), k, F.col(k)) for k, _ in RULES], "other")
    return hits.select("doc_id", c.alias("c")).select("doc_id", "c.id", F.array_join("c.evidence", "|").alias("evidence")).withColumnRenamed("id", "category")


ALL = ("the", "and", "tion", "und", "les", "que", "ñ")


@query(f"SELECT doc_id, array_to_string(list_filter({listed(ALL)}, lambda w: contains(lower(text), w)), ',') AS hits FROM documents")
def term_hits(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(classify.term_hits(F.lower("text"), ALL), ",").alias("hits"))


NAMES = {"the": "a", "thea": "b", "and": "c", "anda": "d", "tion": "e", "on": "f"}


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '(anda|thea|tion|and|the|on)'))), ',') AS found FROM documents")
def longest_match_scan(t: Tables) -> DataFrame:
    names = {k: k for k in NAMES}
    return t.documents.select("doc_id", F.array_join(F.array_sort(classify.scan_longest(F.lower("text"), names)), ",").alias("found"))


WHOLE = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"
HOST = f"lower(regexp_replace(regexp_replace(regexp_extract(url, {WHOLE}, 2), '^.*@', ''), ':\\d+$', ''))"
QUERY = f"regexp_extract(url, {WHOLE}, 4)"
PATH = f"regexp_extract(url, {WHOLE}, 3)"


@query(f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') || {PATH} || CASE WHEN {QUERY} != '' THEN '?' || {QUERY} ELSE '' END AS canonical FROM pages")
def url_canonical(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(f"""SELECT page_id, regexp_replace(CASE WHEN kept != '' THEN start || '?' || kept ELSE start END, '[?&]+$', '') AS clean FROM (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS start,
array_to_string(list_filter(string_split({QUERY}, '&'), lambda p: p != '' AND NOT list_contains(['v', 't', 'ver', 'timestamp', 'authuser', 'usp', 'fbclid', '_', 'nocache', 'rand', 'random', 'ref'], split_part(p, '=', 1)) AND NOT starts_with(p, 'utm_')), '&') AS kept FROM pages)""")
def url_sanitize(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.sanitize(F.col("url"), ["?ref"]).alias("clean"))


@query(f"""SELECT page_id, CASE WHEN contains(lower({PATH}), '.') THEN '.' || split_part(lower({PATH}), '.', -1) ELSE '' END AS ext, {HOST} AS host FROM pages""")
def url_ext(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.extension(F.col("url")).alias("ext"), urls.host(F.col("url")).alias("host"))


@query(f"""WITH c AS (SELECT page_id, url, regexp_replace({HOST}, '^(www|m|blog)\\.', '') AS site FROM pages) SELECT site, count(DISTINCT url) AS urls, count(DISTINCT page_id % 3) AS variants FROM c GROUP BY site HAVING count(DISTINCT url) >= 2 AND count(DISTINCT page_id % 3) > 1""")
def mirror_divergence(t: Tables) -> DataFrame:
    p = t.pages.select(F.regexp_replace(urls.host(F.col("url")), r"^(www|m|blog)\.", "").alias("site"), "url", F.array((F.col("page_id") % 3).cast("string")).alias("cats"))
    return reports.divergent_mirrors(p, "site", "url", "cats")


@query(f"""SELECT page_id, regexp_replace({HOST}, '^www\\.', '') || lower({PATH}) || CASE WHEN {QUERY} != '' THEN '?' || {QUERY} ELSE '' END AS k FROM pages""")
def url_story_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.story_key(F.col("url")).alias("k"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS found FROM orders""")
def find_date(t: Tables) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    written = F.when(k == 0, F.concat(F.lit("on "), F.date_format(d, "yyyy年M月d日"))).when(k == 1, F.date_format(d, "yyyy/M/d")).when(k == 2, F.concat(F.lit("99/99/2001 "), F.date_format(d, "dd-MM-yyyy"))).otherwise("2026-13-45")
    text_ = F.when(k == 2, F.date_format(d, "dd-MM-yyyy")).otherwise(written)
    shifted = t.orders.select("o_orderkey", F.regexp_replace(text_, "(19)(9[0-9])", "20$2").alias("s"))
    return shifted.select("o_orderkey", F.regexp_replace(dates.find_date(F.col("s")), "^20(9)", "19$1").alias("found"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '全免' WHEN 1 THEN 'HK$' || p_size WHEN 2 THEN 'HK$' || p_size || ' / HK$' || (p_size + 7) WHEN 3 THEN 'HK$' || p_size ELSE 'US$' || p_size END AS fee FROM part""")
def extract_fee(t: Tables) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 5
    line = (
        F.when(k == 0, F.lit("Line\n費用：全免\nend")).when(k == 1, F.concat(F.lit("費 用：港幣"), n, F.lit("元正。按金$500")))
        .when(k == 2, F.concat(F.lit("收費:$"), n, F.lit("、$"), (F.col("p_size") + 7).cast("string"))).when(k == 3, F.concat(F.lit("費用：$"), (2 * F.col("p_size")).cast("string"), F.lit("，資助後$"), n))
        .otherwise(F.concat(F.lit("US$"), n))
    )
    p = t.part.select("p_partkey", k.alias("k"), line.alias("line"))
    return p.select("p_partkey", F.when(F.col("k") == 4, money.normal_fee(F.col("line"))).otherwise(money.fee(F.col("line"))).alias("fee"))


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) != '')) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ' | '))) AS table_lines FROM documents""")
def line_shapes(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.contains(x, F.lit(" | ")))).cast("long").alias("table_lines"))


LINKS = """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"[^>]*>[^<]*</a>', 1) AS hrefs, regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1) AS texts FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<!--.*?-->', '', 'gs') AS html FROM pages))
"""


@query(LINKS + "SELECT page_id, nth, hrefs[nth] AS href, trim(texts[nth]) AS text FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS nth FROM a) WHERE hrefs[nth] != ''")
def page_anchors(t: Tables) -> DataFrame:
    found = html.anchors(html.nodes(t.pages)).withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("long"))
    return found.select("page_id", "nth", "href", "text")


@query()
def page_detail_assets(t: Tables) -> DataFrame:
    return html.detail_assets(html.nodes(t.pages))


@query(LINKS + "SELECT page_id, md5(array_to_string(list_transform(range(1, len(hrefs) + 1), lambda i: hrefs[i] || '|' || trim(texts[i])), '|')) AS fingerprint FROM a")
def page_fingerprint(t: Tables) -> DataFrame:
    return html.fingerprints(html.nodes(t.pages))


@query("""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style|noscript|template)\\b.*?</(script|style|noscript|template)>', '<x>', 'gs'), '<!--.*?-->', '', 'gs') AS h FROM pages),
p AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(h, '<[^>]*>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: x != '') AS parts FROM c)
SELECT page_id, array_to_string(parts, ' ') AS text FROM p WHERE len(parts) > 0""")
def html_text(t: Tables) -> DataFrame:
    return html.text_of(html.nodes(t.pages))


@query()
def nfkc_title(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.clean_title(F.substring_index("text", "\n", 1)).alias("title"), text.slug(F.col("text")).alias("slug"))


@query()
def title_similarity(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", "text")
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(other, "item_id").select("item_id", F.round(text.title_similarity(F.col("text"), F.col("other")), 6).alias("similarity"))


@query()
def greedy_or_dedupe(t: Tables) -> DataFrame:
    p = t.part.select("p_brand", "p_partkey", F.col("p_name").alias("title"), F.concat(F.col("p_size").cast("string"), F.lit("/"), (F.col("p_partkey") % 40).cast("string")).alias("url"))
    return rows.greedy_distinct(p, "p_brand", "p_partkey", "url", "title")


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2""")
def stream_daily_counts(t: Tables) -> DataFrame:
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    name = f"daily_{uuid.uuid4().hex[:12]}"
    done = jobs.daily_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    done.awaitTermination()
    return t.spark.table(name)
