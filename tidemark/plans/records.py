"""Queries of record forms, orders, guards and subscriptions' preferences over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse, classify, matching, records, reports, state, tagging
from ..operators.rows import exploded_map
from .registry import TODAY, Tables, query

RAW = """WITH raw AS (SELECT 's' || s_nationkey AS source_site, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'r' || s_suppkey % 4 END AS region, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'u' || s_suppkey END AS pdf_url, s_name AS title, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') END AS captured_date, s_suppkey % 2 = 0 AS tagged FROM supplier),
src AS (SELECT 's' || n_nationkey AS source_site, n_name AS region FROM nation WHERE n_nationkey % 2 = 0),
norm AS (SELECT source_site, coalesce(raw.region, src.region, '') AS region, coalesce(pdf_url, '') AS pdf_url, title, coalesce(captured_date, '') AS captured_date, CASE WHEN tagged THEN 'a,b' END AS tags FROM raw LEFT JOIN src USING (source_site))
"""


def raw_records(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("source_site"), F.when(k % 3 != 0, F.concat(F.lit("r"), (k % 4).cast("string"))).alias("region"), F.when(k % 5 != 0, F.concat(F.lit("u"), k.cast("string"))).alias("pdf_url"), F.col("s_name").alias("title"),
        F.when(k % 7 != 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("captured_date"), F.lit(None).cast("string").alias("published_date"), F.lit(None).cast("string").alias("backfilled_at"), F.lit(None).cast("boolean").alias("suppress_notifications"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.expr(records.NONE)).alias("tags"),
    )


def normal(t: Tables) -> DataFrame:
    sources = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("source_site"), F.col("n_name").alias("region"))
    return records.normalised(raw_records(t), sources)


def plain(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", ",")).drop(*records.OPTIONAL)


@query(RAW + "SELECT * FROM norm")
def normalised_records(t: Tables) -> DataFrame:
    return plain(normal(t))


@query(RAW + "SELECT title, pdf_url AS url, pdf_url, captured_date AS date, captured_date, source_site, region, tags FROM norm")
def grouped_entries(t: Tables) -> DataFrame:
    return plain(records.grouped_entries(normal(t)))


@query(RAW + "SELECT source_site, region, pdf_url, title, captured_date, tags FROM norm")
def flat_entries(t: Tables) -> DataFrame:
    return plain(records.flat_entries(normal(t)))


@query(RAW + ", known AS (SELECT DISTINCT source_site, pdf_url FROM norm WHERE title LIKE '%1') SELECT source_site, region, pdf_url, title, CASE WHEN (source_site, pdf_url) IN (SELECT (source_site, pdf_url) FROM known) THEN NULL ELSE DATE '2024-01-31' END AS captured_date, tags, (source_site, pdf_url) IN (SELECT (source_site, pdf_url) FROM known) AS is_update FROM norm")
def asset_payloads(t: Tables) -> DataFrame:
    n = normal(t)
    return records.payloads(n, n.where("title LIKE '%1'"), F.lit(TODAY).cast("date")).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT o_orderkey AS notice_key, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'b' || o_custkey % 5 END AS branch_tags, CASE WHEN o_orderkey % 4 = 0 THEN 'category:tools' ELSE 't' || o_orderkey % 7 END AS topic_tags, o_orderstatus = 'P' OR o_orderkey % 4 = 0 AS is_tools, CASE WHEN o_orderkey % 2 = 0 THEN 'd' ELSE '' END AS deadline, '' AS fee, '' AS audience FROM orders""")
def matching_metadata(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    made = lambda p, c: F.array(F.concat(F.lit(p), c.cast("string")))
    notices = t.orders.select(k.alias("notice_key"), F.col("o_orderstatus").alias("source"), made("b", F.col("o_custkey") % 5).alias("branch_tags"), made("t", k % 7).alias("subscription_tags"))
    stored = t.orders.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").select(k.alias("notice_key"), F.when(k % 3 == 0, F.array(F.lit("x"))).otherwise(F.expr(records.NONE)).alias("branch_tags"), F.when(k % 4 == 0, F.array(F.lit("category:tools"))).alias("subscription_tags"), F.when(k % 2 == 0, "d").alias("deadline"), F.lit(None).cast("string").alias("fee"), F.lit("").alias("audience"))
    out = records.matching_metadata(notices, stored, ["P"])
    return out.withColumns({c: F.array_join(c, ",") for c in ("branch_tags", "topic_tags")})


@query("""SELECT DISTINCT o_custkey AS sub_id, o_orderkey % 50 AS notice_key, DATE '2024-01-31' AS batch_date FROM orders""")
def delivery_rows(t: Tables) -> DataFrame:
    return records.delivery_rows(t.orders.select(F.col("o_custkey").alias("sub_id"), (F.col("o_orderkey") % 50).alias("notice_key")), F.lit(TODAY).cast("date"))


STORY = """WITH s AS (SELECT trim(p_name) AS title, CASE WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey ELSE 'u' || p_partkey END AS url, CASE WHEN p_partkey % 4 = 0 THEN 'sec' ELSE 'reg' END AS region, p_brand AS source_site, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE '2024-01-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END AS date, '2024-02-01' AS deadline, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE 'all' END AS audience, 'HK$' || p_size AS fee, p_type AS category FROM part)
"""


def story_rows(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00"))
    rows = t.part.select(
        F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("title"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(" u"), k.cast("string"))).alias("url"), F.concat(F.lit("p"), k.cast("string")).alias("pdf_url"), F.when(k % 4 != 0, "reg").alias("region"), F.lit("sec").alias("section"),
        F.col("p_brand").alias("source_site"), F.when(k % 6 != 0, day).alias("date"), F.lit("2024-02-01 at noon").alias("deadline"), F.when(k % 9 != 0, "all ").alias("audience"), F.concat(F.lit("HK$"), F.col("p_size").cast("string")).alias("fee"), F.col("p_type").alias("category"),
    )
    return records.story_items(rows)


@query(STORY + "SELECT *, title != '' AND date != '' AND audience != '' AS complete FROM s")
def story_items(t: Tables) -> DataFrame:
    return story_rows(t)


@query(STORY + "SELECT title, source_site, date, row_number() OVER (ORDER BY coalesce(nullif(date, ''), '9999-99-99'), source_site, title, url) AS place FROM s QUALIFY place <= 40")
def story_order(t: Tables) -> DataFrame:
    out = records.first_in_order(story_rows(t), [*records.story_order("date", "source_site", "title"), F.col("url")], 40)
    return out.select("title", "source_site", "date", F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate::VARCHAR DESC, o_orderpriority DESC, lpad(o_orderkey::VARCHAR, 12, '0') DESC) AS place FROM orders QUALIFY place <= 60""")
def flat_order(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("source"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("title"))
    return records.first_in_order(rows, records.flat_order("day", "source", "title"), 60).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""SELECT user_id, age, row_number() OVER (ORDER BY age DESC NULLS LAST, user_id) AS place FROM (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN NULL ELSE date_diff('day', max(CAST(ts AS DATE)), DATE '2024-01-31') END AS age FROM events GROUP BY user_id) QUALIFY place <= 200""")
def freshness_order(t: Tables) -> DataFrame:
    ages = t.events.groupBy("user_id").agg(F.datediff(F.lit(TODAY).cast("date"), F.max(F.to_date("ts"))).cast("long").alias("age")).withColumn("age", F.when(F.col("user_id") % 4 != 0, F.col("age")))
    return records.first_in_order(ages, records.freshness_order("age", "user_id"), 200).select("user_id", "age", F.col("place").cast("long").alias("place"))


@query("""SELECT 'store:' || s_suppkey AS id, s_name AS title, 'u' || s_suppkey AS url, '' AS category, DATE '2024-01-31' AS date, CASE WHEN s_suppkey % 5 != 0 THEN s_suppkey % 13 END AS sort_order, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 5 != 0 THEN s_suppkey % 13 END NULLS LAST, 'store:' || s_suppkey) AS place FROM supplier QUALIFY place <= 30""")
def catalog_order(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    apps = t.supplier.select(k.cast("string").alias("id"), F.concat(F.lit(" "), F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("category"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.when(k % 5 != 0, k % 13).alias("order"))
    out = records.first_in_order(records.store_entries(apps, F.lit(TODAY).cast("date")), records.catalog_order("sort_order", "id"), 30)
    return out.withColumns({"place": F.col("place").cast("long"), "sort_order": F.col("sort_order").cast("long")})


@query("""SELECT n_nationkey FROM nation WHERE n_nationkey % 5 != 0 AND n_nationkey % 7 != 3""")
def active_sources(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    s = t.nation.select("n_nationkey", F.when(k % 5 == 0, False).when(k % 2 == 0, True).alias("enabled"), F.when(k % 7 == 3, True).alias("expected_empty"))
    return records.active_sources(s).select("n_nationkey")


@query("""SELECT p_partkey FROM part WHERE p_partkey % 4 NOT IN (1, 2)""")
def circular_assets(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://x.org/"), k.cast("string"), F.when(k % 4 == 0, ".PDF").when(k % 4 == 1, ".docx?x=1").when(k % 4 == 2, ".Zip").otherwise("/get?wpdmdl=1"))
    return records.circular_assets(t.part.select("p_partkey", url.alias("url"))).select("p_partkey")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'second' END ELSE md5(html) END AS page FROM pages""")
def fallback_pages(t: Tables) -> DataFrame:
    k = F.col("page_id")
    first = t.pages.select("page_id", F.when(k % 3 == 0, "").otherwise(F.md5(F.col("html").cast("binary"))).alias("page"))
    return records.fallback_pages(first, t.pages.where(k % 2 == 0).select("page_id", F.lit("second").alias("page")), "page_id", "page")


@query("""SELECT page_id, contains(html, '<p') AS ready, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE page_id % 2 = 0 END AS follows FROM pages""")
def fetch_gates(t: Tables) -> DataFrame:
    k = F.col("page_id")
    explicit = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    return t.pages.select("page_id", records.is_fragment(F.col("html"), "<p").alias("ready"), records.follows_details(explicit, F.when(k % 2 == 0, "article")).alias("follows"))


@query("""SELECT l_partkey AS folder_id, coalesce(arg_min('k' || l_suppkey, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_linenumber > 2), '') AS resource_key FROM lineitem GROUP BY l_partkey""")
def drive_folder_keys(t: Tables) -> DataFrame:
    key = F.when(F.col("l_linenumber") > 2, F.concat(F.lit("k"), F.col("l_suppkey").cast("string"))).otherwise("")
    # Lines of one place in an order are taken as they stand in the table.
    place = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return records.folder_keys(t.lineitem.select(F.col("l_partkey").alias("folder_id"), key.alias("resource_key"), place.alias("pos")))


@query("""SELECT count(*) AS daily_new FROM (SELECT o_orderpriority, 'u' || o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-06-17' AND o_orderkey % 2 = 0 UNION SELECT o_orderpriority, 'u' || o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-06-17' AND o_orderkey % 3 = 0)""")
def new_today(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("source_site"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return records.new_today(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0"), F.lit("1995-06-17").cast("date"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def kept_catalog(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"))
    return records.kept_catalog(c.where("id % 3 = 0").withColumn("state", F.lit("old")), c.where("id % 2 = 0").withColumn("state", F.lit("new")))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'stale' WHEN c_custkey % 2 = 0 THEN 'no gain' ELSE 'publish' END AS verdict FROM customer""")
def publish_gate(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", records.gate(F.when(k % 3 != 0, "2024-01-31T08:00").when(k % 2 == 0, "2024-01-30"), F.lit(TODAY).cast("date"), k % 2).alias("verdict"))


@query("""SELECT coalesce(round(avg(c_custkey % 4), 1), 0) AS average FROM customer WHERE c_acctbal > 0""")
def average_topics(t: Tables) -> DataFrame:
    k = (F.col("c_custkey") % 4).cast("int")
    topics = F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("string")))
    return records.average_topics(t.customer.select((F.col("c_acctbal") > 0).alias("enabled"), topics.alias("topic_ids")))


@query("""SELECT o_orderpriority AS source, CASE o_orderstatus WHEN 'P' THEN 'not_pdf' ELSE 'download' END AS error, count(*) AS n FROM orders WHERE o_orderstatus != 'O' GROUP BY 1, 2""")
def error_counts(t: Tables) -> DataFrame:
    error = F.when(F.col("o_orderstatus") == "P", "not_pdf").when(F.col("o_orderstatus") == "F", "download")
    return records.error_counts(t.orders.select(F.col("o_orderpriority").alias("source"), error.alias("error")))


@query("""SELECT count(*) AS done, count(*) FILTER (WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS hit, round(count(*) FILTER (WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) / count(*), 3) AS rate FROM orders""")
def hit_rate(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return records.hit_rate(t.orders.select(F.when(k % 3 == 0, "d").alias("deadline"), F.when(k % 5 == 0, "a").otherwise("").alias("audience"), F.lit(None).cast("string").alias("fee")))


@query("""SELECT p_partkey::VARCHAR AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand || '/x · ' || p_type || ' · ' || p_name WHEN 1 THEN p_type || ' · ' || p_partkey ELSE p_name END AS name FROM part""")
def topic_labels(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    topics = t.part.select(
        F.col("p_partkey").cast("string").alias("id"), F.when(k == 0, F.array("p_brand", F.lit("x"))).when(k == 1, F.array(F.lit("*"))).alias("branches"),
        F.when(k != 2, F.col("p_type")).alias("group"), F.when(k != 1, F.col("p_name")).alias("label"),
    )
    return records.topic_labels(topics)


@query("""SELECT 's' || c_nationkey AS source, count(*) AS links, min('https://x.org/' || c_custkey || '.docx') AS example FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 20 <= 7 GROUP BY 1""")
def skipped_links(t: Tables) -> DataFrame:
    return tagging.skipped_links(link_rows(t), F.lit(TODAY).cast("date"))


def link_rows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://x.org/"), k.cast("string"), F.when(k % 3 == 0, ".docx").otherwise(".pdf"))
    return t.customer.select(F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("source"), url.alias("url"), F.date_sub(F.lit(TODAY).cast("date"), (k % 20).cast("int")).alias("captured"), "c_custkey")


@query("""SELECT c_custkey, 'incremental' AS mode FROM customer WHERE c_custkey % 3 != 0 AND c_custkey % 20 <= 7 AND c_custkey % 4 != 0 UNION ALL SELECT c_custkey, 'backfill' FROM customer WHERE c_custkey % 3 != 0 AND c_custkey % 4 != 0 UNION ALL SELECT c_custkey, 'all' FROM customer WHERE c_custkey % 3 != 0""")
def run_targets(t: Tables) -> DataFrame:
    rows = link_rows(t)
    done = rows.where("c_custkey % 4 = 0")
    out = [tagging.targets(rows, done, F.lit(TODAY).cast("date"), m).select("c_custkey", F.lit(m).alias("mode")) for m in ("incremental", "backfill", "all")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS loose, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 AS strict FROM orders""")
def current_tags(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    entry = t.orders.select("o_orderkey", F.lit("c").alias("category"), F.when(k % 2 == 0, F.expr(records.NONE)).alias("branch_tags"), F.expr(records.NONE).alias("subscription_tags"), F.when(k % 3 == 0, "v2").when(k % 3 == 1, "v1").alias("catalog"), F.when(k % 5 == 0, "e2").alias("extractor"))
    return entry.select("o_orderkey", tagging.has_current_tags(F.col("catalog"), "v2").alias("loose"), tagging.has_current_tags(F.col("catalog"), "v2", F.col("extractor"), "e2").alias("strict"))


# Subscriptions.
@query("""SELECT c_custkey AS sub_id, c_custkey IN (SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-06-17') AS silent FROM customer""")
def already_notified(t: Tables) -> DataFrame:
    done = t.orders.select(F.col("o_custkey").alias("sub_id"), F.to_date("o_orderdate").alias("batch_date"))
    return matching.already_notified(t.customer.select(F.col("c_custkey").alias("sub_id")), done, F.lit("1995-06-17").cast("date"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') * 2 > count(*) AS halt FROM orders GROUP BY o_custkey""")
def systemic_failures(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(matching.failures_are_systemic(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("halt"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN 'A,B,C' WHEN c_custkey % 5 = 1 THEN 'A,Z' WHEN c_custkey % 5 = 2 THEN '' ELSE 'B,A' END AS branches, CASE c_custkey % 5 WHEN 0 THEN 't1' WHEN 1 THEN 't2' WHEN 2 THEN 't1' WHEN 3 THEN 't9' ELSE 'all:new' END AS topics, CASE c_custkey % 5 WHEN 1 THEN 'branches' WHEN 2 THEN 'branches' WHEN 3 THEN 'topics' END AS error FROM customer""")
def valid_preferences(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    a = lambda *xs: F.array(*[F.lit(x) for x in xs]) if xs else F.expr(records.NONE)
    asked = t.customer.select(
        "c_custkey", F.when(k == 1, a("A", "Z")).when(k == 2, a()).otherwise(a("B", "A", "B")).alias("branch_ids"),
        F.when(k == 0, a("t1", "t1")).when(k == 1, a("t2")).when(k == 2, a("t1")).when(k == 3, a("t9")).otherwise(a("all:new")).alias("topic_ids"),
    )
    out = matching.valid_preferences(asked, ["t1", "t2"], ["A", "B", "C"])
    return out.select("c_custkey", F.array_join("branch_ids", ",").alias("branches"), F.array_join("topic_ids", ",").alias("topics"), "error")


@query("""SELECT p_partkey FROM part WHERE p_partkey % 7 != 0 AND p_partkey % 3 != 1""")
def visible_topics(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    topics = t.part.select("p_partkey", F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 7 == 0, True).alias("legacy"), F.when(k % 3 == 0, F.array(F.lit("*"))).when(k % 3 == 1, F.array(F.lit("B"))).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("branches"))
    return matching.visible_topics(topics, F.array(F.lit("A"))).select("p_partkey")


@query("""SELECT 'b' || n_regionkey AS id, 'duplicate id' AS fault FROM nation GROUP BY 1 HAVING count(*) > 1 UNION SELECT 't' || s_suppkey, 'missing label' FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT 't' || s_suppkey, 'unknown branch' FROM supplier WHERE s_suppkey % 6 = 0""")
def catalog_faults(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    branches = t.nation.select(F.concat(F.lit("b"), F.col("n_regionkey").cast("string")).alias("id"), F.col("n_name").alias("label"))
    topics = t.supplier.select(F.concat(F.lit("t"), k.cast("string")).alias("id"), F.when(k % 4 == 0, " ").otherwise(F.col("s_name")).alias("label"), F.when(k % 6 == 0, F.array(F.lit("b0"), F.lit("b99"))).when(k % 6 == 1, F.array(F.lit("*"))).otherwise(F.array(F.lit("b1"))).alias("branches"))
    return matching.catalog_faults(branches, topics)


# The reader's view.
@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'announcement' WHEN 1 THEN 'competition' ELSE 'activity' END AS kinds, o_orderkey % 4 = 1 AS races FROM orders""")
def category_filter(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 4
    one = lambda i, s: F.array(F.struct(F.lit(i).alias("id"), F.lit(s).cast("string").alias("subtype")))
    o = t.orders.select("o_orderkey", F.when(k == 1, one("activity", "competition")).when(k > 1, one("activity", "other")).alias("c"))
    return o.select("o_orderkey", F.array_join(browse.categories(F.col("c")), ",").alias("kinds"), browse.in_category(F.col("c"), "competition").alias("races"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN false WHEN c_custkey % 4 = 0 THEN false ELSE c_custkey % 30 <= 7 END AS week, CASE WHEN c_custkey % 9 = 0 THEN false ELSE c_custkey % 30 = 0 END AS today FROM customer""")
def time_windows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    day = F.when(k % 9 != 0, F.date_sub(F.lit(TODAY).cast("date"), (k % 30).cast("int")))
    shown = lambda w: F.coalesce(browse.in_window(F.col("day"), F.lit(TODAY).cast("date"), w, F.col("tool")), F.lit(False)).alias(w)
    return t.customer.select("c_custkey", day.alias("day"), (k % 4 == 0).alias("tool")).select("c_custkey", shown("week"), shown("today"))


@query("""SELECT p_partkey FROM part WHERE p_partkey % 9 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)""")
def exact_batch_view(t: Tables) -> DataFrame:
    ids = t.lineitem.where("l_quantity > 30").select(F.col("l_partkey").alias("p_partkey")).where("p_partkey % 9 = 0").unionByName(t.part.select((F.col("p_partkey") + 10_000_000).alias("p_partkey")))
    return browse.exact_batch(t.part.select("p_partkey"), ids, "p_partkey")


@query("""SELECT page_id FROM pages WHERE page_id % 3 != 0""")
def allowed_addresses(t: Tables) -> DataFrame:
    known = t.pages.where("page_id % 3 != 0").select(F.concat(F.lit("https://x.org/é "), F.col("page_id").cast("string")).alias("url"))
    raw = F.concat(F.lit("https://x.org/é "), F.col("page_id").cast("string"))
    asked = t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, raw).otherwise(F.replace(F.url_encode(raw), F.lit("%2F"), F.lit("/"))).alias("url"))
    return browse.allowed(asked, known).select("page_id")


# State and guards.
@query("""SELECT c_custkey AS url, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 != 0 THEN DATE '2000-01-01' ELSE DATE '2024-01-31' END AS public_on FROM customer""")
def blast_guard(t: Tables) -> DataFrame:
    rows = t.customer.select(F.col("c_custkey").alias("url"), F.lit(TODAY).cast("date").alias("public_on"))
    evidence = (F.col("url") % 2 != 0) | (F.col("url") % 5 == 0)
    return state.blast_guarded(rows, F.lit(TODAY).cast("date"), evidence, F.lit("2000-01-01").cast("date"))


@query("""SELECT c_custkey AS url FROM customer""")
def shrink_guard(t: Tables) -> DataFrame:
    all_ = t.customer.select(F.col("c_custkey").alias("url"))
    return state.shrink_guarded(all_.where("url % 2 = 0"), all_)[0]


@query("""SELECT 's' || n_nationkey AS source, CASE WHEN n_nationkey % 3 = 0 THEN 'new' || n_nationkey WHEN n_nationkey < 20 THEN 'old' || n_nationkey END AS fingerprint FROM nation WHERE n_nationkey < 20 OR n_nationkey % 3 = 0""")
def kept_fingerprints(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    old = t.nation.where("n_nationkey < 20").select(name("s").alias("source"), name("old").alias("fingerprint"))
    run = t.nation.select(name("s").alias("source"), name("new").alias("fingerprint"), F.when(k % 3 == 1, 0).otherwise(5).alias("assets"), F.when(k % 3 == 2, True).alias("failed"))
    return state.stored_fingerprints(old, run)


@query("""SELECT c_custkey AS url, CASE WHEN c_custkey % 4 = 0 THEN DATE '2024-01-31' WHEN c_custkey % 4 IN (1, 2) THEN DATE '2023-05-05' END AS first_public, CASE WHEN c_custkey % 4 = 2 THEN DATE '2024-01-31' END AS delisted_on, c_custkey % 4 = 3 AS pending FROM customer""")
def next_publication_state(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("url"))
    k, old = F.col("url") % 4, F.lit("2023-05-05").cast("date")
    none = F.lit(None).cast("date")
    held = c.where(k.isin(1, 2)).select("url", old.alias("first_public"), none.alias("known_day"), none.alias("delisted_on"))
    public = c.where(k.isin(0, 1)).select("url", F.when(k == 0, F.lit(TODAY).cast("date")).otherwise(old).alias("public_on"))
    seen = c.select("url", k.isin(0, 1).alias("visible")).where((F.col("url") % 4) != 2)
    return state.next_state(held, public, seen, F.lit(TODAY).cast("date")).select("url", "first_public", "delisted_on", "pending")


@query("""SELECT p_partkey AS url, CASE p_partkey % 3 WHEN 0 THEN '夏令營訓練班' ELSE 'listing' END AS title, CASE p_partkey % 3 WHEN 0 THEN 'corrected' WHEN 1 THEN 'reverted' END AS title_check FROM part""")
def title_corrections(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    rows = t.part.select(k.alias("url"), F.lit("listing").alias("title"))
    fixes = t.part.where("p_partkey % 3 < 2").select(k.alias("url"), F.lit("listing").alias("listing_title"), F.when(k % 3 == 0, "夏令營訓練班").otherwise("（一）日期：").alias("title"))
    return state.title_fixes(rows, fixes)


@query("""SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'activity:big-camp,c1' ELSE 'c1,category:training' END AS tags FROM orders""")
def category_topic_swap(t: Tables) -> DataFrame:
    k = F.col("o_orderkey") % 2
    kind = F.when(k == 0, F.struct(F.lit("activity").alias("id"), F.lit("big_camp").alias("subtype"))).otherwise(F.struct(F.lit("training").alias("id"), F.lit(None).cast("string").alias("subtype")))
    o = t.orders.select("o_orderkey", kind.alias("c"), F.array(F.lit("category:service"), F.lit("c1")).alias("tags"))
    return o.select("o_orderkey", F.array_join(state.with_category_topics(F.col("tags"), classify.category_topic(F.col("c"))), ",").alias("tags"))


@query("""SELECT 's' || o_custkey % 9 AS source_site, 'u' || o_orderkey AS pdf_url FROM orders WHERE o_orderkey % 2 = 0""")
def flattened_map(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    entry = F.struct(F.when(k % 4 == 0, F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string"))).otherwise(" ").alias("source_site"), F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).otherwise(" ").alias("pdf_url"), F.lit(None).cast("string").alias("url"))
    groups = t.orders.groupBy(F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string")).alias("s"), (F.col("o_custkey") % 64).alias("part")).agg(F.collect_list(entry).alias("rows"))
    return exploded_map(groups.select(F.create_map("s", "rows").alias("data"))).select("source_site", "pdf_url")


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_partkey % 10 < 6) AS junk FROM part GROUP BY p_brand HAVING count(*) FILTER (WHERE p_partkey % 10 < 6) > 0 AND (count(*) FILTER (WHERE p_partkey % 10 < 6) >= 0.5 * count(*) OR count(*) <= 3)""")
def junk_titles(t: Tables) -> DataFrame:
    title = F.when(F.col("p_partkey") % 10 < 6, "12").otherwise(F.col("p_name"))
    return reports.junk_report(t.part.select("p_brand", title.alias("title")), "p_brand", reports.is_junk(F.col("title")), "title").select("p_brand", "n", "junk")


NAMES = {"the": "a", "thea": "b", "and": "c", "anda": "d", "tion": "e", "on": "f"}


@query("""SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ',') AS found FROM (SELECT doc_id, regexp_extract_all(lower(text), '(anda|thea|tion|and|the|on)') AS w FROM documents)""")
def longest_match_order(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(classify.scan_longest(F.lower("text"), {k: k for k in NAMES}), ",").alias("found"))
