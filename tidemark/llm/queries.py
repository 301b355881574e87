"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, language, lines, mixing, quality, scoring, sharding, simhash, suffixes, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.octet_length("kept_text").cast("long").alias("kept_bytes"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign(docs, 8, "doc_id", "shard", "grown_shard")
    return sharding.number(placed, "shard", "doc_id", ("size", "text_crc32")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = decontam.search(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate(names["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform(names["items"], lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col(names["n_words"]).alias("n_words"), hit.alias("n_hit"), F.size(names["items"]).cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_raw", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.cluster(docs)[0].select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scoring.score(docs, scoring.fit(docs), keep=["doc_id"])[0]


def op7_token_count(spark: SparkSession, sf_dir: str, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count(docs, tokens.pieces_of(vocabulary), keep=["doc_id"])


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    docs = docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    net = language.fit(docs.where(part != 2).select(F.col("doc_id").alias("key"), "text", "lang"))
    return language.predict(docs.drop("lang"), net, keep=["doc_id", "held_out"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, copy="copy", order="shuffle_key")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_sharding, op3_decontamination, op4_suffix_dedup, op5_simhash, op6_lm_scoring, op7_token_count, op8_language, op9_mixing, op10_quality)}

ORACLE_SQL = {
    "op1_line_dedup": """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, s, ls[s:s + 2] AS win FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS s FROM d)),
l AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS rn FROM w) WHERE rn > 1),
g AS (SELECT DISTINCT doc_id, unnest([s, s + 1, s + 2]) AS i FROM l),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE prev IS DISTINCT FROM i - 1) AS n_runs, list(i) AS gone FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM g) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ls) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, array_to_string(list_filter(ls, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), chr(10)) AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id)
SELECT doc_id, n_lines, n_removed, n_runs, CAST(strlen(kept) AS BIGINT) AS kept_bytes, sha256(kept) AS kept_sha256 FROM k""",
    "op2_sharding": """
WITH RECURSIVE bits AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(0, 256) AS t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END AS c, k + 1 AS k FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, octet_length(b) + 1 AS size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i:i]))::UBIGINT)), lambda c, x: xor(c // 256, t[(xor(c % 256, x) % 256)::BIGINT + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM d, crc),
j AS (SELECT doc_id, n, doc_id::HUGEINT AS key, -1::BIGINT AS b, 0::BIGINT AS ahead FROM documents, (SELECT unnest([8, 9]) AS n)
UNION ALL SELECT doc_id, n, k AS key, ahead AS b, CAST(floor((ahead + 1) * (2147483648.0::DOUBLE / ((k // 8589934592::HUGEINT) + 1)::DOUBLE)) AS BIGINT) AS ahead FROM (SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k FROM j WHERE ahead < n)),
p AS (SELECT doc_id, CAST(max(b) FILTER (WHERE n = 8) AS INTEGER) AS shard, CAST(max(b) FILTER (WHERE n = 9) AS INTEGER) AS grown_shard FROM j WHERE ahead >= n GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), size, text_crc32) - 1 AS slot, grown_shard FROM s JOIN p USING (doc_id)""",
    "op3_decontamination": r"""
WITH f AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[s:s + least(10, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, w[s:s + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM f, sizes)),
m AS (SELECT doc_id, dw.n AS n, s, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM f LEFT JOIN h ON f.doc_id = h.doc_id LEFT JOIN t ON f.doc_id = t.doc_id""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, md5(b[s + 1:s + 200]) AS k FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
p AS (SELECT doc_id, s FROM w WHERE k IN (SELECT k FROM r)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM p)),
g AS (SELECT doc_id, run, min(s) AS a, max(s) + 200 AS b FROM i GROUP BY doc_id, run),
e AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, list_concat([0], list(b ORDER BY a)) AS froms, list(a ORDER BY a) AS tos FROM g GROUP BY doc_id),
k AS (SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
CASE WHEN froms IS NULL THEN hex(b) ELSE array_to_string(list_transform(range(1, len(froms) + 1), lambda j: CASE WHEN froms[j] < coalesce(tos[j], octet_length(b)) THEN hex(b[froms[j] + 1:coalesce(tos[j], octet_length(b))]) ELSE '' END), '') END AS kept FROM d LEFT JOIN e ON d.doc_id = e.doc_id)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k""",
    "op9_mixing": """
WITH n AS (SELECT source, count(*) AS rows FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM n)::DOUBLE / rows::DOUBLE AS rate FROM n),
u AS (SELECT doc_id, d.source AS source, text, rate, (CAST(('0x' || substr(md5('mix:0:' || doc_id), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
p AS (SELECT doc_id, source, text, u, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS chance FROM u, (SELECT unnest(range(0, 60)) AS k)),
c AS (SELECT doc_id, source, text, count(*) FILTER (WHERE total < u) AS copies FROM (SELECT *, sum(chance) OVER (PARTITION BY doc_id ORDER BY k) AS total FROM p) GROUP BY doc_id, source, text)
SELECT doc_id, source, text, copy, md5('mix:order:' || doc_id || ':' || copy) AS shuffle_key FROM (SELECT doc_id, source, text, unnest(range(1, copies + 1)) AS copy FROM c)""",
}
