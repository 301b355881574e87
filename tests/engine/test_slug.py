"""Slugs of texts that open with much that a slug drops."""

import random

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans import catalog


def test_slug_looks_past_a_long_run_of_symbols(spark: SparkSession, tmp_path):
    spark.createDataFrame([(1, "*" * 300 + " Summer camp\nmore"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.slug for r in catalog.QUERIES["nfkc_title"](spark, str(tmp_path)).collect()}
    assert found == {1: "summer-camp-more", 2: "notice"}


def test_slug_of_a_head_is_that_of_the_whole(spark: SparkSession):
    r = random.Random(5)
    pieces = ["a", "Ω", "ΟΔΟΣ", "é", "̈", "&amp;", "&eacute", "&#233;", "ﬁ", "​", "　", "\n", " ", "  ", "***", "營", "&", ";", "x_9", "ΣΣ"]
    texts = ["".join(r.choice(pieces) + r.choice(["", "", " "]) for _ in range(r.choice([5, 400, 1500]))) for _ in range(150)]
    texts += ["*" * 1023 + " b", "*" * 1030 + "b c", "x" * 3000, "- " * 2000 + "end", "", None, "Σ" * 79 + " Σ" * 900]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", text.slug(F.col("t")).alias("a"), text.slug_of(F.col("t")).alias("b"))
    assert [x.id for x in t.collect() if x.a != x.b] == []


def test_a_title_of_very_many_short_words(spark: SparkSession):
    t = spark.createDataFrame([("ab " * 20000 + "end",), ("TPN/CIR/VS/2627/003 露營訓練班",)], "t string").select(text.clean_title(F.col("t")).alias("title"))
    assert [len(x.title) for x in t.collect()] == [60003, 5]
