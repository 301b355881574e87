"""Sources that are tiny beside the others."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import mixing


def test_a_single_row_of_a_source_is_repeated_as_often_as_its_share_asks(spark):
    n = 60_000
    df = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n - 1, "big").alias("source"))
    out = mixing.mix(df, copy="nth", order="place")
    nth = sorted(r.nth for r in out.where("source IS NULL").select("nth").collect())
    mean = n / 2
    parts = int(np.ceil(mean / mixing.PART))
    u = np.array([mixing.uniform(str(n - 1), p) for p in range(parts)])
    assert nth == list(range(1, 1 + int(mixing.inverse_poisson(u, np.full(parts, mean / parts)).sum())))
    assert abs(len(nth) - mean) < 6 * mean**0.5
    assert Counter(r["count"] for r in out.groupBy("place").count().select("count").collect()).keys() == {1}
