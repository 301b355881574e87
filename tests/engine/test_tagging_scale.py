"""Tags of many notices: nothing that has a row for each notice may be broadcast."""

import re
from collections import Counter

from tidemark.operators import tagging
from tidemark.plans import cases

FIELDS = "notice_key long, title string, text string, audience string, hint string, source string"


def test_no_notices_are_broadcast(spark, sf):
    plan = cases.notice_tags(spark, sf)._jdf.queryExecution().executedPlan().toString()
    joins = Counter(re.findall(r"\w*Join\b", plan))
    # The topic list goes to every task: its starts, names, sections and one-row summary. Notices meet notices once, by a sort.
    assert joins == {"BroadcastHashJoin": 2, "BroadcastNestedLoopJoin": 2, "SortMergeJoin": 1} and plan.count("FileScan parquet") == 2, joins


def test_tag_evidence(spark):
    topics = spark.createDataFrame(cases.TOPICS + [("t5", "技能班", "training", ["童軍"], ["技能班"], [], "別的", None)], cases.TOPIC_FIELDS)
    rows = spark.createDataFrame([(1, "童軍露營訓練班", "", "", "", "s"), (2, "木章課程", "", "領袖", "", "s"), (3, "童軍技能班訓練班", "", "", "", "s"), (4, "皮革藝術", "", "", "", "s")], FIELDS)
    got = {r.notice_key: r for r in tagging.tagged(rows, topics, cases.SECTIONS).collect()}
    tags = lambda k: {x.topic_id: x.evidence for x in got[k].tag_evidence or []}
    assert tags(1) == {"c1": ["露營訓練班"], "category:training": ["訓練班"], "t1": ["童軍"], "t2": ["技能"]}
    assert set(tags(2)) == {"category:training", "t3", "t4"} and tags(2)["t3"] == ["木章"]
    assert tags(3) == {"category:training": ["訓練班"], "t1": ["童軍"], "t2": ["童軍"], "t5": ["技能班"]}
    assert got[4].tag_evidence is None and got[4].subscription_tags == []
