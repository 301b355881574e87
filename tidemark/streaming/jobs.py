"""The batch rules on streams: late duplicates, daily counters, deliveries, publication days."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rows import append_once

LATE = "7 days"


def first_in_window(rows: DataFrame, keys: list[str], ts: str, late: str = LATE) -> DataFrame:
    """One row a key among those that come within the watermark: state is dropped once it has passed."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def daily_counts(events: DataFrame, ts: str, event: str, late: str = LATE) -> DataFrame:
    """(day, event, count) of tumbling days, final once the watermark has passed a day."""
    day = F.window(ts, "1 day")
    return events.withWatermark(ts, late).groupBy(day, event).agg(F.count("*").alias("count")).select(F.to_date("window.start").alias("day"), event, "count")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deliver_once(rows: DataFrame, table: str, keys: list[str], checkpoint: str, send: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Each key is sent and recorded at most once a batch, and never again after it was recorded: at least once over failures."""
    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            there = spark.read.schema(df.schema).parquet(table)
            new = append_once(there, df, keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            new = df.dropDuplicates(keys)
        new = new.persist()
        try:
            if send:
                send(new)
            new.write.mode("append").parquet(table)
        finally:
            new.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publication_stream(observations: DataFrame) -> DataFrame:
    """(url, public_on) whenever a row becomes public: first seen visible, or visible again after it was gone.

    ``observations``: url, observed_on (date), visible. State of a url: its public day, whether it is visible now and the last day
    it was looked at; it is as large as the published table itself and has to last as long. A row that comes after a later one
    of its url is left out, since what followed it is published.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, shown, last = state.get if state.exists else (None, False, "")
        rows = pd.concat(list(batches)).sort_values("observed_on")
        out = []
        for seen, visible in zip(rows["observed_on"], rows["visible"], strict=True):
            if str(seen)[:10] < last:
                continue
            if visible and not shown:
                day = str(seen)[:10]
                out.append((key[0], seen))
            shown, last = bool(visible), str(seen)[:10]
        state.update((day, shown, last))
        yield pd.DataFrame(out, columns=["url", "public_on"])

    return observations.groupBy("url").applyInPandasWithState(step, "url string, public_on date", "day string, shown boolean, last string", "append", GroupStateTimeout.NoTimeout)


def publication_batch(observations: DataFrame) -> DataFrame:
    """The same over a whole table, by a window."""
    before = F.lag("visible", 1, False).over(Window.partitionBy("url").orderBy("observed_on"))
    return observations.withColumn("_before", before).where("visible AND NOT _before").select("url", F.col("observed_on").alias("public_on"))
