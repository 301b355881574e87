"""Readers of landed tables: snapshots, fingerprints, REST pages, databases."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.rows import exploded_map
from .sinks import folder

NOTICE = "source_site string, region string, title string, url string, pdf_url string, date string, captured_date string, published_date string, backfilled_at string, suppress_notifications boolean, tags array<string>"
ROW = f"struct<{', '.join(':'.join(f.split(' ')) for f in NOTICE.split(', '))}>"
CACHE = f"last_updated string, data map<string,array<{ROW}>>, notices array<{ROW}>"


def exists(spark: SparkSession, path: str) -> bool:
    """Through the file system that Spark itself uses for the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document by an explicit schema; a missing or corrupt one gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def notices(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a snapshot document: the grouped ones if there are any, else the flat ones; never both."""
    doc = json_or_empty(spark, path, CACHE)
    grouped = doc.where(F.coalesce(F.size("data"), F.lit(0)) > 0)
    flat = doc.where(F.coalesce(F.size("data"), F.lit(0)) <= 0).select(F.explode("notices").alias("r")).select("r.*")
    return exploded_map(grouped).select(*flat.columns).unionByName(flat)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(source, fingerprint) of a document that maps one to the other."""
    if not exists(spark, path):
        return spark.createDataFrame([], "source string, fingerprint string")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "fingerprint"))


def previous(spark: SparkSession, root: str, version: int, name: str = "notices") -> DataFrame | None:
    """A table of an earlier version; None if there is none, and then nothing may be sent."""
    if version <= 0 or not exists(spark, f"{root}/_published/{version}"):
        return None
    return spark.read.parquet(f"{folder(spark, root, version)}/{name}")


def database(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table; filters and columns are pushed down, and a numeric key splits the scan. Needs the database's driver."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", "1000").options(**options)
    if key and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [Page(i + 1) for i in range(int(self.options.get("pages", 10)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url = self.options["url"].replace("{page}", str(partition.value)).replace("{size}", self.options.get("size", "100"))
        for attempt in range(int(self.options.get("tries", 3))):
            try:
                with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 20))) as answer:
                    rows = json.load(answer)
                break
            except urllib.error.HTTPError as e:
                if e.code in (400, 404) and partition.value > 1:  # beyond the last page
                    return
                time.sleep(2**attempt)
            except (OSError, ValueError):
                time.sleep(2**attempt)
        else:
            raise OSError(f"no answer from {url}")
        for row in rows if isinstance(rows, list) else rows.get("items", []):
            yield tuple(row.get(f.name) if not isinstance(row.get(f.name), (dict, list)) else json.dumps(row[f.name]) for f in self.schema.fields)


class PagedJson(DataSource):
    """``spark.read.format("paged_json")``: a REST list page by page, a task for each page. Options: url with {page} and {size}, pages, size, tries, timeout."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "id long, title string, link string, date string"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, dict(self.options))


def funnel_days(counters: DataFrame, today: date, days: int) -> DataFrame:
    """Counters of the last ``days`` days; the filter reaches the source."""
    return counters.where(F.col("day") >= F.date_sub(F.lit(today), days - 1))
