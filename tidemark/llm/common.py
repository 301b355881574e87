"""Helpers shared by the operators: sessions, shared folders, Arrow slices, free column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A worker turns at most this many bytes of text into Python objects at a time (or one row, if that is longer).
SLICE_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where none is set, a local session makes one and any other raises."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, what: str = "cut") -> DataFrame:
    """The same rows as a Parquet table in the shared folder: lineage ends there, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made, once nothing that is still to run reads them."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame | Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores put before it until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hashable(df: DataFrame) -> list[Column]:
    """The columns in a form that Spark can hash: those that hold a map as JSON."""
    holds_map = lambda kind: '"map"' in kind.json()
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if holds_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema]


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of the batches with the values of a string or binary column: bounded Python memory whatever the batch size."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        n, start = batch.num_rows, 0
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(at)).to_pylist()]
        while start < n:
            end, held = start, 0
            while end < n and (end == start or held + sizes[end] <= most):
                held += sizes[end]
                end += 1
            part = batch.slice(start, end - start)
            yield part, part.column(at).to_pylist()
            start = end
