"""Shared pieces of the text operators: Arrow row maps and tables in the cluster's shared folder.

Every operator selects the columns it needs by name first, so extra or clashing columns of its input cannot reach
it; the operators that hand their input's columns on (filters and rewrites) say so in their docstrings.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and Spark is local (tests) a temporary one of this process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="tidegraph-"))
    return _OWN_DIR[0]


def written(df: DataFrame, name: str, gathered: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    gathered: rows of a few bytes are dealt anew to as many files as their size asks for, in place of one a task.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if gathered else df
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings of the session for a while; queries that start inside take them over."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]], schema: str, rows: int = 1000
) -> DataFrame:
    """mapInArrow with a function made once a task by make(); what it returns or yields goes out.

    The function gets at most so many rows at once, so that a task's Python objects stay few whatever Arrow's batches hold.
    """

    def run(batches):
        f = make()
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), rows):
                out = f(batch.slice(at, rows))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def id_and_text(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
