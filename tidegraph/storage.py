"""Tables in the cluster's shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

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


def removed(df: DataFrame, name: str) -> None:
    """Deletes the tables that written made under a name and that df reads; nothing else is touched."""
    spark = df.sparkSession
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    base = to_path(shared_dir(spark)).toUri().getPath()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = to_path(folder)
        if path.getParent().toUri().getPath() == base and path.getName().startswith(f"{name}-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
