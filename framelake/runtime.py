"""Session helpers: table access and fault-tolerant materialisation.

Intermediate results that are read more than once are written as Parquet into
the folder that the cluster names in ``spark.checkpoint.dir`` (shared by all
executors, so they outlive any executor) and read back.  A written table is
smaller than an RDD checkpoint, keeps column pruning, and cuts the lineage.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_created: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; a fresh local one only in local mode, where it is shared by all tasks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.sparkContext.setCheckpointDir(where)
        _created.append(where)
    return where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame reading it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/framelake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _created.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, per_core: int = 3) -> DataFrame:
    """Hash ``df`` by ``key`` over the cluster's cores before work that is heavy per row.

    Input splits follow bytes; texts cost far more CPU than reading them.  With
    more input than that many splits the input's own partitioning is kept.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, key)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far, in any file system; their DataFrames cannot be read afterwards."""
    jvm = spark.sparkContext._jvm
    for path in reversed(_created):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _created.clear()


@atexit.register
def _clean() -> None:
    for path in reversed(_created):
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
