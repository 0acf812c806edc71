"""Durable cuts in the lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a folder of this machine only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession) -> str:
    """A folder of the shared checkpoint folder that nobody uses; what is there when the driver ends is deleted."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back: executors may be lost afterwards."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def together(spark: SparkSession, *jobs) -> list:
    """The results of several functions that start jobs, run at the same time; the first failure is raised."""
    work = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(work, jobs))


def from_files(df: DataFrame) -> bool:
    """Whether ``df`` comes straight from files: reading it again gives the same rows in the same partitions."""
    nodes = re.findall(r"^[\s:+-]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString(), re.M)
    return set(nodes) <= {"Project", "Filter", "Relation"}


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of very few input splits over all cores; larger inputs keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if from_files(df) and df.rdd.getNumPartitions() * 2 <= cores else df


def release(*dfs: DataFrame | None) -> None:
    """Deletes cuts that no frame still in use reads; frames that aren't cuts stay as they are."""
    for df in dfs:
        path = getattr(df, "_cut_path", None)
        if path in _MADE:
            _delete(path, _MADE.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    while _MADE:
        path, spark = _MADE.popitem()
        try:
            _delete(path, spark)
        except Exception:  # noqa: BLE001  the session may be gone, and its folders with it
            return
