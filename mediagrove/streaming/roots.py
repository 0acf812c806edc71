"""Scans of many roots as one stateful stream: a state by root, fenced by generation, with timers for roots that fall silent.

A scan is a stream of messages: ``queued`` (a root is due), ``resumed`` (due again, its counts still hold), ``file`` and ``gone`` (an entry came or went), ``failed``, ``done``. Every scan has a
generation, handed out by ``begin``: a file that only one caller can create, so two drivers never share one. A root's state holds its
newest generation; messages of older ones change nothing, whenever they come. Tasks add up their messages by root first, so a root with
a third of all files sends a row a task to its state.

States live in Spark's state store and survive a restart with the checkpoint; each batch also writes the table of all roots as a new version (a repeated batch writes the same one again),
so readers see whole versions only.
"""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

MESSAGES = "generation long, root_id string, kind string, path string, size long, at timestamp"
STATES = "root_id string, generation long, status string, files long, bytes long"
#: What a root's message of the same generation means for its status, the later one in this order wins.
STATUS = {"queued": "queued", "resumed": "queued", "gone": "scanning", "file": "scanning", "failed": "error", "done": "complete"}
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- generations ---------------------------------------------------------------------------------------------------
def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the entries ``name``=number of a folder, ascending."""
    fs, where = _folder(spark, path)
    found = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(x.partition("=")[2]) for x in found if x.startswith(f"{name}="))


def newest(spark: SparkSession, path: str) -> int:
    """The generation handed out last; 0 before the first."""
    return max(numbers(spark, f"{path}/generations", "generation"), default=0)


def _claim(spark: SparkSession, folder: str, name: str) -> bool:
    """Creates a file that isn't there; False if it is, or another caller was first."""
    fs, where = _folder(spark, folder)
    fs.mkdirs(where)
    if fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            os.close(os.open(os.path.join(where.toUri().getPath(), name), os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False
    try:
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(where, name), False).close()
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def begin(spark: SparkSession, path: str) -> int:
    """A new generation. Of callers that see the same newest one a single one creates the next; the others see that and go on."""
    while True:
        number = newest(spark, path) + 1
        if _claim(spark, f"{path}/generations", f"generation={number}"):
            return number


# ---- the stream ----------------------------------------------------------------------------------------------------
def _combined(messages: DataFrame) -> DataFrame:
    """(generation, root_id, kind, n, bytes, at) of each task's messages, added up over a batch of rows."""

    def run(batches):
        for batch in batches:
            t = pa.table({c: batch.column(c) for c in ("generation", "root_id", "kind", "size", "at")})
            sign = pc.if_else(pc.equal(t["kind"], "gone"), -1, pc.if_else(pc.equal(t["kind"], "file"), 1, 0))
            t = t.append_column("n", sign.cast(pa.int64())).append_column("bytes", pc.multiply(pc.coalesce(t["size"], 0), sign).cast(pa.int64()))
            out = t.group_by(["generation", "root_id", "kind"]).aggregate([("n", "sum"), ("bytes", "sum"), ("at", "max")])
            yield from out.select(["generation", "root_id", "kind", "n_sum", "bytes_sum", "at_max"]).rename_columns(["generation", "root_id", "kind", "n", "bytes", "at"]).combine_chunks().to_batches()

    return messages.where("root_id is not null and generation is not null").mapInArrow(run, "generation long, root_id string, kind string, n long, bytes long, at timestamp")


class RootProcessor(StatefulProcessor):
    """One root: (generation, status, files, bytes, last sign of life in ms)."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("root", "generation long, status string, files long, bytes long, at long")

    def _row(self, key, generation, status, files, size):
        import pandas as pd

        hidden = status == "error"  # a root that failed contributes nothing
        return pd.DataFrame({"root_id": [key[0]], "generation": [generation], "status": [status], "files": [0 if hidden else files], "bytes": [0 if hidden else size]})

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        generation, status, files, size, last = self.state.get() if self.state.exists() else (-1, "", 0, 0, 0)
        every = pd.concat(list(rows))
        rank = {k: i for i, k in enumerate(STATUS)}
        every = every[every["kind"].isin(list(rank))].assign(rank=lambda d: d["kind"].map(rank)).sort_values(["generation", "rank"])
        changed = False
        for r in every.itertuples():
            if r.generation < generation:
                continue  # a scan that a newer one has replaced
            if r.generation > generation:
                generation, status = int(r.generation), "queued"
                if r.kind != "resumed":
                    files, size = 0, 0
            files, size, last, changed = files + int(r.n), size + int(r.bytes), max(last, int(r.ms)), True
            if status not in ("complete", "error"):
                status = STATUS[r.kind]
        if changed:
            self.state.update((generation, status, files, size, last))
            due = max(last + self.patience, timerValues.getCurrentWatermarkInMs() + 1)
            self._timer(due if status in ("queued", "scanning") else None)
            yield self._row(key, generation, status, files, size)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        generation, status, files, size, last = self.state.get()
        if status in ("queued", "scanning") and last + self.patience <= timerValues.getCurrentWatermarkInMs():
            self.state.update((generation, "stalled", files, size, last))
            yield self._row(key, generation, "stalled", files, size)

    def close(self) -> None:
        pass


def states_of(messages: DataFrame, patience: int = 1800) -> DataFrame:
    """The changed states of roots, batch by batch. A root without a message for ``patience`` seconds of the messages' own time is stalled, until its next message."""
    # the watermark drives the timers only: rows carry their time as a number, so none is dropped for being late
    every = _combined(messages).withWatermark("at", "0 seconds").select("generation", "root_id", "kind", "n", "bytes", F.unix_millis("at").alias("ms"))
    return every.groupBy("root_id").transformWithStateInPandas(RootProcessor(patience * 1000), outputStructType=STATES, outputMode="Update", timeMode="EventTime")


def run(messages: DataFrame, path: str, patience: int = 1800) -> StreamingQuery:
    """Brings the table of states under ``path`` up to date with the stream, from where its checkpoint stands."""
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)

    def put(changed: DataFrame, batch: int) -> None:
        own, known = changed.sparkSession, [n for n in numbers(spark, f"{path}/states", "version") if n < batch]
        whole = changed
        if known:
            before = own.read.schema(STATES).parquet(f"{path}/states/version={known[-1]}")
            whole = before.join(changed.select("root_id"), "root_id", "left_anti").unionByName(changed)
        whole.write.mode("overwrite").parquet(f"{path}/states/version={batch}")
        for old in known[:-1]:
            fs, where = _folder(own, f"{path}/states/version={old}")
            fs.delete(where, True)

    query = states_of(messages, patience).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# ---- reading -------------------------------------------------------------------------------------------------------
def states(spark: SparkSession, path: str) -> DataFrame:
    """The roots of the newest generation: root_id, generation, status (queued, scanning, complete, error, stalled), files, bytes. Roots that only older scans knew are left out."""
    versions = numbers(spark, f"{path}/states", "version")
    rows = spark.read.schema(STATES).parquet(f"{path}/states/version={versions[-1]}") if versions else spark.createDataFrame([], STATES)
    return rows.where(F.col("generation") == newest(spark, path))


def progress(states: DataFrame) -> DataFrame:
    """One row: status of the scan (idle without roots, scanning, complete), completed, total, items and bytes of the roots that finished well."""
    over, good = F.col("status").isin("complete", "error"), F.col("status") == "complete"
    total, completed = F.count(F.lit(1)), F.count_if(over)
    return states.agg(
        F.when(total == 0, "idle").when(completed < total, "scanning").otherwise("complete").alias("status"), completed.alias("completed"), total.alias("total"),
        F.coalesce(F.sum(F.when(good, F.col("files"))), F.lit(0)).alias("items"), F.coalesce(F.sum(F.when(good, F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def visible(observations: DataFrame, states: DataFrame) -> DataFrame:
    """The observations of the roots that are complete: what a reader sees while others are still being scanned, or have failed."""
    return observations.join(states.where("status = 'complete'").select("root_id"), "root_id", "left_semi")
