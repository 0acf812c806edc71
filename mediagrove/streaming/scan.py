"""Running totals of file facts as Structured Streaming: each batch updates the summaries of its roots.

Counts are kept by the stream's state (complete mode). Each scan is a generation: its batches are written to folders of its own, and
readers take the last batch of the newest generation, so a stale scan overwrites nothing, in any driver. ``roots`` hands generations out and keeps states of roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .roots import numbers


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 1, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def summaries(facts: DataFrame) -> DataFrame:
    """Running totals by root."""
    return facts.groupBy("root_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"))


def run_versions(frame: DataFrame, path: str, generation: int, checkpoint: str) -> StreamingQuery:
    """Runs ``frame`` to its end and writes the totals after each batch as a version. A batch that is repeated writes the same folder again."""

    def put(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path.rstrip('/')}/generation={generation}/batch={batch}")

    query = frame.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest generation's last batch; only these are read."""
    newest = f"{path.rstrip('/')}/generation={numbers(spark, path, 'generation')[-1]}"
    return spark.read.parquet(f"{newest}/batch={numbers(spark, newest, 'batch')[-1]}")
