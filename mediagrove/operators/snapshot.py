"""A snapshot of observations that is read by place and by id without being scanned.

It is written twice: in listing order (root, path), with each row's place, and by id, in a folder for the first two digits of the id. Both are sorted, in small Parquet pages whose least and greatest
values say which can be skipped; ids have Bloom filters too, so an id that isn't there opens nothing. A page is a range of places; the page after a key starts at the place of that key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import numbered
from . import listing

PAGE_ROWS = 200


def _write(rows: DataFrame, path: str, *, bloom: str = "", by: str = "") -> None:
    out = rows.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.row.count.limit", 20 * PAGE_ROWS)
    if bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
    (out.partitionBy(by) if by else out).parquet(path)


def write(obs: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes a snapshot of observations (observation_id, root_id, path and others)."""
    placed = numbered(obs, "root_id", "path", parts=parts)
    _write(placed.sortWithinPartitions("pos"), f"{path}/listing")
    ids = obs.withColumn("p", F.substring("observation_id", 1, 2))
    _write(ids.repartition("p").sortWithinPartitions("p", "observation_id"), f"{path}/ids", bloom="observation_id", by="p")


def total(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/listing").count()


def lookup(spark: SparkSession, path: str, *ids: str) -> DataFrame:
    """The observations of some ids: one folder an id, in it the pages that may hold it."""
    rows = spark.read.parquet(f"{path}/ids").withColumn("p", F.col("p").cast("string"))
    return rows.where(F.col("p").isin(sorted({i[:2] for i in ids})) & F.col("observation_id").isin(*ids)).drop("p")


def lookup_all(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The observations of a table of ids (observation_id), however many."""
    return spark.read.parquet(f"{path}/ids").drop("p").join(ids.select("observation_id").distinct(), "observation_id", "left_semi")


def page(spark: SparkSession, path: str, number: int = 1, size: int = 50) -> DataFrame:
    """A page of the listing, with its places; pages and sizes below 1 as in ``listing.page``, a page past the end is empty."""
    number, size = listing.clamped(number, size)
    return _places(spark, path, (number - 1) * size, size)


def _places(spark: SparkSession, path: str, first: int, size: int) -> DataFrame:
    return spark.read.parquet(f"{path}/listing").where((F.col("pos") >= first) & (F.col("pos") < first + size)).orderBy("pos")


def after(spark: SparkSession, path: str, root_id: str, file: str, size: int = 50) -> DataFrame:
    """The page after a key, whether the snapshot has it or not: what a reader asks for who knows the last row that was shown."""
    _, size = listing.clamped(1, size)
    rows = spark.read.parquet(f"{path}/listing")
    same = rows.where((F.col("root_id") == root_id) & (F.col("path") <= file)).agg(F.max("pos").alias("pos"))  # the pages of this root up to the key
    last = same.first()["pos"]
    if last is None:
        first = rows.where(F.col("root_id") >= root_id).agg(F.min("pos")).first()[0]
        return _places(spark, path, first if first is not None else total(spark, path), size)
    return _places(spark, path, last + 1, size)
