"""Views of observations that are kept up by changes, not computed again.

A change is a set of observations with a ``sign``: 1 for one that came, -1 for one that went; a file that changed is both. A view is a table of keys, their count ``n`` and sums, and what a change does to
it is again a table of keys and sums, so both are added. Counts that come to 0 are keys that are gone. What isn't a sum is read off one: the least and the
largest size of a root from the multiset of its sizes, the duplicate figures of a content from the multiset of its copies.

A view is written in partitions by the hash of its key. A change reads and writes the partitions of its own keys only. Each row says which change has written it, so a change
that is repeated after a failure, whole or in part, counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cuts import cut, release
from .inventory import GENERATED

PARTS = 64
_SUM = "decimal(38,0)"


@dataclass(frozen=True)
class View:
    """``keys`` and ``sums``: SQL expressions by name over the rows of a change. ``by``: the keys whose hash deals the rows (all, if none are named). ``child``: a view fed by this one,
    and the rows that some keys of this one stand for in it."""

    name: str
    keys: dict[str, str]
    sums: dict[str, str] = field(default_factory=dict)
    by: tuple[str, ...] = ()
    child: tuple[View, Callable[[DataFrame], DataFrame]] | None = None


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The change from one set of rows to another."""
    return before.exceptAll(after).withColumn("sign", F.lit(-1)).unionByName(after.exceptAll(before).withColumn("sign", F.lit(1)))


def _path(path: str, view: View) -> str:
    return f"{path.rstrip('/')}/{view.name}"


def _stored(spark: SparkSession, path: str, view: View) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(_path(path, view))
    return spark.read.parquet(_path(path, view)) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def read(spark: SparkSession, path: str, view: View) -> DataFrame:
    """The view as it stands: its keys, n and sums."""
    return _stored(spark, path, view).where("n != 0").select(*view.keys, "n", *view.sums)


def apply(path: str, view: View, number: int, changes: DataFrame, parts: int = PARTS) -> None:
    """Brings ``view``, and what it feeds, to change ``number``; changes come in the order of their numbers, the first one makes the view. ``parts`` is the view's own, from its first change on."""
    spark, keys, by = changes.sparkSession, list(view.keys), list(view.by or view.keys)
    own = changes.groupBy(*(F.expr(e).alias(k) for k, e in view.keys.items())).agg(F.sum("sign").cast("long").alias("n"), *(F.sum(F.expr(f"CAST(sign * ({e}) AS {_SUM})")).cast(_SUM).alias(s) for s, e in view.sums.items()))
    own = cut(own.withColumn("p", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int") if by else F.lit(0)))
    stored = _stored(spark, path, view)
    touched = [r["p"] for r in own.select("p").distinct().collect()]  # parts at most
    fresh, old = own, own.limit(0)
    if stored is not None:
        there = stored.where(F.col("p").isin(touched))
        again = [r["p"] for r in there.where(F.col("change") >= number).select("p").distinct().collect()]
        fresh, old = own.where(~F.col("p").isin(again)), there.where(~F.col("p").isin(again) & (F.col("n") != 0)).select(own.columns)
    new = cut(old.unionByName(fresh).groupBy(*keys, "p").agg(F.sum("n").alias("n"), *(F.sum(s).cast(_SUM).alias(s) for s in view.sums)).withColumn("change", F.lit(number).cast("long")))
    if view.child:
        child, rows_of = view.child
        mine = fresh.select(*by).distinct()
        went, came = rows_of(old.join(mine, by, "left_semi")), rows_of(new.where("n != 0").join(mine, by, "left_semi"))
        apply(path, child, number, went.withColumn("sign", F.lit(-1)).unionByName(came.withColumn("sign", F.lit(1))), parts=1)
    # last: where the work above is done again after a failure, it starts from the same old rows, and the child has seen the change
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p").parquet(_path(path, view))
    release(own, new)


# ---- the views of an inventory -------------------------------------------------------------------------------------
_MEDIA = "mime LIKE 'image/%' OR mime LIKE 'video/%' OR mime = 'application/pdf'"
_DIGEST = "md5(concat_ws('\\u0000', path, CAST(size AS STRING), sha256))"
#: Totals of a root, and two sums of 60-bit numbers of its files' digests: a fingerprint that files can be added to and taken from.
ROOTS = View("roots", {"root_id": "root_id"}, {"total_bytes": "size", "media_count": f"CAST({_MEDIA} AS INT)", "image_count": "CAST(mime LIKE 'image/%' AS INT)", "mark_a": f"CAST(conv(substring({_DIGEST}, 1, 15), 16, 10) AS BIGINT)", "mark_b": f"CAST(conv(substring({_DIGEST}, 16, 15), 16, 10) AS BIGINT)"})
SIZES = View("sizes", {"root_id": "root_id", "size": "size"})
HISTOGRAMS = {c: View(f"histogram_{c}", {"root_id": "root_id", "key": c}) for c in ("extension", "role", "dimensions")}
SUMMARY = View("duplicate_summary", {}, {"groups": "CAST(held > 1 AS INT)", "copies": "IF(held > 1, held, 0)", "excess_bytes": "IF(held > 1, (held - 1) * size, 0)", "cross_root_groups": "CAST(held > 1 AND roots > 1 AS INT)"})


def _contents(copies: DataFrame) -> DataFrame:
    """A row a content of the multiset of copies."""
    return copies.groupBy("sha256").agg(F.min("size").alias("size"), F.sum("n").alias("held"), F.count_distinct("root_id").alias("roots"))


COPIES = View("copies", {"sha256": "sha256", "size": "size", "root_id": "root_id", "generated": f"root_kind IN {GENERATED}"}, by=("sha256",), child=(SUMMARY, _contents))
VIEWS = (ROOTS, SIZES, *HISTOGRAMS.values(), COPIES)


def refresh(path: str, number: int, changes: DataFrame, views: tuple[View, ...] = VIEWS, parts: int = PARTS) -> None:
    """All views of an inventory brought to change ``number``: signed observations, read once for all."""
    changes = cut(changes)
    for view in views:
        apply(path, view, number, changes, parts)
    release(changes)


def root_summary(spark: SparkSession, path: str) -> DataFrame:
    """As ``inventory.root_summary``, with the fingerprint's sums and the least and largest size."""
    ends = read(spark, path, SIZES).groupBy("root_id").agg(F.min("size").alias("smallest"), F.max("size").alias("largest"))
    return read(spark, path, ROOTS).join(ends, "root_id").select("root_id", F.col("n").alias("file_count"), *(F.col(c).cast("long").alias(c) for c in ("total_bytes", "media_count", "image_count")), "smallest", "largest", "mark_a", "mark_b")


def histogram(spark: SparkSession, path: str, column: str) -> DataFrame:
    """As ``inventory.histogram``."""
    return read(spark, path, HISTOGRAMS[column]).where("key != ''")


def duplicate_summary(spark: SparkSession, path: str) -> DataFrame:
    """As ``inventory.duplicate_summary``; one row, whatever was taken away."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMMARY.sums]
    return read(spark, path, SUMMARY).agg(*sums, F.coalesce(F.sum("n"), F.lit(0)).alias("unique_hashes"))


def duplicate_view(spark: SparkSession, path: str) -> DataFrame:
    """As ``inventory.duplicate_view``: a row a content that several files hold, with its class."""
    per = read(spark, path, COPIES).groupBy("sha256").agg(F.min("size").alias("size"), F.sum("n").alias("copies"), F.bool_or("generated").alias("some"), F.bool_and("generated").alias("every")).where("copies > 1")
    label = F.when(F.col("some") & ~F.col("every"), "expected-copy").when(F.col("every"), "review").otherwise("canonical-opportunity")
    return per.select("sha256", "size", "copies", label.alias("classification"))
