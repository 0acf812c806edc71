"""Total orders of tables of any size: place numbers and digests of the whole sequence, no task holding more than its own range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import cut, release

LEAF = 1000


def numbered(df: DataFrame, *keys: str, name: str = "pos", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row (from 0) in the order of ``keys``, nulls first; rows of equal keys in any order.

    Ranges of keys are sorted by a task each and written with the place in the range; the numbers of rows of the ranges before it (a row a range) are added to that.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = (1 << 33) - 1
    ranged = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id()))
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit(low))
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy(part.alias("part")).count().collect())  # a row a range
    before, rows = 0, []
    for k, n in sizes:
        rows.append((k, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(rows, "__part long, __before long"))
    return ranged.join(starts, part == F.col("__part"), "left").withColumn(name, F.col("__before") + place).drop("__m", "__part", "__before")


def ordered_digest(df: DataFrame, *keys: str, leaf: int = LEAF, parts: int | None = None) -> DataFrame:
    """(n, digest) of a table in the order of ``keys`` (which must tell its rows apart), the same however it is partitioned.

    Rows are digested by their columns in the table's order. Leaves of ``leaf`` neighbours are digested from their rows' digests, nodes of ``leaf`` leaves from theirs, until a node has the rest;
    the digest is that of the number of rows, ``:`` and the last nodes' digests.
    """
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns))
    level = numbered(df.select(*keys, F.sha2(text, 256).alias("__d")), *keys, name="__pos", parts=parts).select("__pos", "__d")
    n, made = None, None
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__d"))), lambda x: x["__d"]), "")
    while True:
        level, made = cut(level.groupBy(F.expr(f"__pos div {leaf}").alias("__at")).agg(F.sha2(joined, 256).alias("__d"), F.count(F.lit(1)).alias("n")).withColumnRenamed("__at", "__pos")), level
        n = level.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] if n is None else n
        release(made)
        if level.count() <= leaf:
            break
    return level.agg(F.lit(n).cast("long").alias("n"), F.sha2(F.concat(F.lit(f"{n}:"), joined), 256).alias("digest"))
