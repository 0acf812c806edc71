"""File trees compared by digests of their ranges, from the root down: only ranges that differ are read.

The paths of a tree are dealt by their hash to 16^depth leaves (a folder a leaf). A node of the digest tree is a prefix of leaf names with the number of files
below it and two sums of numbers drawn from their digests, so children combine by adding, in any order, and files can be added and taken without their
neighbours. Two trees are compared level by level: below nodes that agree nothing is looked at. A depth of 4 deals 10 thousand million files into
leaves of some 150,000.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cuts import cut, release
from . import parity

DEPTH = 2
_SUMS = ("n", "mark_a", "mark_b")
_NUMBER = "CAST(CAST(conv(substring(d, {}, 15), 16, 10) AS BIGINT) AS DECIMAL(38,0))"


def _leaf(depth: int):
    return F.substring(F.md5("path"), 1, depth)


def _leaves(files: DataFrame, depth: int) -> DataFrame:
    """(leaf, n, mark_a, mark_b) of rows (path, sha256, sign)."""
    rows = files.select(_leaf(depth).alias("leaf"), "sign", F.md5(F.concat_ws("\u0000", "path", "sha256")).alias("d"))
    marks = [F.sum(F.expr(f"sign * {_NUMBER.format(a)}")).cast("decimal(38,0)").alias(c) for a, c in ((1, "mark_a"), (16, "mark_b"))]
    return rows.groupBy("leaf").agg(F.sum("sign").cast("long").alias("n"), *marks)


def _levels(leaves: DataFrame, depth: int) -> DataFrame:
    """(level, node, n, mark_a, mark_b) of all levels, each made from the one below; the root is the node ''."""
    add = [F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in _SUMS]
    level = leaves.withColumnRenamed("leaf", "node")
    every = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("node", 1, k).alias("node")).agg(*add)
        every = every.unionByName(level.withColumn("level", F.lit(k)))
    return every.select("level", "node", *_SUMS)


def write(files: DataFrame, path: str, depth: int = DEPTH) -> None:
    """Writes a tree of files (path, sha256 and other columns; each path once) with its digests. A leaf's files lie in one folder, written by one task."""
    files.withColumn("leaf", _leaf(depth)).repartition("leaf").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/files")
    made = cut(_leaves(files.withColumn("sign", F.lit(1)), depth))
    _levels(made, depth).write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")
    release(made)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("node string, n long, mark_a decimal(38,0), mark_b decimal(38,0), level int").parquet(f"{path}/nodes")


def files(spark: SparkSession, path: str, leaves: list[str] | None = None) -> DataFrame:
    """The files of a tree, or of some of its leaves: other folders aren't opened."""
    every = spark.read.option("basePath", f"{path}/files").parquet(f"{path}/files")
    every = every.withColumn("leaf", F.col("leaf").cast("string"))
    return every if leaves is None else every.where(F.col("leaf").isin(leaves))


def depth_of(spark: SparkSession, path: str) -> int:
    return nodes(spark, path).agg(F.max("level")).first()[0]


def differing(spark: SparkSession, one: str, two: str) -> list[str]:
    """The leaves in which two trees of one depth differ; 16^depth names at most."""
    depth = depth_of(spark, one)
    if depth != depth_of(spark, two):
        raise ValueError("trees of different depths can't be compared")
    found = [""]
    for level in range(depth + 1):
        # the children of what differs above, in both trees
        near = lambda p: nodes(spark, p).where((F.col("level") == level) & F.substring("node", 1, level - 1).isin(found) if level else F.col("level") == 0).select("node", *_SUMS)  # noqa: B023, E731
        other = near(two).select("node", *(F.col(c).alias(f"{c}_2") for c in _SUMS))
        same = [F.coalesce(F.col(c), F.lit(0)) == F.coalesce(F.col(f"{c}_2"), F.lit(0)) for c in _SUMS]
        found = [r["node"] for r in near(one).join(other, "node", "full_outer").where(~(same[0] & same[1] & same[2])).select("node").collect()]
        if not found:
            return []
    return sorted(found)


def compare(spark: SparkSession, source: str, target: str) -> DataFrame:
    """As ``parity.compare`` of the two trees' files: those in leaves that agree match, without a look at the target."""
    leaves = differing(spark, source, target)
    own = files(spark, source)
    equal = own.where(~F.col("leaf").isin(leaves)) if leaves else own
    out = equal.withColumns({"previous": F.col("sha256"), "status": F.lit("matching")})
    if leaves:
        out = out.unionByName(parity.compare(files(spark, source, leaves), files(spark, target, leaves).select("path", "sha256")))
    return out.drop("leaf")


def update(spark: SparkSession, path: str, gone: DataFrame, came: DataFrame) -> None:
    """Takes files (path, sha256) from a tree and adds others (all columns): their leaves are written again, and the digests get what changed added or taken.

    ``gone`` must be what the tree holds. A failed update is made good by writing the leaves' digests anew: ``repair``.
    """
    depth, columns = depth_of(spark, path), [c for c in files(spark, path).columns if c != "leaf"]
    signed = gone.select("path", "sha256", F.lit(-1).alias("sign")).unionByName(came.select("path", "sha256", F.lit(1).alias("sign")))
    change = cut(_leaves(signed, depth))
    leaves = [r["leaf"] for r in change.select("leaf").collect()]
    left = files(spark, path, leaves).join(gone.select("path"), "path", "left_anti").select(*columns, "leaf")
    new = cut(left.unionByName(came.select(columns).withColumn("leaf", _leaf(depth))))
    empty = change.join(new.select("leaf").distinct(), "leaf", "left_anti").select("leaf").collect()
    new.repartition("leaf").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("leaf").parquet(f"{path}/files")
    for r in empty:  # a folder that has lost all its files isn't overwritten
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/files/leaf={r['leaf']}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    add = [F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in _SUMS]
    every = cut(nodes(spark, path).select("level", "node", *_SUMS).unionByName(_levels(change, depth)).groupBy("level", "node").agg(*add).where("n != 0 or level = 0"))
    every.write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")
    release(change, new, every)


def repair(spark: SparkSession, path: str) -> None:
    """The digests made anew from the files."""
    depth = depth_of(spark, path)
    made = cut(_levels(cut(_leaves(files(spark, path).withColumn("sign", F.lit(1)), depth)), depth))
    made.write.mode("overwrite").partitionBy("level").parquet(f"{path}/nodes")
    release(made)
