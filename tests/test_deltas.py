"""Views kept up by changes, and trees compared by digests, against computing everything again."""

import pytest
from pyspark.sql import functions as F

from mediagrove.functions.cuts import cut
from mediagrove.operators import deltas, hash_tree, inventory, parity
from mediagrove.plans import queries as Q

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def obs(spark):
    return cut(Q._obs(spark, SF).select("seq", "root_id", "root_kind", "path", "size", "sha256", "mime", "extension", "role", "dimensions").coalesce(1))


def test_ten_changes_are_as_good_as_computing_again(spark, obs, tmp_path):
    path, now = str(tmp_path), obs.limit(0)
    every = (deltas.ROOTS, deltas.COPIES)
    for number in range(1, 11):
        before = now
        came = obs.where(F.col("seq") % 10 == number - 1)
        gone = now.where(F.col("seq") % 7 == number % 7)
        edited = gone.where("seq % 2 = 0").withColumns({"size": F.col("size") + number, "sha256": F.when(F.col("seq") % 3 == 0, "same").otherwise(F.col("sha256"))})
        now = cut(now.exceptAll(gone).unionByName(came).unionByName(edited).coalesce(1))
        change = cut(deltas.difference(before, now).coalesce(1))
        deltas.refresh(path, number, change, every, parts=2)
        if number in (4, 10):
            deltas.refresh(path, number, change, every, parts=2)  # repeated after a failure: counts once
            got = deltas.read(spark, path, deltas.ROOTS).select("root_id", F.col("n").alias("file_count"), *(F.col(c).cast("long").alias(c) for c in ("total_bytes", "media_count", "image_count")))
            assert rows(got) == rows(inventory.root_summary(now))
            assert rows(deltas.duplicate_summary(spark, path)) == rows(inventory.duplicate_summary(now))
            assert rows(deltas.duplicate_view(spark, path)) == rows(inventory.duplicate_view(now))
    deltas.refresh(path, 11, now.withColumn("sign", F.lit(-1)), every, parts=2)
    assert deltas.read(spark, path, deltas.ROOTS).count() == 0 and deltas.duplicate_view(spark, path).count() == 0
    assert deltas.duplicate_summary(spark, path).first() == inventory.duplicate_summary(now.limit(0)).first()


def test_sizes_and_histograms_go_down_again(spark, obs, tmp_path):
    path, views = str(tmp_path), (deltas.ROOTS, deltas.SIZES, deltas.HISTOGRAMS["role"])
    largest = obs.groupBy("root_id").agg(F.max("size").alias("size"))
    gone = obs.join(largest, ["root_id", "size"], "left_semi").select(obs.columns)
    now = cut(obs.exceptAll(gone).coalesce(1))
    for number, change in ((1, obs.withColumn("sign", F.lit(1))), (2, cut(gone.withColumn("sign", F.lit(-1)).coalesce(1)))):
        deltas.refresh(path, number, change, views, parts=2)
    assert rows(deltas.root_summary(spark, path).select("root_id", "smallest", "largest")) == rows(now.groupBy("root_id").agg(F.min("size").alias("smallest"), F.max("size").alias("largest")))
    assert rows(deltas.root_summary(spark, path).drop("mark_a", "mark_b", "smallest", "largest")) == rows(inventory.root_summary(now))
    assert rows(deltas.histogram(spark, path, "role")) == rows(inventory.histogram(now, "role"))


def test_a_change_touches_its_own_partitions(spark, tmp_path):
    path = str(tmp_path)
    rows_ = spark.range(5000).select(F.lit("r").alias("root_id"), F.lit("romm").alias("root_kind"), F.col("id").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit(1).alias("sign")).coalesce(1)
    deltas.apply(path, deltas.COPIES, 1, rows_, parts=20)
    written = {r["f"] for r in spark.read.parquet(f"{path}/copies").select(F.input_file_name().alias("f")).distinct().collect()}
    deltas.apply(path, deltas.COPIES, 2, rows_.where("size in (7, 8)"), parts=20)
    now = {r["f"] for r in spark.read.parquet(f"{path}/copies").select(F.input_file_name().alias("f")).distinct().collect()}
    assert 1 <= len(written - now) <= 2  # of 20 partitions the two of the change are written anew
    assert deltas.duplicate_summary(spark, path).first().asDict() == {"groups": 2, "copies": 4, "excess_bytes": 15, "cross_root_groups": 0, "unique_hashes": 5000}


def scanned(df) -> int:
    """Rows that the scans of an executed plan have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_trees(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    files = spark.range(20_000).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("path"), F.md5(F.col("id").cast("string")).alias("sha256"), (F.col("id") % 5 == 0).alias("blocked"))
    other = files.withColumn("sha256", F.when(F.col("path").isin("f/17", "f/4000"), "x").otherwise(F.col("sha256"))).where("path != 'f/99'").unionByName(spark.createDataFrame([("g/1", "y", True)], files.schema))
    hash_tree.write(files, one, depth=1)
    hash_tree.write(other, two, depth=1)
    leaves = hash_tree.differing(spark, one, two)
    assert 1 <= len(leaves) <= 4
    assert rows(hash_tree.compare(spark, one, two)) == rows(parity.compare(files, other.select("path", "sha256")))
    few = hash_tree.files(spark, two, leaves)
    assert scanned(few) == few.count() <= 4 * 20_000 / 16 * 1.5  # of the target only ranges that differ are read
    hash_tree.update(spark, two, other.where("path in ('f/17', 'f/4000', 'g/1')"), files.where("path in ('f/17', 'f/4000', 'f/99')"))
    assert hash_tree.differing(spark, one, two) == [] and rows(hash_tree.files(spark, two).drop("leaf")) == rows(files)
    assert hash_tree.compare(spark, one, two).where("status != 'matching'").count() == 0
    before = rows(hash_tree.nodes(spark, two))
    hash_tree.repair(spark, two)
    assert rows(hash_tree.nodes(spark, two)) == before
    hash_tree.update(spark, two, files.where("path != 'f/1'").select("path", "sha256"), files.limit(0))
    assert [r.path for r in hash_tree.files(spark, two).collect()] == ["f/1"]
    assert hash_tree.compare(spark, one, two).groupBy("status").count().where("status = 'missing'").first()["count"] == 19_999
    with pytest.raises(ValueError, match="depths"):
        hash_tree.write(files, two, depth=2)
        hash_tree.differing(spark, one, two)
