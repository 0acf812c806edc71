"""Snapshots read by place and id, place numbers and ordered digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from mediagrove.functions.cuts import cut
from mediagrove.functions.order import numbered, ordered_digest
from mediagrove.operators import listing, snapshot

ROWS = 100_000


def scanned(df) -> int:
    """Rows that the scans of a plan have read once it has run."""
    df.collect()

    def walk(plan) -> int:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if name == "FileSourceScanExec" else 0
        below = plan.children()
        return own + sum(walk(below.apply(k)) for k in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def obs(spark):
    n = F.col("id")
    rows = spark.range(ROWS).select(F.concat(F.lit("root"), (n % 3).cast("string")).alias("root_id"), F.lpad((n * 7919 % ROWS).cast("string"), 6, "0").alias("path"), F.md5(n.cast("string")).alias("sha256"))
    return cut(rows.withColumn("observation_id", F.sha2(F.concat("root_id", F.lit("/"), "path"), 256)))


@pytest.fixture(scope="module")
def where(spark, obs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshot"))
    snapshot.write(obs, path, parts=6)
    return path


def test_pages_read_their_own_rows(spark, obs, where):
    keys = [(r.root_id, r.path) for r in obs.select("root_id", "path").orderBy("root_id", "path").collect()]
    got = lambda df: [(r.root_id, r.path) for r in df.collect()]
    for number, size in ((1, 50), (1000, 50), (2000, 50), (2001, 50), (0, 10), (-3, 0), (3, 33_400)):
        n, s = listing.clamped(number, size)
        assert got(snapshot.page(spark, where, number, size)) == keys[(n - 1) * s : n * s] == got(listing.page(obs, number, size))
    late = snapshot.page(spark, where, 1000, 50)
    assert scanned(late) < ROWS / 100
    last = keys[49_999]
    assert got(snapshot.after(spark, where, *last)) == keys[50_000:50_050]
    for key in (("root0", ""), ("root1", "0000005"), ("root1", "zzz"), ("root15", "x"), ("a", "a"), ("z", "z")):
        assert got(snapshot.after(spark, where, *key, 20)) == [k for k in keys if k > key][:20]
    assert snapshot.total(spark, where) == ROWS


def test_lookups_open_one_folder(spark, obs, where):
    row = obs.orderBy("sha256").first()
    one = snapshot.lookup(spark, where, row.observation_id)
    assert [r.path for r in one.collect()] == [row.path] and scanned(one) < ROWS / 100
    assert snapshot.lookup(spark, where, "0" * 64).count() == 0
    some = obs.where("path like '%77'").select("observation_id")
    assert snapshot.lookup_all(spark, where, some.union(some)).count() == some.count()


def test_empty_snapshot(spark, obs, tmp_path):
    snapshot.write(obs.limit(0), str(tmp_path))
    assert snapshot.page(spark, str(tmp_path)).count() == 0 and snapshot.after(spark, str(tmp_path), "a", "b").count() == 0 and snapshot.total(spark, str(tmp_path)) == 0


def test_places(spark):
    df = spark.createDataFrame([(k * 37 % 100, None if k % 9 == 0 else f"v{k}") for k in range(500)], "a int, b string")
    for parts in (1, 7):
        got = numbered(df.repartition(5), "a", "b", parts=parts).collect()
        assert sorted(r.pos for r in got) == list(range(500))
        assert [(r.a, r.b or "") for r in sorted(got, key=lambda r: r.pos)] == sorted((r.a, r.b or "") for r in got)
    assert numbered(df.limit(0), "a").count() == 0


def plain(rows, leaf):
    level = [hashlib.sha256("\x1f".join("\0" if v is None else str(v) for v in r).encode()).hexdigest() for r in rows]
    while True:
        level = [hashlib.sha256("".join(level[k : k + leaf]).encode()).hexdigest() for k in range(0, len(level), leaf)]
        if len(level) <= leaf:
            return len(rows), hashlib.sha256((f"{len(rows)}:" + "".join(level)).encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 10, 101, 1000])
def test_ordered_digest_is_the_same_in_any_partitions(spark, n):
    rows = [(k, None if k % 5 == 0 else f"text {k}") for k in range(n)]
    df = spark.createDataFrame(rows, "k long, v string")
    for parts in (1, 40) if n else (3,):
        got = ordered_digest(df.repartition(max(parts // 2, 1)), "k", leaf=10, parts=parts).first()
        assert tuple(got) == plain(rows, 10)
    if n > 1:
        swapped = [(k, rows[{0: 1, 1: 0}.get(k, k)][1]) for k in range(n)]
        assert ordered_digest(spark.createDataFrame(swapped, "k long, v string"), "k", leaf=10).first().digest != got.digest
