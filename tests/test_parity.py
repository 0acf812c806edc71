"""Effects of actions: values against plain Python, and rows of a few roots dealt over all tasks."""

import re

import pytest
from pyspark.sql import functions as F

from mediagrove.operators import parity
from mediagrove.plans import queries as Q

SF = "/root/testdata/sf0.001"
ACTIONS = "destination_root string, destination_path string, action string, source_sha256 string, source_size long"
PRESENT = "root string, path string, sha256 string, size long, type string"
PARTS = 64


@pytest.fixture
def static(spark):
    """Plans as they are before any stage has run, on many partitions."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": str(PARTS)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def by_root_alone(df):
    """Exchanges that deal whole rows by their root; those of sums get a row a task and root, configured tables call it otherwise."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [x for x, below in zip(lines, lines[1:]) if re.search(r"Exchange hashpartitioning\(destination_root#\d+, \d+\)", x) and "partial_" not in below]


def test_actions_of_few_roots_are_dealt_over_all_tasks(static):
    actions = static.range(0, 16_000, 1, 8).selectExpr("'r' destination_root", "if(id % 2 = 0, '', concat('p', id)) destination_path", "'copy' action", "concat('h', id) source_sha256", "id source_size")
    present = actions.where("source_size % 3 = 0 and destination_path != ''").selectExpr("destination_root root", "destination_path path", "source_sha256 sha256", "source_size size", "'file' type")
    out = parity.analyze(actions, static.createDataFrame([("r",)], "root string"), present)
    assert not by_root_alone(out)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 16_000 and max(sizes) <= 2_000


def test_effects(spark):
    roots = spark.createDataFrame([("a",), ("b",)], "root string")
    actions = [(r, p, act, h, 5) for r in ("a", "b", "off", None) for p in ("", None, "new", "same", "differs", "link", "twice") for act in ("copy", "remove") for h in ("h", "")]
    there = [(r, p, h, n, t) for r in ("a", "off") for p, h, n, t in (("same", "h", 7, "file"), ("differs", "x", 8, "file"), ("link", "h", 9, "link"), ("twice", "h", 1, "file"), ("twice", "x", 2, "other"))]

    def effects(r, p, act, h, size):
        for now in [x[2:] for x in there if x[:2] == (r, p)] or [None]:
            sha, n, kind = now or ("", 0, "")
            effect = "no-filesystem-change" if p == "" else "root-unavailable" if r not in ("a", "b") else ("would-remove" if now else "no-filesystem-change") if act == "remove" else "create" if not now else "replace-same-hash" if kind == "file" and h and sha == h else "conflict"
            file = n if kind == "file" else 0
            yield r, p, act, h, size, effect, effect in ("conflict", "root-unavailable"), size if effect in ("create", "conflict") else 0, file if effect == "conflict" else 0, file if effect == "would-remove" else 0

    out = parity.analyze(spark.createDataFrame(actions, ACTIONS), roots, spark.createDataFrame(there, PRESENT))
    assert out.columns == ["destination_root", "destination_path", "action", "source_sha256", "source_size", "effect", "conflict", "conflict_reason", "new_bytes", "backup_bytes", "freed_bytes"]
    assert sorted(map(str, (tuple(r) for r in out.drop("conflict_reason").collect()))) == sorted(str(x) for a in actions for x in effects(*a))


def test_plan_of_t15_analysis(static):
    assert not by_root_alone(Q.QUERIES["t15_analysis"](static, SF))


def test_plan_of_a18_totals(static):
    assert not by_root_alone(Q.QUERIES["a18_totals"](static, SF))


def test_plan_of_a18_space(static):
    assert not by_root_alone(Q.QUERIES["a18_space"](static, SF))
