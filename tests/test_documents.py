"""JSON documents against their rules, case folding, group limits below exchanges."""

import json

import pytest
from pyspark.sql import functions as F

from mediagrove.functions import scalar as S
from mediagrove.operators import documents, organizer, publishing

GOOD = {
    "config": {"version": 1, "roots": [{"id": "a", "kind": "romm", "path": "/x"}], "policy": {"version": 1, "default": "managed", "rules": [{"role": "cover", "mode": "managed"}]}},
    "policy": {"version": 1, "default": "managed", "rules": []},
    "targets": {"version": 1, "targets": [{"id": "t", "name": "T", "device": "d", "platform": "steam", "adapter": "steam", "root": "/r"}]},
    "profile": {"version": 1, "id": "p", "name": "P", "description": "", "artwork": None, "mods": [{"game": "g", "set": "s"}]},
}


def problems(spark, *docs):
    rows = [(k, kind, "p", None if d is None else d if isinstance(d, str) else json.dumps(d)) for k, (kind, d) in enumerate(docs)]
    df = spark.createDataFrame(rows, "id long, kind string, stem string, text string").withColumn("path", F.lit("clash"))
    return sorted((r.id, r.path, r.at, r.problem) for r in documents.invalid(df).collect())


def test_good_documents_have_no_issues(spark):
    assert problems(spark, *GOOD.items()) == []


def test_what_is_no_document(spark):
    bad = "document can't be decoded"
    assert problems(spark, ("policy", None), ("policy", ""), ("policy", "{"), ("policy", "[]"), ("policy", "7"), ("policy", '{"version": 1} {}'), ("policy", "null"), ("policy", '{"version": 1}],[1'), ("policy", "{}, {}")) == [(k, "", 0, bad) for k in range(9)]
    assert problems(spark) == []


def test_faults(spark):
    change = lambda kind, **more: (kind, {**GOOD[kind], **more})
    got = problems(
        spark, change("config", version=2), change("config", roots=[]), change("config", policy={}), change("config", roots=[{"id": "a", "kind": "x", "path": "/"}] * 3), change("config", extra=1),
        change("targets", extra={"deep": [1]}), change("targets", targets=[{"id": "COM1", "name": "n", "root": "rel"}, {"id": "x.", "name": "", "platform": "retro", "adapter": "steam"}]),
        change("profile", artwork="a b"), change("profile", id="nul.", name=" "), change("profile", mods=[{"game": "g", "set": "s"}, {"game": "g", "set": "/"}]), change("profile", version="1", mods=None),
        ("policy", {}), change("policy", default=3, rules=[{"mode": "managed", "source": 1}, 5]),
    )
    assert got == sorted([
        (0, "version", 0, "config version must be 1"), (1, "roots", 0, "config must define at least one root"), (2, "policy.version", 0, "policy version must be 1"), (2, "policy", 0, "policy version must be 1"),
        (3, "roots[].id", 2, "duplicate root id"), (5, "extra", 0, "unknown field"), (5, "extra.deep", 0, "unknown field"), (5, "extra.deep[]", 0, "unknown field"),
        (6, "targets[].id", 0, "targets need unique path-safe IDs and names"), (6, "targets[].root", 0, "target root must be a host-local absolute directory"),
        (6, "targets[].name", 1, "targets need unique path-safe IDs and names"), (6, "targets[].adapter", 1, "steam adapter requires the Steam platform"),
        (7, "artwork", 0, "decky artwork id is not path-safe"), (8, "id", 0, "decky profile id is not path-safe"), (8, "id", 0, "decky profile filename stem does not match id"), (8, "name", 0, "decky profile name is required"),
        (9, "mods[].game", 1, "decky profile contains more than one mod set for a game"), (9, "mods[].set", 1, "decky mod game/set ids must be path-safe"), (10, "version", 0, "field has another type"),
        (11, "version", 0, "policy version must be 1"), (11, "default", 0, "invalid default policy mode"), (12, "default", 0, "field has another type"), (12, "default", 0, "invalid default policy mode"),
        (12, "rules[].source", 0, "field has another type"), (12, "rules[]", 1, "field has another type"),
    ])


def test_case_folding(spark):
    pairs = [("ſ", "S", True), ("K", "k", True), ("ß", "ss", False), ("ẞ", "ß", True), ("İ", "i", False), ("ı", "I", False), ("Σ", "ς", True), ("ǅ", "ǆ", True), ("µ", "μ", True),
             ("ÄÖ", "äö", True), ("Aa", "aA", True), ("a", "b", False), ("", "", True), ("\U00010400", "\U00010428", True)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert df.where((S.folded(F.col("a")) == S.folded(F.col("b"))) != F.col("same")).collect() == []
    assert df.select(S.folded(F.lit(None).cast("string"))).first()[0] is None


def test_ids(spark):
    rows = [("a", True), ("a.b-c_1.", True), ("A", False), ("", False), ("-a", False), ("con", False), ("con.", False), ("con.x", True), ("lpt9", False), ("lpt0", True), ("a/b", False), ("a\n", False), ("x" * 300, True)]
    df = spark.createDataFrame(rows, "id string, safe boolean")
    assert df.where(S.safe_id(F.col("id")) != F.col("safe")).collect() == []
    assert df.where(S.plain_id(F.col("id"))).count() == 8


def test_topologies(spark):
    rows = [("none", None), ("bad", "{"), ("own", '{"platforms": [{"id": "x", "name": "X"}], "profiles": [{"platform": "x", "name": "A b"}, {"platform": "x"}]}')]
    got = publishing.topologies(spark.createDataFrame(rows, "host string, text string"))
    assert {r.host: r["count"] for r in got.groupBy("host").count().collect()} == {"none": 16, "own": 3}
    assert sorted(tuple(r) for r in got.where("host = 'own' and name is not null").select("what", "id", "platforms").collect()) == [("platform", "x", []), ("profile", "x/a-b", ["x"])]


@pytest.mark.parametrize("make", [organizer.previews, publishing.card_roles])
def test_no_task_sorts_a_whole_group(spark, make):
    rows = spark.range(10_000).select(F.concat(F.lit("steam"), (F.col("id") % 1).cast("string")).alias("platform"), (F.col("id") % 1).alias("key"), F.lit("cover").alias("role"), F.col("id").cast("string").alias("game"), F.col("id").cast("string").alias("observation_id"), F.col("id").alias("n"))
    out = make(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in plan[: plan.index("Exchange")] and "Partial" in below  # tasks keep their first few rows before the exchange
    assert out.count() <= 6
