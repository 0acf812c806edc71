"""Registered queries of constraints, detection, ledgers, fingerprints and the incremental scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.cuts import new_path
from ..operators import bindings as B
from ..operators import checks
from ..streaming import roots, scan
from .queries import _W, _duck, _obs, query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark, sf_dir, table, sql):
    return spark.sql(sql.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: _t(spark, sf_dir, table)})


_ROOTS = "SELECT CASE s_suppkey % 7 WHEN 0 THEN 'Root-1' WHEN 1 THEN 'root-1' WHEN 2 THEN 'con' WHEN 3 THEN 'bad/id' ELSE concat('root-', CAST(s_suppkey AS STRING)) END AS id, CASE s_suppkey % 5 WHEN 0 THEN 'floppy' ELSE 'steam-grid' END AS kind, concat('/R/', CAST(s_suppkey % 30 AS STRING)) AS path FROM supplier"


@query(f"""WITH r AS ({_duck(_ROOTS)}), k AS (SELECT lower(id) AS key, count(*) AS n, count(DISTINCT id) AS s FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT DISTINCT id, 'unsafe id' AS problem FROM r WHERE id = 'con' OR NOT regexp_matches(id, '^[a-z0-9][a-z0-9._-]*$') UNION SELECT id, 'unknown kind' FROM r WHERE kind = 'floppy'
UNION SELECT id, CASE WHEN s > 1 THEN 'ids differ only in case' ELSE 'duplicate id' END FROM r JOIN k ON k.key = lower(id)""")
def t26_roots(spark, sf_dir):
    return checks.invalid_roots(_sql(spark, sf_dir, "supplier", _ROOTS))


@query(f"""WITH sel AS ({B.ORACLE_SELECTED}), b AS (SELECT profile, game_id, CASE WHEN role = 'hero' THEN 'ghost' ELSE role END AS role, CASE WHEN extension = 'ico' THEN 'bad' ELSE sha256 END AS sha256 FROM sel)
SELECT profile, game_id, role, CASE WHEN sha256 = 'bad' THEN 'invalid SHA-256' ELSE 'unknown role' END AS problem FROM b WHERE sha256 = 'bad' OR role = 'ghost'""")
def t27_selections(spark, sf_dir):
    sel = B.selected(spark, sf_dir).withColumns({"sha256": F.when(F.col("extension") == "ico", "bad").otherwise(F.col("sha256")), "role": F.when(F.col("role") == "hero", "ghost").otherwise(F.col("role"))})
    return checks.invalid_selections(sel)


_PROFILES = "SELECT concat('Set ', CAST(n_nationkey % 20 AS STRING)) AS name, concat('p', CAST(n_regionkey AS STRING)) AS platform, concat('art', CAST(n_nationkey % 9 AS STRING)) AS artwork FROM nation"


@query(f"""WITH p AS (SELECT *, platform || '/' || replace(lower(name), ' ', '-') AS key FROM ({_duck(_PROFILES)}))
SELECT 'profile' AS what, key, 'unknown platform' AS problem FROM p WHERE platform IN ('p3', 'p4') UNION ALL SELECT 'profile', key, 'duplicate key' FROM p GROUP BY key HAVING count(*) > 1
UNION ALL SELECT 'profile', artwork, 'artwork set is bound twice' FROM p GROUP BY artwork HAVING count(*) > 1 UNION ALL SELECT 'device', CAST(r_regionkey AS VARCHAR), 'unknown platform' FROM region WHERE r_regionkey > 2""")
def t27_topology(spark, sf_dir):
    platforms = spark.createDataFrame([("p0", "a"), ("p1", "b"), ("p2", "c")], "id string, name string")
    devices = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.array(F.lit("p0"), F.concat(F.lit("p"), F.col("r_regionkey").cast("string"))).alias("platforms"))
    return checks.invalid_topology(_sql(spark, sf_dir, "nation", _PROFILES), platforms, devices)


_FOUND = "SELECT concat('src', CAST(s_nationkey % 4 AS STRING)) AS base, CASE WHEN s_suppkey % 2 = 0 THEN concat('/A/', CAST(s_suppkey % 40 AS STRING)) ELSE concat('/a/', CAST(s_suppkey % 40 AS STRING)) END AS path FROM supplier"


@query(f"""WITH f AS (SELECT min(path) AS path, min_by(base, path || ' ' || base) AS base FROM ({_duck(_FOUND)}) GROUP BY lower(path)), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS n FROM f)
SELECT CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id, path FROM n""")
def x3_detected_ids(spark, sf_dir):
    return checks.detected_ids(_sql(spark, sf_dir, "supplier", _FOUND))


@query(f"WITH f AS ({_duck(_FOUND)}) SELECT base, path, lower(path) LIKE '/a/1%' AS configured, CASE WHEN lower(path) LIKE '/a/1%' THEN 'configured' ELSE 'available' END AS status FROM f")
def j17_configured(spark, sf_dir):
    found = _sql(spark, sf_dir, "supplier", _FOUND)
    return checks.configured_flags(found, found.where("lower(path) LIKE '/a/1%'").select(F.upper("path").alias("path"))).select("base", "path", "configured", "status")


@query(f"{_W} SELECT kind FROM (VALUES ('steam-grid'), ('playnite-library'), ('playnite-extra'), ('decky-catalog'), ('esde-media'), ('romm')) k(kind) WHERE kind NOT IN (SELECT root_kind FROM obs WHERE root_kind IN ('playnite-extra', 'romm')) AND kind <> 'playnite-library'")
def j16_missing_kinds(spark, sf_dir):
    return checks.missing_kinds(_obs(spark, sf_dir).where("root_kind IN ('playnite-extra', 'romm')").select(F.col("root_kind").alias("kind")))


@query("SELECT c_custkey AS id, c_name AS name, 'draft' AS state FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_mktsegment, 'live' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0")
def t25_profiles(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    pick = lambda where, name: c.where(where).select(F.col("c_custkey").alias("id"), F.col(name).alias("name"))
    return checks.drafts_over_live(pick("c_custkey % 3 = 0", "c_name"), pick("c_custkey % 2 = 0", "c_mktsegment"))


@query("SELECT least(count(*), 10000) AS n FROM lineitem")
def o14_bounded_count(spark, sf_dir):
    return checks.bounded_count(_t(spark, sf_dir, "lineitem"))


_LOG = "SELECT conv_id, turn, sha256(coalesce(text, '')) AS digest, lag(sha256(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS truth FROM conversations"


@query(f"WITH l AS ({_LOG}) SELECT conv_id AS chain, turn AS step, coalesce(truth, '') = CASE WHEN conv_id % 7 = 0 AND turn % 2 = 1 THEN 'tampered' ELSE coalesce(truth, '') END AS verified FROM l")
def t16_chain(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("step"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    before = c.select("chain", (F.col("step") + 1).alias("step"), F.col("digest").alias("previous"))
    said = c.join(before, ["chain", "step"], "left").withColumn("previous", F.when((F.col("chain") % 7 == 0) & (F.col("step") % 2 == 1), "tampered").otherwise(F.coalesce("previous", F.lit(""))))
    return checks.chain(said).select("chain", "step", "verified")


@query("SELECT role AS type, conv_id * 1000 + turn AS id, conv_id % 5 <> 0 AS verified FROM conversations WHERE text IS NOT NULL")
def t17_history(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").where("text is not null")
    stated = F.when(F.col("conv_id") % 5 == 0, "0" * 64).otherwise(F.upper(F.sha2("text", 256)))
    return checks.history(c.select(F.col("role").alias("type"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), stated.alias("stated")))


@query(f"""{_W}, p AS (SELECT root_id, h[:3] AS b, sha256(string_agg(h, '' ORDER BY h)) AS d FROM (SELECT root_id, sha256(path || chr(0) || size || chr(0) || seq) AS h FROM obs) GROUP BY ALL)
SELECT root_id, sha256(string_agg(d, '' ORDER BY b)) AS fingerprint FROM p GROUP BY root_id""")
def s28_fingerprint(spark, sf_dir):
    return checks.fingerprint(_obs(spark, sf_dir).withColumn("mtime", F.col("seq")))


@query("SELECT id, h[7:8] || h[5:6] || h[3:4] || h[1:2] || '-' || h[11:12] || h[9:10] || '-' || h[15:16] || h[13:14] || '-' || h[17:20] || '-' || h[21:] AS guid FROM (SELECT p_partkey AS id, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part)")
def f19_guids(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.guid_text(F.unhex(F.md5(F.col("p_partkey").cast("string")))).alias("guid"))


@query("SELECT count(*) FILTER (WHERE s_nationkey % 4 IN (0, 1)) AS completed, count(*) AS total, CAST(sum(s_suppkey) AS BIGINT) AS items FROM supplier")
def a29_progress(spark, sf_dir):
    state = F.element_at(F.array(*map(F.lit, ("complete", "error", "queued", "scanning"))), F.col("s_nationkey") % 4 + 1)
    return checks.progress(_t(spark, sf_dir, "supplier").select(state.alias("state"), F.col("s_suppkey").alias("items")))


@query("SELECT platform, count(DISTINCT key) AS profiles FROM (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'steam' ELSE 'retro' END AS platform, CASE c_mktsegment WHEN 'BUILDING' THEN 'steam' ELSE 'retro' END || '/' || replace(lower(c_mktsegment), ' ', '-') AS key FROM customer) GROUP BY 1")
def a30_profiles_by_platform(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "steam").otherwise("retro").alias("platform"), F.col("c_mktsegment").alias("name"))
    return c.withColumn("key", S.profile_key(F.col("platform"), F.col("name"))).groupBy("platform").agg(F.count_distinct("key").alias("profiles"))


@query("SELECT event_type AS root_id, count(*) AS file_count, CAST(sum(user_id) AS BIGINT) AS total_bytes FROM events GROUP BY 1")
def ts1_incremental_scan(spark, sf_dir):
    """Runs the stream over the files of ``events`` to its end, then reads the running totals."""
    schema = _t(spark, sf_dir, "events").schema
    facts = scan.read(spark, f"{sf_dir}/events*.parquet", schema).select(F.col("event_type").alias("root_id"), F.col("user_id").alias("size"))

    path = new_path(spark)
    scan.run_versions(scan.summaries(facts), f"{path}/totals", roots.begin(spark, path), f"{path}/checkpoint")
    return scan.current(spark, f"{path}/totals")
