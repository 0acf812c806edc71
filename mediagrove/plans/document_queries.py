"""Registered queries over JSON documents, made from given tables: constraints as issue rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import documents, publishing
from .queries import _duck, query

# A document of each kind a supplier, with faults by the remainders of its key; k % 13 = 0: cut off.
_K = "FROM (SELECT s_suppkey AS k, CAST(s_suppkey AS STRING) AS s FROM {supplier})"
_CUT = "CASE WHEN k % 13 = 0 THEN '{{\"version\": 1, ' ELSE "
_CONFIG = f"""SELECT k AS id, 'config' AS kind, '' AS stem, {_CUT}concat('{{{{"version": ', CASE WHEN k % 5 = 0 THEN '2' ELSE '1' END, ', "roots": [', CASE WHEN k % 7 = 0 THEN '' ELSE concat('{{{{"id": "r', CAST(k % 3 AS STRING), '", "kind": "', CASE WHEN k % 4 = 0 THEN '' ELSE 'romm' END,
  '", "path": "/p"}}}}, {{{{"id": "', CASE k % 6 WHEN 0 THEN 'r0' WHEN 1 THEN 'bad id' ELSE 's' END, '", "kind": "romm", "path": ', CASE WHEN k % 8 = 1 THEN '7' ELSE '"/q"' END, '}}}}') END, '], "policy": {{{{"version": 1, "default": "managed"}}}}}}}}') END AS text {_K}"""
_POLICY = f"""SELECT k AS id, 'policy' AS kind, '' AS stem, {_CUT}concat('{{{{"version": 1, "default": "', CASE WHEN k % 5 = 0 THEN 'x' ELSE 'managed' END, '", "rules": [{{{{"role": "cover", "mode": "managed"}}}}, {{{{"role": "', CASE WHEN k % 3 = 0 THEN 'cover' ELSE 'logo' END, '", "mode": "', CASE WHEN k % 4 = 0 THEN 'never' ELSE 'quarantined' END, '"}}}}]}}}}') END AS text {_K}"""
_TARGETS = f"""SELECT k AS id, 'targets' AS kind, '' AS stem, {_CUT}concat('{{{{"version": 1, "targets": [{{{{"id": "t", "name": "T", "device": "d', CAST(k % 4 AS STRING), '", "platform": "steam", "adapter": "steam", "root": "/x"}}}}, {{{{"id": "', CASE k % 3 WHEN 0 THEN 't' WHEN 1 THEN 'con' ELSE 'u' END,
  '", "name": "', CASE WHEN k % 11 = 0 THEN '' ELSE 'U' END, '", "device": "d0", "platform": "retro", "adapter": "', CASE WHEN k % 5 = 0 THEN 'steam' ELSE '' END, '", "root": "', CASE WHEN k % 7 = 0 THEN 'rel/x' ELSE '' END, '"', CASE WHEN k % 2 = 0 THEN ', "extra": 1' ELSE '' END, '}}}}]}}}}') END AS text {_K}"""
_PROFILE = f"""SELECT k AS id, 'profile' AS kind, CASE WHEN k % 11 = 0 THEN 'other' ELSE concat('p', s) END AS stem, {_CUT}concat('{{{{"version": 1, "id": "p', s, '", "name": "', CASE WHEN k % 3 = 0 THEN '  ' ELSE 'N' END, '", "artwork": ', CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"bad/id"' ELSE concat('"set', CAST(k % 6 AS STRING), '"') END,
  ', "mods": [{{{{"game": "g", "set": "s', CAST(k % 5 AS STRING), '"}}}}, {{{{"game": "', CASE WHEN k % 7 = 0 THEN 'g' ELSE 'h' END, '", "set": "s1"}}}}]}}}}') END AS text {_K}"""
_TREES = "SELECT CASE n_nationkey % 3 WHEN 0 THEN concat('artwork/set', CAST(n_nationkey % 7 AS STRING), '/grid') WHEN 1 THEN concat('mods/g/s', CAST(n_nationkey % 4 AS STRING)) ELSE concat('mods/h/s', CAST(n_nationkey % 2 AS STRING)) END AS payload, CAST(max(n_nationkey % 3) + min(n_nationkey % 2) AS BIGINT) AS files, max(n_nationkey) % 4 = 1 AS marker, CAST(min(n_nationkey) % 5 AS INT) - 3 AS links FROM {nation} GROUP BY 1"


def _documents(spark, sf_dir, sql):
    return spark.sql(sql, supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def _issues(kind: str, *found: tuple[str, str, int, str]) -> str:
    """The oracle's issues: (condition on k, path, at, problem)."""
    bad = "SELECT s_suppkey AS id, '{kind}' AS kind, '' AS path, 0::BIGINT AS at, 'document can''t be decoded' AS problem FROM supplier WHERE s_suppkey % 13 = 0".format(kind=kind)
    return " UNION ALL ".join([bad, *(f"SELECT DISTINCT k, '{kind}', '{path}', {at}::BIGINT, '{problem}' FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 13 <> 0 AND ({where})" for where, path, at, problem in found)])


@query(_issues("config", ("k % 5 = 0", "version", 0, "config version must be 1"), ("k % 7 = 0", "roots", 0, "config must define at least one root"), ("k % 7 <> 0 AND k % 4 = 0", "roots[].kind", 0, "root kind is required"),
               ("k % 7 <> 0 AND k % 6 = 1", "roots[].id", 1, "root id is not path-safe"), ("k % 7 <> 0 AND k % 6 = 0", "roots[].id", 1, "duplicate root id"), ("k % 7 <> 0 AND k % 8 = 1", "roots[].path", 1, "field has another type")))
def t27_config(spark, sf_dir):
    return documents.invalid(_documents(spark, sf_dir, _CONFIG))


@query(_issues("policy", ("k % 5 = 0", "default", 0, "invalid default policy mode"), ("k % 4 = 0", "rules[].mode", 1, "rule has invalid mode"), ("k % 3 = 0", "rules[].source", 1, "duplicate policy selector")))
def t27_policy(spark, sf_dir):
    return documents.invalid(_documents(spark, sf_dir, _POLICY))


_NAMES = "targets need unique path-safe IDs and names"


@query(_issues("targets", ("k % 3 = 1", "targets[].id", 1, _NAMES), ("k % 3 = 0", "targets[].id", 1, _NAMES), ("k % 11 = 0", "targets[].name", 1, _NAMES), ("k % 5 = 0", "targets[].adapter", 1, "steam adapter requires the Steam platform"),
               ("k % 7 = 0", "targets[].root", 1, "target root must be a host-local absolute directory"), ("k % 2 = 0", "targets[].extra", 1, "unknown field")))
def t27_targets(spark, sf_dir):
    return documents.invalid(_documents(spark, sf_dir, _TARGETS))


@query("""SELECT s_suppkey AS id, 0::BIGINT AS at, 't' AS target, 'target does not match a declared device/platform' AS problem FROM supplier WHERE s_suppkey % 13 <> 0 AND s_suppkey % 4 > 1
UNION ALL SELECT s_suppkey, 1, CASE s_suppkey % 3 WHEN 0 THEN 't' WHEN 1 THEN 'con' ELSE 'u' END, 'target does not match a declared device/platform' FROM supplier WHERE s_suppkey % 13 <> 0""")
def t27_undeclared_targets(spark, sf_dir):
    """Devices d0 and d1 are declared for Steam, none for retro games."""
    devices = spark.createDataFrame([("d0", ["steam"]), ("d1", ["steam", "playnite"]), ("d2", ["playnite"])], "id string, platforms array<string>")
    return documents.undeclared_targets(_documents(spark, sf_dir, _TARGETS), devices)


_MOD = "decky mod game/set ids must be path-safe"


@query(_issues("profile", ("k % 11 = 0", "id", 0, "decky profile filename stem does not match id"), ("k % 3 = 0", "name", 0, "decky profile name is required"), ("k % 4 = 1", "artwork", 0, "decky artwork id is not path-safe"), ("k % 7 = 0", "mods[].game", 1, "decky profile contains more than one mod set for a game")))
def t27_profile(spark, sf_dir):
    return documents.invalid(_documents(spark, sf_dir, _PROFILE))


@query(f"""WITH t AS ({_duck(_TREES.replace('{nation}', 'nation'))}), d AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 13 <> 0),
p AS (SELECT k AS id, 'artwork/' || CASE k % 4 WHEN 1 THEN 'bad/id' ELSE 'set' || (k % 6) END || '/grid' AS payload FROM d WHERE k % 4 <> 0 UNION ALL SELECT k, 'mods/g/s' || (k % 5) FROM d UNION ALL SELECT k, 'mods/' || CASE WHEN k % 7 = 0 THEN 'g' ELSE 'h' END || '/s1' FROM d),
j AS (SELECT p.*, files, marker, links FROM p LEFT JOIN t USING (payload)), r AS (SELECT id, payload, CASE WHEN files IS NULL THEN 'payload is missing' WHEN links > 0 THEN 'symlink is not allowed' WHEN files = 0 THEN 'payload tree is empty'
  WHEN marker AND (payload NOT LIKE 'artwork/%' OR files > 1) THEN 'empty marker stands beside other files or for mods' END AS problem FROM j) SELECT * FROM r WHERE problem IS NOT NULL""")
def t27_catalog(spark, sf_dir):
    trees = spark.sql(_TREES, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    return documents.invalid_catalog(_documents(spark, sf_dir, _PROFILE), trees)


@query("SELECT s_suppkey AS id, path, count(*) AS n FROM (SELECT s_suppkey, unnest(['', 'version', 'default', 'rules', 'rules[]', 'rules[]', 'rules[].role', 'rules[].role', 'rules[].mode', 'rules[].mode']) AS path FROM supplier WHERE s_suppkey % 13 <> 0) GROUP BY ALL")
def f39_nodes(spark, sf_dir):
    """Every value of the policies, by the path it stands at."""
    return documents.nodes(documents.parsed(_documents(spark, sf_dir, _POLICY))).groupBy("id", "path").agg(F.count(F.lit(1)).alias("n"))


# ---- topologies ----------------------------------------------------------------------------------------------------
_STORED = "SELECT c_custkey AS host, CASE WHEN c_custkey % 3 = 0 THEN concat('{{\"version\": 1, \"platforms\": [{{\"id\": \"steam\", \"name\": \"Steam\"}}], \"devices\": [{{\"id\": \"d', CAST(c_custkey AS STRING), '\", \"name\": \"', c_mktsegment, '\", \"platforms\": [\"steam\", \"retro\"]}}], \"profiles\": [{{\"platform\": \"steam\", \"name\": \"', c_mktsegment, '\"}}]}}') END AS text FROM {customer}"
_BUILT_IN = " UNION ALL ".join(
    [f"SELECT 'platform', '{i}', '{n}', ''" for i, n in publishing.PLATFORMS] + [f"SELECT 'device', '{i}', '{n}', '{','.join(p)}'" for i, n, p in publishing.DEVICES]
    + [f"SELECT 'profile', '{p}/{n.lower()}', '{n}', '{p}'" for p, n in publishing.PROFILES]
)


@query(f"""WITH b(what, id, name, platforms) AS ({_BUILT_IN}), c AS (SELECT c_custkey AS host, c_mktsegment AS m FROM customer)
SELECT host, false AS found, what, id, name, platforms FROM c, b WHERE host % 3 <> 0 UNION ALL SELECT host, true, 'platform', 'steam', 'Steam', '' FROM c WHERE host % 3 = 0
UNION ALL SELECT host, true, 'device', 'd' || host, m, 'steam,retro' FROM c WHERE host % 3 = 0 UNION ALL SELECT host, true, 'profile', 'steam/' || lower(m), m, 'steam' FROM c WHERE host % 3 = 0""")
def s30_topologies(spark, sf_dir):
    """The topology of each customer's host: a third has one stored."""
    stored = spark.sql(_STORED, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return publishing.topologies(stored).withColumn("platforms", F.array_join("platforms", ","))


# ---- case folding --------------------------------------------------------------------------------------------------
@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 2 THEN NOT contains(p_name, 'i') WHEN 4 THEN false ELSE true END AS same FROM part""")
def f13_folds(spark, sf_dir):
    """Names against their capitals, with a long s, a Kelvin sign, a dotted capital i, a sharp s and two s in between."""
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    one = F.concat(F.upper(name), F.when(k == 3, "\u1e9e").when(k == 4, "\u00df").otherwise(""))
    two = F.when(k == 0, F.translate(name, "s", "\u017f")).when(k == 1, F.translate(name, "k", "\u212a")).when(k == 2, F.translate(name, "i", "\u0130")).when(k == 3, F.concat(name, F.lit("\u00df"))).otherwise(F.concat(name, F.lit("ss")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (S.folded(one) == S.folded(two)).alias("same"))
