"""Registered queries over written tables: snapshots read by place and id, ordered digests, states of publishing plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cuts import new_path
from ..functions.order import numbered, ordered_digest
from ..operators import listing, parity, snapshot
from .queries import _LIST, _MODE, _OBS, _W, _WI, _duck, _listing, _obs, query

# ---- snapshots and pages -------------------------------------------------------------------------------------------
def _snapshot(spark, sf_dir) -> str:
    path = new_path(spark)
    snapshot.write(_obs(spark, sf_dir).select("observation_id", "root_id", "path", "size", "sha256", "role"), path)
    return path


@query(f"WITH {_OBS} SELECT root_id, path FROM obs ORDER BY root_id, path LIMIT 40 OFFSET 80")
def o13_snapshot_page(spark, sf_dir):
    return snapshot.page(spark, _snapshot(spark, sf_dir), 3, 40).select("root_id", "path")


@query(f"WITH {_OBS} SELECT root_id, path FROM obs WHERE root_id > 'src13' OR (root_id = 'src13' AND path > 'm') ORDER BY root_id, path LIMIT 25")
def o13_seek_page(spark, sf_dir):
    """The page after a key that no file has."""
    return snapshot.after(spark, _snapshot(spark, sf_dir), "src13", "m", 25).select("root_id", "path")


@query(f"WITH {_OBS} SELECT observation_id, root_id, path, size, sha256, role FROM obs WHERE observation_id = (SELECT min(observation_id) FROM obs WHERE role = 'grid')")
def w15_snapshot_lookup(spark, sf_dir):
    path = _snapshot(spark, sf_dir)
    wanted = spark.read.parquet(f"{path}/ids").where("role = 'grid'").agg(F.min("observation_id")).first()[0]
    return snapshot.lookup(spark, path, wanted)


@query(f"WITH {_OBS} SELECT observation_id, root_id, path, size, sha256, role FROM obs WHERE observation_id IN (SELECT observation_id FROM obs WHERE seq % 50 = 0)")
def j30_snapshot_rows(spark, sf_dir):
    """The rows of a table of ids."""
    return snapshot.lookup_all(spark, _snapshot(spark, sf_dir), _obs(spark, sf_dir).where("seq % 50 = 0"))


@query(f"{_WI}, {_MODE}, {_LIST} SELECT * FROM listed ORDER BY root_id, path, sha256 LIMIT 50")
def o13_first_page(spark, sf_dir):
    """A page and a size below 1 are the first page of 50."""
    return listing.page(_listing(spark, sf_dir), -2, 0)


@query(f"WITH {_OBS} SELECT root_id, count(*) AS files, sum(pos)::BIGINT AS places, min(pos) AS first, max(pos) AS last FROM (SELECT *, row_number() OVER (ORDER BY root_id, path, seq) - 1 AS pos FROM obs) GROUP BY root_id")
def o1_places(spark, sf_dir):
    """Where each root's files lie in the listing's order."""
    placed = numbered(_obs(spark, sf_dir).select("root_id", "path", "seq"), "root_id", "path", "seq")
    return placed.groupBy("root_id").agg(F.count(F.lit(1)).alias("files"), F.sum("pos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))


# ---- ordered digests -----------------------------------------------------------------------------------------------
@query(f"""{_W}, r AS (SELECT row_number() OVER (ORDER BY root_id, path, seq) - 1 AS pos, sha256(root_id || chr(31) || path || chr(31) || seq || chr(31) || size || chr(31) || sha256) AS d FROM obs),
l AS (SELECT pos // 100 AS pos, count(*) AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM r GROUP BY pos // 100),
m AS (SELECT CASE WHEN (SELECT count(*) FROM l) > 100 THEN pos // 100 ELSE pos END AS pos, d, pos AS p FROM l), k AS (SELECT pos, CASE WHEN (SELECT count(*) FROM l) > 100 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE min(d) END AS d FROM m GROUP BY pos)
SELECT (SELECT count(*) FROM r) AS n, sha256((SELECT count(*) FROM r) || ':' || string_agg(d, '' ORDER BY pos)) AS digest FROM k""")
def a31_ordered_digest(spark, sf_dir):
    """The digest of the whole inventory as a document in the order of its rows, from leaves of 100."""
    return ordered_digest(_obs(spark, sf_dir).select("root_id", "path", "seq", "size", "sha256"), "root_id", "path", "seq", leaf=100)


# ---- states of publishing plans ------------------------------------------------------------------------------------
# Targets: a region each; of another adapter, without a folder, offline, with unreadable files, and fully observed. Files of two platforms.
_FILES = "SELECT concat(CASE WHEN l_linenumber % 3 = 0 THEN 'retro' ELSE 'steam' END, '/p', CAST(l_linenumber AS STRING)) AS profile, concat('f/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS path, min(concat('h', CAST(l_partkey AS STRING))) AS sha256, min(l_partkey) % 9 = 0 AS blocked, l_orderkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
_TARGETS = "SELECT r_name AS target, 'steam' AS platform, CASE r_regionkey WHEN 0 THEN 'romm' ELSE 'steam' END AS adapter, CASE r_regionkey WHEN 1 THEN '' ELSE concat('/t/', r_name) END AS root, r_regionkey <> 2 AS available FROM {region}"
_SEEN = "SELECT concat('/t/', r_name) AS root, path, CASE WHEN l_orderkey % 4 = 0 THEN 'x' ELSE sha256 END AS sha256, NOT (r_regionkey = 3 AND l_orderkey % 11 = 0) AS readable FROM {files} JOIN {region} ON r_regionkey IN (2, 3, 4) WHERE l_orderkey % 3 <> 0"
_PLANS = f"""f AS ({_duck(_FILES.replace('{lineitem}', 'lineitem'))}), tg AS ({_duck(_TARGETS.replace('{region}', 'region'))}), ob AS ({_duck(_SEEN.replace('{files}', 'f').replace('{region}', 'region'))}),
st AS (SELECT *, CASE WHEN adapter <> 'steam' THEN 'unsupported' WHEN root = '' THEN 'unobserved' WHEN NOT available THEN 'offline' ELSE 'observed' END AS state FROM tg),
pf AS (SELECT f.profile, st.target, st.state, f.path, f.sha256, f.blocked, CASE WHEN st.state = 'observed' AND coalesce(ob.readable, true) THEN coalesce(ob.sha256, '') ELSE '' END AS previous,
  CASE WHEN st.state <> 'observed' OR NOT coalesce(ob.readable, true) THEN 'unknown' WHEN ob.sha256 IS NULL THEN 'missing' WHEN ob.sha256 = f.sha256 THEN 'matching' ELSE 'different' END AS status
  FROM f JOIN st ON starts_with(f.profile, st.platform || '/') AND adapter = 'steam' LEFT JOIN ob ON ob.root = st.root AND ob.path = f.path)"""


def _publishing(spark, sf_dir):
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "region")}
    files = spark.sql(_FILES, lineitem=read["lineitem"])
    return files.select("profile", "path", "sha256", "blocked"), spark.sql(_TARGETS, region=read["region"]), spark.sql(_SEEN, files=files, region=read["region"])


@query(f"WITH {_PLANS} SELECT * FROM pf")
def t22_plan_files(spark, sf_dir):
    return parity.plan_files(*_publishing(spark, sf_dir))


@query(f"""WITH {_PLANS}, c AS (SELECT profile, target, state, count(*) AS files, {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS {s}, count(*) FILTER (WHERE status = '{s}' AND NOT blocked) AS publishable_{s}" for s in parity.STATUSES)},
  count(*) FILTER (WHERE NOT blocked) AS publishable, count(*) FILTER (WHERE blocked) AS blocked FROM pf GROUP BY ALL
  UNION ALL SELECT DISTINCT f.profile, st.target, 'unsupported', {', '.join(['0'] * 11)} FROM f JOIN st ON starts_with(f.profile, st.platform || '/') AND adapter <> 'steam'),
p AS (SELECT * REPLACE (CASE WHEN state = 'observed' AND unknown > 0 THEN 'unknown' ELSE state END AS state) FROM c)
SELECT *, CASE state WHEN 'unsupported' THEN '{parity.STATES['unsupported']}' WHEN 'unobserved' THEN '{parity.STATES['unobserved']}' WHEN 'offline' THEN '{parity.STATES['offline']}' WHEN 'unknown' THEN '{parity.STATES['unknown']}' ELSE '' END AS message FROM p""")
def t22_plan_states(spark, sf_dir):
    """All five states a plan can have."""
    return parity.plans(*_publishing(spark, sf_dir))
