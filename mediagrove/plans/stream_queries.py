"""Registered queries over streams and changes: scans of roots with generations, failures, silent roots and restarts; views kept up by changes; trees compared by digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cuts import new_path
from ..operators import deltas, hash_tree
from ..streaming import roots
from .queries import _OBS, _obs, query

# ---- scans of roots ------------------------------------------------------------------------------------------------
# Each event is a file of the root "type-user % 4". Roots error-3 and click-1 fail, view-2 falls silent after the first half of its files.
_EVENTS = "SELECT concat(event_type, '-', CAST(user_id % 4 AS STRING)) AS root_id, event_id, user_id AS size FROM {events}"
_FAILED, _SILENT = ("error-3", "click-1"), "view-2"
_STATES = f"""f AS (SELECT event_type || '-' || (user_id % 4) AS root_id, event_id, user_id AS size FROM events),
s AS (SELECT root_id, 2::BIGINT AS generation, CASE WHEN root_id IN {_FAILED} THEN 'error' WHEN root_id = '{_SILENT}' THEN 'stalled' ELSE 'complete' END AS status,
  count(*) FILTER (WHERE root_id NOT IN {_FAILED} AND (root_id <> '{_SILENT}' OR event_id % 2 = 0)) AS files,
  coalesce(sum(size) FILTER (WHERE root_id NOT IN {_FAILED} AND (root_id <> '{_SILENT}' OR event_id % 2 = 0)), 0)::BIGINT AS bytes FROM f GROUP BY root_id)"""


def _scanned(spark, sf_dir):
    """Two scans over ``events``: the first is overtaken by the second and its late half is stale. The stream is stopped, and started again from its checkpoint, after each of four deliveries."""
    path = new_path(spark)
    events = spark.sql(_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    named = events.select("root_id").distinct()

    def deliver(hour: int, *parts) -> None:
        whole = None
        for generation, kind, rows in parts:
            own = rows.select(F.lit(generation).cast("long").alias("generation"), "root_id", F.lit(kind).alias("kind"), *((F.col("event_id").cast("string").alias("path"), "size") if "size" in rows.columns else (F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"))), F.make_timestamp(*map(F.lit, (2024, 1, 1, hour, 0, 0))).alias("at"))
            whole = own if whole is None else whole.unionByName(own)
        whole.write.mode("append").parquet(f"{path}/messages")
        roots.run(spark.readStream.schema(roots.MESSAGES).parquet(f"{path}/messages"), path, patience=3600)

    first, even, odd = events.where("event_id % 3 = 0"), events.where("event_id % 2 = 0"), events.where(f"event_id % 2 = 1 and root_id <> '{_SILENT}'")
    failed = F.col("root_id").isin(*_FAILED)
    old = roots.begin(spark, path)
    deliver(10, (old, "queued", named), (old, "file", first.where("event_id % 2 = 0")))
    new = roots.begin(spark, path)
    deliver(10, (new, "queued", named), (new, "file", even))
    deliver(10, (old, "file", first.where("event_id % 2 = 1")), (old, "done", named))
    deliver(14, (new, "file", odd), (new, "failed", named.where(failed)), (new, "done", named.where(~failed & (F.col("root_id") != _SILENT))))
    return roots.states(spark, path)


@query(f"WITH {_STATES} SELECT * FROM s")
def ts2_scan_states(spark, sf_dir):
    return _scanned(spark, sf_dir)


@query(f"""WITH {_STATES} SELECT CASE WHEN count(*) = 0 THEN 'idle' WHEN count(*) FILTER (WHERE status IN ('complete', 'error')) < count(*) THEN 'scanning' ELSE 'complete' END AS status,
  count(*) FILTER (WHERE status IN ('complete', 'error')) AS completed, count(*) AS total, coalesce(sum(files) FILTER (WHERE status = 'complete'), 0)::BIGINT AS items, coalesce(sum(bytes) FILTER (WHERE status = 'complete'), 0)::BIGINT AS bytes FROM s""")
def ts4_scan_progress(spark, sf_dir):
    return roots.progress(_scanned(spark, sf_dir))


@query(f"WITH {_STATES}, v AS (SELECT f.* FROM f JOIN s USING (root_id) WHERE status = 'complete') SELECT root_id, count(*) AS file_count, max(size) AS largest FROM v GROUP BY root_id")
def ts1_visible_files(spark, sf_dir):
    """What readers see while a root is silent and two have failed: the files of the roots that are complete."""
    events = spark.sql(_EVENTS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return roots.visible(events, _scanned(spark, sf_dir)).groupBy("root_id").agg(F.count(F.lit(1)).alias("file_count"), F.max("size").alias("largest"))


# ---- views kept up by changes --------------------------------------------------------------------------------------
# Files that documents stand for: a tenth comes late, a tenth goes again, a tenth changes its content.
_LATE, _GONE, _EDITED = "seq % 10 = 1", "seq % 10 = 0", "seq % 10 = 2"
_NOW = _OBS + f""", now AS (SELECT * REPLACE (CASE WHEN {_EDITED} THEN sha256(sha256 || 'x') ELSE sha256 END AS sha256, CASE WHEN {_EDITED} THEN size + 1 ELSE size END AS size) FROM obs WHERE NOT ({_GONE}))"""
_HEX = "('0x' || md5(path || chr(0) || size || chr(0) || sha256)[{}:{}])::BIGINT"


def _maintained(spark, sf_dir, *views):
    """The views after four changes of the observations: what is there first, late files, files that go, files whose content changes."""
    path, obs = new_path(spark), _obs(spark, sf_dir)
    edited = obs.where(_EDITED)
    after = edited.withColumns({"sha256": F.sha2(F.concat("sha256", F.lit("x")), 256), "size": F.col("size") + 1})
    for number, change in enumerate((obs.where(f"NOT ({_LATE})").withColumn("sign", F.lit(1)), obs.where(_LATE).withColumn("sign", F.lit(1)), obs.where(_GONE).withColumn("sign", F.lit(-1)), deltas.difference(edited, after)), 1):
        deltas.refresh(path, number, change, views, parts=8)
    return path


@query(f"WITH {_NOW} SELECT root_id, count(*) AS file_count, sum(size)::BIGINT AS total_bytes, count(*) FILTER (WHERE mime LIKE 'image/%' OR mime LIKE 'video/%' OR mime = 'application/pdf') AS media_count, count(*) FILTER (WHERE mime LIKE 'image/%') AS image_count, "
       f"min(size)::BIGINT AS smallest, max(size)::BIGINT AS largest, sum({_HEX.format(1, 15)})::DECIMAL(38,0) AS mark_a, sum({_HEX.format(16, 30)})::DECIMAL(38,0) AS mark_b FROM now GROUP BY root_id")  # fmt: skip
def ts5_root_summary(spark, sf_dir):
    return deltas.root_summary(spark, _maintained(spark, sf_dir, deltas.ROOTS, deltas.SIZES))


@query(f"""WITH {_NOW}, c AS (SELECT sha256, min(size) AS size, count(*) AS n, count(DISTINCT root_id) AS roots FROM now GROUP BY sha256)
SELECT count(*) FILTER (WHERE n > 1) AS groups, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS copies, coalesce(sum((n - 1) * size) FILTER (WHERE n > 1), 0)::BIGINT AS excess_bytes, count(*) FILTER (WHERE n > 1 AND roots > 1) AS cross_root_groups, count(*) AS unique_hashes FROM c""")
def ts5_duplicate_summary(spark, sf_dir):
    return deltas.duplicate_summary(spark, _maintained(spark, sf_dir, deltas.COPIES))


@query(f"""WITH {_NOW}, c AS (SELECT sha256, min(size)::BIGINT AS size, count(*) AS copies, bool_or(root_kind IN ('steam-grid', 'esde-media', 'decky-catalog')) AS any_made, bool_and(root_kind IN ('steam-grid', 'esde-media', 'decky-catalog')) AS all_made FROM now GROUP BY sha256 HAVING count(*) > 1)
SELECT sha256, size, copies, CASE WHEN any_made AND NOT all_made THEN 'expected-copy' WHEN all_made THEN 'review' ELSE 'canonical-opportunity' END AS classification FROM c""")
def ts5_duplicate_view(spark, sf_dir):
    return deltas.duplicate_view(spark, _maintained(spark, sf_dir, deltas.COPIES))


# ---- trees compared by digests -------------------------------------------------------------------------------------
_SOURCE = "SELECT concat('f/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS path, min(concat('h', CAST(l_partkey AS STRING))) AS sha256, min(l_partkey) % 9 = 0 AS blocked, l_orderkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber"
#: Of the target few files differ: some are missing, some have other contents, some aren't in the source.
_TARGET = "SELECT path, CASE WHEN l_orderkey % 5000 = 3 THEN 'x' ELSE sha256 END AS sha256 FROM {files} WHERE l_orderkey % 7000 <> 5"
_TREES = f"f AS ({_SOURCE.replace('{lineitem}', 'lineitem').replace('STRING', 'VARCHAR')}), t AS ({_TARGET.replace('{files}', 'f')})"


@query(f"""WITH {_TREES} SELECT f.path, f.sha256, f.blocked, coalesce(t.sha256, '') AS previous, CASE WHEN t.sha256 IS NULL THEN 'missing' WHEN t.sha256 = f.sha256 THEN 'matching' ELSE 'different' END AS status FROM f LEFT JOIN t USING (path)""")
def t22_parity_tree(spark, sf_dir):
    path = new_path(spark)
    source = spark.sql(_SOURCE, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    target = spark.sql(_TARGET, files=source).unionByName(source.where("l_orderkey % 900 = 1").select(F.concat(F.lit("only/"), "path").alias("path"), "sha256"))
    hash_tree.write(source.select("path", "sha256", "blocked"), f"{path}/source", depth=1)
    hash_tree.write(target, f"{path}/target", depth=1)
    return hash_tree.compare(spark, f"{path}/source", f"{path}/target")
