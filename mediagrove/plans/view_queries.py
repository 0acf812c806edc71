"""Registered queries of directory listings, source detection, publishing views, long alias chains and whole metadata files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import udf
from ..operators import bindings as B
from ..operators import coverage, detect, entries, inventory, metadata, orders, organizer, policy, profiles, publishing
from ..sources import metadata_files
from .more_queries import _sql, _t
from .queries import _CMP, _OBS, _SEL, _W, _WC, _WV, QUERIES, SQL, _catalog, _compared, _cov, _duck, _obs, _resolved, _slug, query

# ---- directory entries ----------------------------------------------------------------------------------------------
_N = "CAST(doc_id AS STRING)"
_ENTRIES = f"""SELECT concat('root', CAST(doc_id % 3 AS STRING)) AS root, CASE doc_id % 5 WHEN 0 THEN 'dir' WHEN 1 THEN 'link' ELSE 'file' END AS type, CASE doc_id % 17
  WHEN 0 THEN concat('steamapps/appmanifest_', {_N}, '.acf') WHEN 1 THEN concat('steamapps/AppManifest_', {_N}, '.ACF') WHEN 2 THEN concat('steamapps/common/appmanifest_', {_N}, '.acf')
  WHEN 3 THEN concat('Sys-', {_N}) WHEN 4 THEN concat('sys.', {_N}) WHEN 5 THEN concat('profiles/p', {_N}, '.json') WHEN 6 THEN concat('profiles/old/p', {_N}, '.json')
  WHEN 7 THEN concat('artwork/set', CAST(doc_id % 4 AS STRING), '/grid/', {_N}, '.png') WHEN 8 THEN concat('artwork/set', CAST(doc_id % 4 AS STRING), '/grid/.deck-profile-empty')
  WHEN 9 THEN concat('plans/a/', {_N}, '.json') WHEN 10 THEN 'gate-reviews/b/applied.json' WHEN 11 THEN concat('gate-reviews/', substring('abcd', CAST(doc_id % 4 AS INT) + 1, 1), '/', {_N}, '.json')
  WHEN 12 THEN concat('drafts/profile-', {_N}, '.json') WHEN 13 THEN concat('drafts/profile-a b', {_N}, '.json') WHEN 14 THEN concat('library/themes/t', CAST(CAST(floor(doc_id / 17) % 4 AS INT) AS STRING))
  WHEN 15 THEN concat('library/themes/t', CAST(CAST(floor(doc_id / 17) % 4 AS INT) AS STRING), '/theme.json') ELSE concat('drafts/x/profile-', {_N}, '.json') END AS path FROM documents"""
_E = f"WITH e AS ({_duck(_ENTRIES)})"


def _entries(spark, sf_dir):
    return _sql(spark, sf_dir, "documents", _ENTRIES)


@query(f"{_E} SELECT root, path FROM e WHERE type <> 'dir' AND regexp_matches(path, '^steamapps/(?i)appmanifest_[^/]*[.]acf$')")
def s13_app_manifests(spark, sf_dir):
    return entries.app_manifests(_entries(spark, sf_dir))


@query(f"{_E} SELECT root, lower(path) AS system, path || '/gamelist.xml' AS gamelist FROM e WHERE type = 'dir' AND path SIMILAR TO '[A-Za-z0-9_-]+'")
def s21_systems(spark, sf_dir):
    return entries.systems(_entries(spark, sf_dir))


@query(f"{_E} SELECT root, split_part(split_part(path, '/', 2), '.', 1) AS id, path FROM e WHERE type = 'file' AND path LIKE 'profiles/%.json' AND len(string_split(path, '/')) = 2")
def s22_profile_documents(spark, sf_dir):
    return entries.profile_documents(_entries(spark, sf_dir))


@query(f"{_E}, p AS (SELECT 'root' || (r_regionkey % 3) AS root, r_name AS id, CASE WHEN r_regionkey = 4 THEN '' ELSE 'set' || (r_regionkey % 4) END AS artwork FROM region) SELECT p.root, p.id, count(e.path) AS n FROM p LEFT JOIN e ON e.root = p.root AND e.type <> 'dir' AND starts_with(e.path, 'artwork/' || p.artwork || '/') AND e.path NOT LIKE '%/.deck-profile-empty' AND p.artwork <> '' GROUP BY 1, 2")
def s23_artwork_counts(spark, sf_dir):
    p = _t(spark, sf_dir, "region").select(F.expr("concat('root', CAST(r_regionkey % 3 AS STRING))").alias("root"), F.col("r_name").alias("id"), F.expr("CASE WHEN r_regionkey = 4 THEN '' ELSE concat('set', CAST(r_regionkey % 4 AS STRING)) END").alias("artwork"))
    return entries.artwork_counts(_entries(spark, sf_dir), p)


@query(f"{_E} SELECT root, CASE WHEN path LIKE 'plans/%' THEN 'plan' ELSE 'gate-' || path[14] END AS type, path FROM e WHERE type <> 'dir' AND path LIKE '%.json' AND path NOT LIKE '%/applied.json' AND (path LIKE 'plans/%' OR path[:15] IN ('gate-reviews/a/', 'gate-reviews/b/', 'gate-reviews/c/'))")
def s24_artifacts(spark, sf_dir):
    return entries.artifacts(_entries(spark, sf_dir))


@query(f"{_E} SELECT root, replace(replace(path, 'drafts/profile-', ''), '.json', '') AS id FROM e WHERE type <> 'dir' AND path LIKE 'drafts/profile-%.json' AND NOT contains(path, ' ')")
def s25_draft_ids(spark, sf_dir):
    return entries.draft_ids(_entries(spark, sf_dir))


@query(f"{_E} SELECT d.root, d.path[16:] AS id FROM e d WHERE d.type = 'dir' AND d.path LIKE 'library/themes/%' AND NOT contains(d.path[16:], '/') AND EXISTS (SELECT 1 FROM e f WHERE f.root = d.root AND f.path = d.path || '/theme.json' AND f.type <> 'dir')")
def s26_theme_ids(spark, sf_dir):
    return entries.theme_ids(_entries(spark, sf_dir))


# ---- detection ------------------------------------------------------------------------------------------------------
_PLACES = """SELECT s_suppkey AS seq, CASE s_suppkey % 4 WHEN 0 THEN 'steam-1' WHEN 1 THEN 'playnite-extra' ELSE 'gaming-profiles-home' END AS id, CASE s_suppkey % 4 WHEN 0 THEN 'steam-grid' WHEN 1 THEN 'playnite-extra' ELSE 'decky-catalog' END AS kind,
  concat('Place ', CAST(s_suppkey % 4 AS STRING)) AS name, concat(CASE WHEN s_suppkey % 3 = 0 THEN '/H/' ELSE '/h/' END, CAST(s_suppkey % 60 AS STRING)) AS path, s_nationkey % 6 <> 0 AS is_dir, concat('inode', CAST(s_suppkey % 50 AS STRING)) AS file_key FROM supplier"""
_DET = f"""pl AS ({_duck(_PLACES)}), d1 AS (SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY seq) AS a FROM pl WHERE is_dir), d2 AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY seq) AS b FROM d1 WHERE a = 1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS c FROM d2 WHERE b = 1), ro AS (SELECT 'root-' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'romm' ELSE 'steam-grid' END AS kind, '/H/' || (s_suppkey % 70) AS path FROM supplier WHERE s_suppkey % 9 = 0),
det AS (SELECT CASE WHEN c = 1 THEN id ELSE id || '-' || c END AS id, kind, name, path, least(seq % 3 * 9000, 10000) AS items, lower(path) IN (SELECT lower(path) FROM ro) AS configured FROM d3)"""


def _detected(spark, sf_dir):
    places = _sql(spark, sf_dir, "supplier", _PLACES)
    files = places.groupBy("path").agg(F.min("seq").alias("s")).select("path", (F.col("s") % 3 * 9000).alias("n"))
    roots = _t(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.expr("concat('root-', CAST(s_suppkey AS STRING))").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "romm").otherwise("steam-grid").alias("kind"), F.expr("concat('/H/', CAST(s_suppkey % 70 AS STRING))").alias("path"))
    return detect.detect(places, files, roots, fold_case=True), roots


@query(f"WITH {_DET}, n AS (SELECT path, min(seq) % 3 * 9000 AS n FROM pl GROUP BY 1) SELECT id, kind, name, path, least(n, 10000) AS items, configured, CASE WHEN configured THEN 'connected' ELSE 'detected' END AS status FROM det JOIN n USING (path)")
def s27_detect(spark, sf_dir):
    return _detected(spark, sf_dir)[0]


@query(f"""WITH {_DET} SELECT id, kind, CASE WHEN configured THEN 'connected' ELSE 'detected' END AS status FROM det
UNION ALL SELECT id, kind, 'not-on-this-device' FROM (VALUES ('supported-steam', 'steam-grid'), ('supported-playnite', 'playnite-library'), ('supported-gaming-profiles', 'decky-catalog'), ('supported-retrodeck', 'esde-media'), ('supported-romm', 'romm')) v(id, kind)
  WHERE kind NOT IN (SELECT kind FROM det UNION SELECT kind FROM ro) AND NOT (kind = 'playnite-library' AND EXISTS (SELECT 1 FROM det WHERE kind = 'playnite-extra'))
UNION ALL SELECT id, kind, 'temporarily-unavailable' FROM ro WHERE lower(path) NOT IN (SELECT lower(path) FROM det)""")
def u6_source_cards(spark, sf_dir):
    found, roots = _detected(spark, sf_dir)
    return detect.source_cards(found, roots, fold_case=True).select("id", "kind", "status")


# ---- metadata -------------------------------------------------------------------------------------------------------
_CHAINS = """SELECT concat('c', CAST(c_custkey AS STRING)) AS identity, concat('c', CAST(c_custkey + 1 AS STRING)) AS canonical FROM customer WHERE c_custkey % 21 <> 0
UNION ALL SELECT concat('s', CAST(c_custkey AS STRING)), concat('s', CAST(c_custkey - c_custkey % 11 + (c_custkey + 1) % 11 AS STRING)) FROM customer WHERE c_custkey % 33 >= 11
UNION ALL SELECT concat('t', CAST(c_custkey AS STRING)), concat('s', CAST(c_custkey AS STRING)) FROM customer"""


@query(f"""WITH RECURSIVE a AS ({_duck(_CHAINS)}), w(identity, seen, reached) AS (SELECT identity, [identity], canonical FROM a UNION ALL SELECT w.identity, list_append(w.seen, w.reached), a.canonical FROM w JOIN a ON a.identity = w.reached WHERE NOT list_contains(w.seen, w.reached)),
f AS (SELECT identity, seen, reached, row_number() OVER (PARTITION BY identity ORDER BY len(seen) DESC) AS n FROM w) SELECT identity, CASE WHEN list_contains(seen, reached) THEN identity ELSE reached END AS canonical FROM f WHERE n = 1""")
def j7_alias_chains(spark, sf_dir):
    """Chains of 1 to 20 links, circles of 11, and identities that lead into circles."""
    return metadata.closure(metadata.resolve_aliases(_sql(spark, sf_dir, "customer", _CHAINS)))


_FILES = r"""SELECT page_id AS seq, CASE WHEN page_id % 2 = 0 THEN 'manifest' ELSE 'gamelist' END AS kind, CASE page_id % 4 WHEN 1 THEN 'N64' ELSE 'snes' END AS scope,
  CASE WHEN page_id % 20 = 0 THEN '"AppState" { "appid" "7"' WHEN page_id % 2 = 0 THEN concat('// state', chr(10), 'appstate { "AppID" "', CAST(100 + page_id % 37 AS STRING), '" "Universe" "1" "name" " App \"', CAST(page_id % 11 AS STRING), '\" " "UserConfig" { "language" "x" } }')
    WHEN page_id % 30 = 15 THEN '<gameList><game><path>./cut' ELSE concat('<gameList><game><path>./Rom ', CAST(page_id % 13 AS STRING), CASE WHEN page_id % 8 = 1 THEN '!' ELSE '' END, '.zip</path><name>Name &amp; ', CAST(CASE WHEN page_id % 13 = 4 THEN page_id ELSE page_id % 13 END AS STRING), '</name></game></gameList>') END AS text FROM pages"""
_T18 = f"""f AS (SELECT page_id AS seq, page_id % 2 = 0 AS steam, CASE page_id % 4 WHEN 1 THEN 'n64' ELSE 'snes' END AS system, CASE WHEN page_id % 2 = 0 THEN page_id % 20 = 0 ELSE page_id % 30 = 15 END AS bad, 100 + page_id % 37 AS app, 'App "' || (page_id % 11) || '"' AS title,
  'Rom ' || (page_id % 13) || CASE WHEN page_id % 8 = 1 THEN '!' ELSE '' END AS stem, 'Name & ' || CASE WHEN page_id % 13 = 4 THEN page_id ELSE page_id % 13 END AS name FROM pages),
g AS (SELECT system, stem, min_by(name, seq) AS name, count(DISTINCT name) AS names, {_slug("stem")} AS base FROM f WHERE NOT steam AND NOT bad GROUP BY system, stem), h AS (SELECT *, count(*) OVER (PARTITION BY system, base) AS n FROM g)"""


def _resolved_files(spark, sf_dir):
    files = _sql(spark, sf_dir, "pages", _FILES.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")).withColumn("content", F.col("text").cast("binary"))
    return metadata.resolve_all(metadata_files.statements(files))


@query(f"""WITH {_T18} SELECT 'steam:' || app AS identity, min_by(title, seq) AS title, 'steam-manifest' AS source FROM f WHERE steam AND NOT bad GROUP BY app
UNION ALL SELECT 'retro:' || system || ':' || base || CASE WHEN n > 1 THEN '~' || sha256(stem)[:8] ELSE '' END, name, 'esde-gamelist' FROM h WHERE names = 1""")
def t18_titles(spark, sf_dir):
    """Files are read and parsed, damaged ones left out, and their statements resolved."""
    return _resolved_files(spark, sf_dir).titles


@query(f"""WITH {_T18} SELECT 'steam-manifest' AS source, 'warning' AS status, 'invalid appmanifest source' AS message FROM f WHERE steam AND bad
UNION ALL SELECT 'esde:' || system, 'unsupported', 'This system is using cleaned file names because its gamelist could not be read safely.' FROM f WHERE NOT steam AND bad
UNION ALL SELECT 'esde:' || f.system, 'needs-attention', 'Conflicting ES-DE names were kept separate.' FROM f JOIN g ON g.system = f.system AND g.stem = f.stem WHERE NOT steam AND NOT bad AND f.name <> g.name
UNION ALL SELECT 'esde:' || system, 'needs-attention', 'Similar ROM file names were kept as separate games.' FROM (SELECT DISTINCT system, base FROM h WHERE n > 1)""")
def t18_diagnostics(spark, sf_dir):
    return _resolved_files(spark, sf_dir).diagnostics


@query(SQL["t18_diagnostics"].replace("SELECT 'steam-manifest' AS source", ", q AS (SELECT 'steam-manifest' AS source", 1) + ") SELECT * FROM q ORDER BY source, status, message LIMIT 6")
def o10_first_diagnostics(spark, sf_dir):
    return orders.in_order(_resolved_files(spark, sf_dir).diagnostics, "diagnostics").limit(6)


_SAID = "SELECT CASE event_id % 5 WHEN 0 THEN 'steam-manifest' WHEN 1 THEN 'playnite' WHEN 2 THEN concat('esde:', event_type) WHEN 3 THEN 'identity' ELSE concat('romm:', event_type) END AS source, concat('event ', CAST(event_id AS STRING)) AS message FROM events"


@query(f"WITH d AS ({_duck(_SAID)}) SELECT k.kind, d.source, count(*) AS n, min(message) AS message FROM d JOIN (VALUES ('steam-grid', 'steam'), ('playnite-extra', 'playnite'), ('esde-media', 'esde')) k(kind, prefix) ON starts_with(d.source, k.prefix) GROUP BY ALL")
def w20_diagnostics(spark, sf_dir):
    said = _sql(spark, sf_dir, "events", _SAID)
    parts = [detect.diagnostics_of(said, k).select(F.lit(k).alias("kind"), "source", "message") for k in ("steam-grid", "playnite-extra", "esde-media", "romm")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))


# ---- publishing -----------------------------------------------------------------------------------------------------
@query("SELECT CAST(r_regionkey AS VARCHAR) || '-' || p AS id, r_name || ' · ' || CASE p WHEN 'steam' THEN 'Steam' ELSE p END AS name, CAST(r_regionkey AS VARCHAR) AS device, p AS platform, CASE p WHEN 'steam' THEN 'steam' ELSE '' END AS adapter FROM region, (VALUES ('steam'), ('retro')) v(p) WHERE p = 'steam' OR r_regionkey < 3")
def s30_default_targets(spark, sf_dir):
    devices = _t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.when(F.col("r_regionkey") < 3, F.array(F.lit("steam"), F.lit("retro"))).otherwise(F.array(F.lit("steam"))).alias("platforms"))
    return publishing.default_targets(devices, spark.createDataFrame([("steam", "Steam")], "id string, name string"))


_REQUESTS = "SELECT c_custkey AS request, concat('k', CAST(c_custkey % 7 AS STRING)) AS profile, concat('t', CAST(c_nationkey % 6 AS STRING)) AS target FROM customer"


@query(f"""WITH r AS ({_duck(_REQUESTS)}), t(seq, target, platform) AS (VALUES (0, 't0', 'steam'), (1, 't1', 'retro'), (2, 't2', 'steam'), (3, 't0', 'retro'), (4, 't3', 'steam')), p(seq, key, platform, artwork) AS (VALUES (0, 'k0', 'steam', 'a0'), (1, 'k1', 'retro', 'a1'), (2, 'k2', 'steam', ''), (3, 'k1', 'steam', 'a3')),
tt AS (SELECT target, max_by(platform, seq) AS platform FROM t GROUP BY 1), pp AS (SELECT key, min_by(platform, seq) AS platform, min_by(artwork, seq) AS artwork FROM p GROUP BY 1)
SELECT request, CASE WHEN tt.platform = pp.platform THEN artwork ELSE '' END AS artwork, CASE WHEN tt.target IS NULL THEN 'unknown frontend target' WHEN pp.key IS NULL THEN 'unknown platform profile' WHEN tt.platform <> pp.platform THEN 'profile and frontend platforms must match' ELSE '' END AS problem
FROM r LEFT JOIN tt ON tt.target = r.target LEFT JOIN pp ON pp.key = r.profile""")
def j25_selections(spark, sf_dir):
    targets = spark.createDataFrame([(0, "t0", "steam"), (1, "t1", "retro"), (2, "t2", "steam"), (3, "t0", "retro"), (4, "t3", "steam")], "seq int, id string, platform string")
    declared = spark.createDataFrame([(0, "k0", "steam", "a0"), (1, "k1", "retro", "a1"), (2, "k2", "steam", ""), (3, "k1", "steam", "a3")], "seq int, key string, platform string, artwork string")
    return publishing.selections(_sql(spark, sf_dir, "customer", _REQUESTS), targets, declared)


@query(f"WITH {_CMP} SELECT path, CASE WHEN blocked THEN 'Excluded: blocked' ELSE CASE status WHEN 'matching' THEN 'Keep matching file' WHEN 'different' THEN 'Back up and replace' ELSE 'Add copy' END END AS label, CASE WHEN previous = '' THEN 'Absent / not observed' ELSE previous END AS now, sha256 FROM c")
def p30_file_labels(spark, sf_dir):
    return publishing.file_labels(_compared(spark, sf_dir).withColumn("reason", F.lit("blocked")))


_RECEIPTS = "SELECT l_orderkey AS receipt, concat('f', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING)) AS path, concat('h', CAST(l_suppkey AS STRING)) AS sha256, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('p', CAST(l_suppkey AS STRING)) END AS previous, l_partkey, l_linenumber FROM lineitem"
_THERE = "SELECT path, min(CASE l_partkey % 3 WHEN 0 THEN sha256 WHEN 1 THEN CASE WHEN previous = '' THEN 'x' ELSE previous END ELSE 'drifted' END) AS sha256 FROM r WHERE l_partkey % 5 <> 0 GROUP BY path"


@query(f"""WITH r AS ({_duck(_RECEIPTS)}), n AS ({_THERE}), o AS (SELECT r.*, coalesce(n.sha256, '') AS expected FROM r LEFT JOIN n ON n.path = r.path WHERE l_linenumber <> 2),
a AS (SELECT *, CASE WHEN previous = '' AND expected <> '' THEN 'retain' WHEN previous = '' THEN 'none' WHEN expected IN (sha256, previous) THEN 'copy' ELSE 'blocked' END AS action FROM o)
SELECT receipt, path, action, expected, CASE action WHEN 'blocked' THEN 'published file drifted; rollback will not overwrite it' ELSE '' END AS problem FROM a""")
def j21_rollback(spark, sf_dir):
    files = _sql(spark, sf_dir, "lineitem", _RECEIPTS)
    now = spark.sql(_THERE.replace("FROM r", "FROM {r}"), r=files)
    return publishing.rollback(files, files.where("l_linenumber <> 2"), now)


@query("SELECT 'd' || o_orderkey AS digest, 't' || (o_custkey % 3) AS target, CASE o_orderstatus WHEN 'O' THEN 'published' ELSE 'rolled-back' END AS state, CAST(o_orderkey % 4 AS INT) AS prepared, o_orderstatus = 'O' AS can_roll_back FROM orders WHERE o_custkey % 5 = 2")
def w23_profile_receipts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").selectExpr("concat('d', CAST(o_orderkey AS STRING)) AS digest", "concat('profile', CAST(o_custkey % 5 AS STRING)) AS profile", "concat('t', CAST(o_custkey % 3 AS STRING)) AS target", "CASE o_orderstatus WHEN 'O' THEN 'published' ELSE 'rolled-back' END AS state", "array_repeat('f', CAST(o_orderkey % 4 AS INT)) AS prepared")
    return publishing.profile_receipts(o, "profile2")


@query(f"""{_W}, once AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY seq) = 1), q AS (SELECT CASE WHEN seq % 10 = 0 THEN 'unknown' || seq ELSE observation_id END AS id, seq FROM once), n AS (SELECT seq, root_id, observation_id, mime, path, CASE seq % 7 WHEN 0 THEN 'link' WHEN 1 THEN 'dir' ELSE 'file' END AS type, CASE WHEN seq % 11 = 0 THEN 67108865 ELSE 67108864 END AS size, seq % 13 = 0 AS linked, seq % 6 <> 0 AS there FROM once)
SELECT q.id, CASE WHEN n.seq IS NULL OR root_id = 'src1' OR NOT there THEN 'not-found' WHEN type = 'file' AND size <= 67108864 AND NOT linked THEN 'ok' ELSE 'unsafe' END AS outcome,
  coalesce(n.seq IS NOT NULL AND root_id <> 'src1' AND there AND type = 'file' AND size <= 67108864 AND NOT linked AND mime LIKE 'image/%', false) AS preview,
  CASE WHEN root_id <> 'src1' AND there AND type = 'file' AND size <= 67108864 AND NOT linked THEN CASE mime WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/x-icon' THEN 'ico' ELSE split_part(mime, '/', 2) END ELSE '' END AS download
FROM q LEFT JOIN n ON n.observation_id = q.id""")
def w21_media(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    obs = obs.join(obs.groupBy("observation_id").agg(F.min("seq").alias("seq")), ["observation_id", "seq"])  # a snapshot holds a path once
    asked = obs.select(F.when(F.col("seq") % 10 == 0, F.concat(F.lit("unknown"), F.col("seq").cast("string"))).otherwise(F.col("observation_id")).alias("id"))
    there = obs.where("seq % 6 <> 0").select("root_id", "path", F.expr("CASE seq % 7 WHEN 0 THEN 'link' WHEN 1 THEN 'dir' ELSE 'file' END").alias("type"), F.expr("CASE WHEN seq % 11 = 0 THEN 67108865 ELSE 67108864 END").alias("size"), F.expr("seq % 13 = 0").alias("linked"))
    return publishing.media(asked, obs, obs.where("root_id <> 'src1'").select("root_id"), there)


@query(f"""WITH {_SEL}, p AS (SELECT DISTINCT profile FROM sel), t AS (SELECT DISTINCT profile FROM sel WHERE steam <> '' AND role IN ('grid', 'portrait', 'hero', 'logo', 'icon'))
SELECT profile, '{{"version":1,"id":"' || trim(regexp_replace(lower(profile), '[^a-z0-9]+', '-', 'g'), '-') || '","name":"' || profile || '","description":"","artwork":"' || trim(regexp_replace(lower(profile), '[^a-z0-9]+', '-', 'g'), '-') || '","mods":[]}}' AS document, profile IN (SELECT profile FROM t) AS has_grid_artwork FROM p""")
def p27_profile_documents(spark, sf_dir):
    sel = B.selected(spark, sf_dir)
    own = sel.select("profile").distinct().select("profile", F.col("profile").alias("name"), F.lit("").alias("description"), F.lit(None).cast("array<string>").alias("mods"))
    return publishing.profile_documents(own, profiles.export_plan("decky", sel))


@query(f"""{_WC}, i AS (SELECT observation_id, canonical, original FROM k2) SELECT observation_id, array_to_string(list_sort(list_filter([CASE WHEN contains(original, ':') THEN original END,
  CASE WHEN contains(canonical, ':') AND split_part(canonical, ':', 1) <> split_part(original, ':', 1) THEN canonical END], lambda x: x IS NOT NULL)), ',') AS identities FROM i""")
def p16_identities(spark, sf_dir):
    a = _catalog(spark, sf_dir).assets.select("observation_id", publishing.identities(F.col("canonical"), F.col("original")).alias("m"))
    shown = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))
    return a.select("observation_id", F.array_join(F.array_sort(shown), ",").alias("identities"))


@query(f"{_WV} SELECT key, game, title FROM pgm WHERE contains(lower(title), 'er')")
def w18_search_games(spark, sf_dir):
    return publishing.search_games(coverage.profile_games(*_cov(spark, sf_dir)[:3]), " ER").select("key", "game", "title")


@query(f"{_WV}, t AS (SELECT d.key, d.platform FROM d WHERE d.key NOT IN (SELECT key FROM pgm)), u AS (SELECT DISTINCT artwork_set, gg.platform FROM h JOIN gg ON gg.game = h.game WHERE artwork_set NOT IN (SELECT artwork FROM decl)) SELECT DISTINCT artwork_set, key FROM u JOIN t USING (platform)")
def w19_assignable(spark, sf_dir):
    games, held, declared, _ = _cov(spark, sf_dir)
    return publishing.assignable(coverage.unbound(games, held, declared), coverage.profile_totals(games, held, declared))


@query(f"{_WV}, r AS (SELECT key, role, count(*) AS n FROM (SELECT key, unnest(string_split(roles, ',')) AS role FROM pgm) GROUP BY ALL), kk AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, role) AS place FROM r) SELECT key, CAST(place AS INT) AS place, role, n FROM kk WHERE place <= 6")
def o17_card_roles(spark, sf_dir):
    return publishing.card_roles(coverage.profile_roles(*_cov(spark, sf_dir)[:3]))


@query(f"WITH {_OBS}, s AS (SELECT DISTINCT artwork_set FROM obs WHERE artwork_set <> ''), p(seq, key, artwork) AS (VALUES (0, 'steam/a', 'set1'), (1, 'steam/b', 'set1'), (2, 'retro/c', 'set3'), (3, 'retro/d', '')) SELECT artwork_set, min_by(key, seq) AS key FROM s LEFT JOIN p ON p.artwork = s.artwork_set GROUP BY 1")
def j27_profile_of_set(spark, sf_dir):
    sets = _obs(spark, sf_dir).select(S.artwork_set(F.col("root_kind"), F.col("path")).alias("artwork_set")).distinct()
    declared = spark.createDataFrame([(0, "steam/a", "set1"), (1, "steam/b", "set1"), (2, "retro/c", "set3"), (3, "retro/d", "")], "seq int, key string, artwork string")
    return publishing.profile_of_set(sets, declared)


# ---- rows of observations -------------------------------------------------------------------------------------------
@query(f"{_WC} SELECT observation_id, game, arole AS role, CASE WHEN width < 1 OR height < 1 THEN '' ELSE printf('%.2f:1', CAST(width AS DOUBLE) / height) END AS aspect, shared_copies FROM a")
def p10_asset_rows(spark, sf_dir):
    return organizer.asset_rows(_catalog(spark, sf_dir).assets).select("observation_id", "game", "role", "aspect", "shared_copies")


@query(f"{_W} SELECT seq, observation_id, path FROM obs WHERE observation_id = (SELECT sha256(root_id || chr(0) || path) FROM raw WHERE seq = 17) LIMIT 1")
def w15_point_lookup(spark, sf_dir):
    raw = B.observed(spark, sf_dir).where("seq = 17").select("root_id", "path").first()
    return inventory.point_lookup(_obs(spark, sf_dir), S.observation_id(F.lit(raw.root_id), F.lit(raw.path))).select("seq", "observation_id", "path")


@query(f"{_W}, h AS (SELECT root_id, role AS key, count(*) AS n FROM obs WHERE role <> '' GROUP BY ALL) SELECT root_id, string_agg(key || '=' || n, ',' ORDER BY key) AS roles FROM h GROUP BY 1")
def a2_histograms(spark, sf_dir):
    shown = F.array_join(F.transform(F.map_entries("role"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return inventory.histograms(_obs(spark, sf_dir), "role").select("root_id", shown.alias("roles"))


@query(f"WITH {_SEL} SELECT profile, game_id, steam, role, any_value(sha256) AS sha256, any_value(extension) AS extension FROM sel GROUP BY ALL")
def f36_flatten(spark, sf_dir):
    sel = B.selected(spark, sf_dir)
    asset = F.struct("sha256", "extension")
    one = sel.groupBy("profile", "game_id", "steam", "retro_system", "retro_stem").agg(F.map_from_entries(F.collect_list(F.struct("role", asset.alias("a")))).alias("assets"))
    games = one.select("profile", F.struct(F.col("game_id").alias("id"), F.create_map(F.lit("steam"), F.col("steam")).alias("identities"), F.struct(F.col("retro_system").alias("system"), F.col("retro_stem").alias("stem")).alias("retro"), "assets").alias("g"))
    nested = games.groupBy(F.col("profile").alias("name")).agg(F.collect_list("g").alias("games"))
    return profiles.flatten(nested).select("profile", "game_id", "steam", "role", "sha256", "extension")


@query("SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'a/c' WHEN 1 THEN '/b' WHEN 2 THEN '.' WHEN 3 THEN '../x' ELSE 'p' || p_partkey END AS path FROM part")
def f14_cleaned(spark, sf_dir):
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'a//b/../c/.' WHEN 1 THEN '//a/../b/' WHEN 2 THEN '' WHEN 3 THEN 'a/../../x' ELSE concat('./p', CAST(p_partkey AS STRING)) END")
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), udf.cleaned(raw).alias("path"))


@query(f"""{_W}, r AS (SELECT observation_id AS id, identity_hint, identity_hint <> '' AS mapped FROM obs) SELECT id, mapped, identity_hint FROM r""")
def t14_identity_view(spark, sf_dir):
    return inventory.identity_view(_obs(spark, sf_dir))


@query(f"""{_W}, r AS (SELECT sha256(observation_id || chr(31) || identity_hint || chr(31) || (identity_hint <> '')) AS h FROM obs), p AS (SELECT h[:3] AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM r GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM p""")
def t14_identity_digest(spark, sf_dir):
    return inventory.rows_digest(inventory.identity_view(_obs(spark, sf_dir)))


def _first(rows, document, most=100):
    """The first rows of a document with their places."""
    order = orders.ORDERS[document]
    place = F.row_number().over(Window.orderBy(*order))
    return orders.in_order(rows, document).limit(most).select(*order).withColumn("place", place.cast("long"))


def _first_sql(document, table):
    order = ", ".join(orders.ORDERS[document])
    return f"kk AS (SELECT {order}, row_number() OVER (ORDER BY {order}) AS place FROM {table}) SELECT * FROM kk WHERE place <= 100"


@query(f"WITH {_CMP}, {_first_sql('files', 'c')}")
def o12_first_files(spark, sf_dir):
    return _first(_compared(spark, sf_dir), "files")


@query(f"WITH pp AS ({SQL['t9_identity_proposals'].split(' ORDER BY canonical_id')[0]}), {_first_sql('proposals', 'pp')}")
def o3_first_proposals(spark, sf_dir):
    return _first(inventory.proposals(_obs(spark, sf_dir)), "proposals")


@query(f"WITH pp AS ({SQL['t3_import_plan'].split(' ORDER BY destination_root')[0]}), {_first_sql('import plan', 'pp')}")
def o4_first_actions(spark, sf_dir):
    return _first(policy.import_plan(_resolved(spark, sf_dir)), "import plan")


@query(f"WITH pp AS ({SQL['t17_history']}), {_first_sql('history', 'pp')}")
def o9_first_history(spark, sf_dir):
    return _first(QUERIES["t17_history"](spark, sf_dir), "history")


@query(f"{_WV}, kk AS (SELECT key, game, row_number() OVER (PARTITION BY key ORDER BY lower(title), game) AS place FROM pgm) SELECT key, game, place FROM kk")
def o6_ordered_games(spark, sf_dir):
    return coverage.ordered_games(coverage.profile_games(*_cov(spark, sf_dir)[:3])).select("key", "game", F.col("place").cast("long").alias("place"))

