"""Registered queries of the catalog operators, each with the same result written independently for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import bindings as B
from ..operators import coverage, inventory, listing, metadata, orders, organizer, parity, policy, profiles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _joined(c):
    return F.array_join(c, ",")


# ---- the oracle's own derivation of roles, systems and identities -------------------------------------------------
_RAW = f"raw AS ({B.ORACLE_OBSERVED})"
_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
_DIRS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.ROLE_OF_DIRECTORY.items()) + "}"
_SYS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.SYSTEM_NAMES.items()) + "}"
_MIMES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.MIME_OF_EXTENSION.items()) + "}"


def _sysname(x: str) -> str:
    words = f"trim(regexp_replace(lower(trim({x})), '[\\s._-]+', ' ', 'g'))"
    caps = f"array_to_string(list_transform(string_split({words}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    return f"coalesce({_SYS}[lower(trim({x}))], CASE WHEN {words} = '' THEN 'Other' ELSE {caps} END)"


def _slug(x: str, empty: str = "item") -> str:
    s = f"trim(regexp_replace(lower(trim({x})), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"CASE WHEN {s} = '' THEN '{empty}' ELSE {s} END"


def _clean(x: str) -> str:
    c = f"trim(regexp_replace(trim(regexp_replace(trim({x}), '(\\s*[\\(\\[][^\\(\\)\\[\\]]*[\\)\\]]\\s*)+$', '')), '[\\s._-]+', ' ', 'g'))"
    return f"CASE WHEN {c} = '' THEN 'Untitled game' ELSE {c} END"


_OBS = f"""{_RAW},
o1 AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM raw),
o2 AS (SELECT *, CASE WHEN regexp_matches(name, '^\\.[^.]*$') THEN '' ELSE lower(regexp_extract(name, '\\.([^.]*)$', 1)) END AS extension,
         regexp_replace(name, '\\.[^.]*$', '') AS stem, CASE WHEN len(parts) > 1 THEN lower(parts[-2]) ELSE '.' END AS dir,
         root_kind IN ('steam-grid', 'decky-catalog') OR contains(lower(path), '/grid/') AS grid FROM o1),
o3 AS (SELECT *, CASE WHEN extension = '' THEN lower(name) ELSE lower(stem) END AS low, extension IN ('png', 'jpg', 'jpeg', 'webp', 'ico') AS img,
         CASE WHEN configured_system <> '' THEN configured_system WHEN root_kind = 'esde-media' AND len(parts) >= 3 THEN lower(parts[1]) ELSE '' END AS system,
         list_filter(parts[:-2], lambda p: regexp_matches(p, '{_UUID}')) AS folders, list_filter(parts, lambda p: regexp_matches(p, '{_UUID}')) AS guids FROM o2),
obs AS (SELECT *, coalesce({_DIRS}[dir], CASE WHEN low = 'logo' THEN 'logo' WHEN low IN ('videotrailer', 'videomicrotrailer') THEN 'video' END,
           CASE WHEN root_kind = 'playnite-library' AND img AND regexp_matches(low, '{_UUID}') THEN 'cover' END,
           CASE WHEN img AND grid AND regexp_matches(low, '^[0-9]+$') THEN 'grid' WHEN img AND grid AND regexp_matches(low, '^[0-9]+p$') THEN 'portrait'
                WHEN img AND grid AND regexp_matches(low, '^[0-9]+_(hero|logo|icon)$') THEN regexp_extract(low, '_(.*)$', 1) END, '') AS role,
         CASE WHEN grid AND regexp_matches(lower(stem), '^[0-9]+(p|_hero|_logo|_icon)?$') THEN 'steam:' || regexp_extract(stem, '^[0-9]+')
              WHEN root_kind = 'playnite-library' AND len(folders) > 0 THEN 'playnite:' || lower(folders[-1])
              WHEN root_kind = 'playnite-library' AND len(parts) = 1 AND regexp_matches(stem, '{_UUID}') THEN 'playnite:' || lower(stem)
              WHEN len(guids) > 0 THEN 'playnite:' || lower(guids[1])
              WHEN root_kind = 'esde-media' AND system <> '' THEN 'retro:' || system || ':' || {_slug("stem")} ELSE '' END AS identity_hint,
         CASE WHEN width = 0 OR height = 0 THEN '' ELSE width || 'x' || height END AS dimensions,
         sha256(root_id || chr(0) || path) AS observation_id,
         CASE WHEN root_kind = 'decky-catalog' AND len(parts) >= 3 AND parts[1] = 'artwork' AND name <> '.deck-profile-empty' THEN parts[2] ELSE '' END AS artwork_set FROM o3)"""
_ISSUES = f"""issues AS (
SELECT seq, root_id, path, 'role-media-mismatch' AS code, CASE role WHEN 'manual' THEN 'manual must be PDF, got ' || mime WHEN 'video' THEN 'video role has non-video MIME ' || mime ELSE role || ' role has non-image MIME ' || mime END AS message
  FROM obs WHERE (role = 'manual' AND mime <> 'application/pdf') OR (role = 'video' AND mime NOT LIKE 'video/%') OR (role NOT IN ('', 'manual', 'video') AND mime NOT LIKE 'image/%')
UNION ALL
SELECT seq, root_id, path, 'media-type-mismatch', CASE WHEN mime <> {_MIMES}[extension] THEN '.' || extension || ' content has MIME ' || mime || ', expected ' || {_MIMES}[extension] ELSE '.' || extension || ' image dimensions could not be decoded' END
  FROM obs WHERE {_MIMES}[extension] IS NOT NULL AND (mime <> {_MIMES}[extension] OR (extension IN ('png', 'jpg', 'jpeg', 'gif') AND (width < 1 OR height < 1))))"""
_W = f"WITH {_OBS}"
_WI = f"WITH {_OBS}, {_ISSUES}"


def _obs(spark, sf_dir):
    return inventory.observations(B.observed(spark, sf_dir))


# ---- projections ---------------------------------------------------------------------------------------------------
@query(f"{_W} SELECT seq, observation_id, extension, role, system, identity_hint, dimensions, artwork_set FROM obs")
def p_observations(spark, sf_dir):
    return _obs(spark, sf_dir).select("seq", "observation_id", "extension", "role", "system", "identity_hint", "dimensions", S.artwork_set(F.col("root_kind"), F.col("path")).alias("artwork_set"))


@query(f"""{_W}, s AS (SELECT *, trim(regexp_replace(lower(stem), '[^a-z0-9._-]', '-', 'g'), '-') AS kept FROM obs)
SELECT seq, {_slug("stem")} AS slug, trim(regexp_replace(lower(trim(stem)), '[^a-z0-9]+', '-', 'g'), '-') AS plain_slug,
  CASE WHEN kept = '' THEN 'item' ELSE kept END || '--' || sha256(stem)[:12] AS safe_key, {_clean("stem")} AS title, {_sysname("system")} AS system_name,
  CASE WHEN strlen(stem) > 8 THEN stem[:8] || '…' ELSE stem END AS short_id, 'library/assets/sha256/' || sha256[:2] || '/' || sha256 || '/content.' || CASE WHEN extension = '' THEN 'bin' ELSE extension END AS asset_path,
  CASE root_kind WHEN 'steam-grid' THEN 'Steam custom artwork' WHEN 'playnite-library' THEN 'Playnite library' WHEN 'playnite-extra' THEN 'Playnite ExtraMetadata' WHEN 'decky-catalog' THEN 'Deck Gaming Profiles' WHEN 'esde-media' THEN 'RetroDECK / ES-DE' ELSE 'RomM' END AS source_name,
  'retro:' || system || ':' || {_slug("stem")} || '~' || sha256(stem)[:8] AS disambiguated FROM s""")
def f_names(spark, sf_dir):
    stem = S.stem(F.col("path"))
    return _obs(spark, sf_dir).select(
        "seq", S.slug(stem).alias("slug"), S.slug(stem, "").alias("plain_slug"), S.safe_path_key(stem).alias("safe_key"), S.clean_title(stem).alias("title"), S.system_name(F.col("system")).alias("system_name"),
        S.short_id(stem).alias("short_id"), S.asset_path(F.col("sha256"), F.col("extension")).alias("asset_path"), S.source_name(F.col("root_kind")).alias("source_name"), S.disambiguated(F.col("system"), stem).alias("disambiguated"),
    )


@query("""SELECT event_id, CASE WHEN n > 0 THEN CAST(p * 100 // n AS BIGINT) END AS percent, CASE WHEN w <= 320 THEN w ELSE greatest(1, w * 320 // w) END AS fit_w,
  CASE WHEN w <= 320 THEN h ELSE greatest(1, h * 320 // w) END AS fit_h, CASE WHEN a < 60 THEN a || 's ago' WHEN a < 3600 THEN a // 60 || 'm ago' WHEN a < 86400 THEN a // 3600 || 'h ago' ELSE a // 86400 || 'd ago' END AS age,
  (n - 1) * w AS excess FROM (SELECT event_id, event_id % 7 + 1 AS n, event_id % 5 AS p, 100 + event_id % 900 AS w, CAST(50 + event_id % 50 AS BIGINT) AS h, event_id * 37 % 200000 AS a FROM events)""")
def f_numbers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "event_id % 7 + 1 AS n", "event_id % 5 AS p", "100 + event_id % 900 AS w", "50 + event_id % 50 AS h", "event_id * 37 % 200000 AS a")
    w, h = S.scaled(F.col("w"), F.col("h"))
    return e.select("event_id", S.percent(F.col("p"), F.col("n")).alias("percent"), w.alias("fit_w"), h.alias("fit_h"), S.human_age(F.col("a")).alias("age"), ((F.col("n") - 1) * F.col("w")).alias("excess"))


@query(f"{_W} SELECT seq, regexp_matches(root_id, '^[a-z0-9][a-z0-9._-]*$') AS id_ok, path NOT LIKE '/%' AND NOT contains(path, '..') AND path <> '' AS path_ok, length(sha256) = 64 AS sha_ok FROM obs")
def w_predicates(spark, sf_dir):
    return _obs(spark, sf_dir).select("seq", S.safe_id(F.col("root_id")).alias("id_ok"), S.safe_relative_path(F.col("path")).alias("path_ok"), S.sha256_text(F.col("sha256")).alias("sha_ok"))


# ---- inventory ------------------------------------------------------------------------------------------------------
@query(f"{_WI} SELECT * FROM issues")
def w_issues(spark, sf_dir):
    return inventory.issues(_obs(spark, sf_dir))


@query(f"{_W} SELECT root_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE mime LIKE 'image/%' OR mime LIKE 'video/%' OR mime = 'application/pdf') AS media_count, count(*) FILTER (WHERE mime LIKE 'image/%') AS image_count FROM obs GROUP BY root_id")
def a1_root_summary(spark, sf_dir):
    return inventory.root_summary(_obs(spark, sf_dir))


def _histogram(column):
    @query(f"{_W} SELECT root_id, {column} AS key, count(*) AS n FROM obs WHERE {column} <> '' GROUP BY ALL")
    def f(spark, sf_dir):
        return inventory.histogram(_obs(spark, sf_dir), column)

    return f


for _c in ("extension", "role", "dimensions"):
    QUERIES[f"a2_histogram_{_c}"] = _histogram(_c)
    SQL[f"a2_histogram_{_c}"] = SQL.pop("f")
    QUERIES.pop("f")


@query(f"""{_W}, g AS (SELECT sha256, count(*) AS n, min(size) AS size, count(DISTINCT root_id) AS roots FROM obs GROUP BY sha256)
SELECT count(*) FILTER (WHERE n > 1) AS groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS copies, CAST(coalesce(sum((n - 1) * size) FILTER (WHERE n > 1), 0) AS BIGINT) AS excess_bytes,
  count(*) FILTER (WHERE n > 1 AND roots > 1) AS cross_root_groups, count(*) AS unique_hashes FROM g""")
def a3_duplicate_summary(spark, sf_dir):
    return inventory.duplicate_summary(_obs(spark, sf_dir))


@query(f"{_W}, g AS (SELECT sha256, min(size) AS size, count(*) AS copies, count(DISTINCT root_id) AS roots FROM obs GROUP BY sha256 HAVING count(*) > 1) SELECT g.*, root_id, path FROM obs JOIN g USING (sha256)")
def a4_duplicate_groups(spark, sf_dir):
    return inventory.duplicate_occurrences(_obs(spark, sf_dir))


@query(f"""{_W}, g AS (SELECT sha256, min(size) AS size, count(*) AS copies, count(*) FILTER (WHERE root_kind IN ('steam-grid', 'esde-media', 'decky-catalog')) AS k FROM obs GROUP BY sha256 HAVING count(*) > 1)
SELECT sha256, size, copies, CASE WHEN k = 0 THEN 'canonical-opportunity' WHEN k = copies THEN 'review' ELSE 'expected-copy' END AS classification FROM g""")
def a5_duplicate_view(spark, sf_dir):
    return inventory.duplicate_view(_obs(spark, sf_dir))


@query(f"""{_W} SELECT root_id, path, identity_hint AS canonical_id, CASE split_part(identity_hint, ':', 1) WHEN 'steam' THEN 'steam-appid' WHEN 'playnite' THEN 'playnite-adapter' ELSE 'retro-filename-alias' END AS mapping_type,
  CASE WHEN identity_hint LIKE 'retro:%' THEN 'proposal' ELSE 'high' END AS confidence, CASE WHEN identity_hint LIKE 'retro:%' THEN 'ROM stem is a mutable alias; content hash is required for release identity' ELSE 'deterministic source convention' END AS reason
  FROM obs WHERE identity_hint <> '' ORDER BY canonical_id, root_id, path""")
def t9_identity_proposals(spark, sf_dir):
    return inventory.proposals(_obs(spark, sf_dir))


@query(f"{_W} SELECT root_id, path, 'no deterministic identity in source path' AS reason FROM obs WHERE identity_hint = '' ORDER BY root_id, path")
def t9_unmapped(spark, sf_dir):
    return inventory.unmapped(_obs(spark, sf_dir))


@query(f"""{_WI} SELECT o.root_id, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE mime LIKE 'image/%' OR mime LIKE 'video/%' OR mime = 'application/pdf') AS media_count,
  count(*) FILTER (WHERE mime LIKE 'image/%') AS image_count, (SELECT count(*) FROM issues i WHERE i.root_id = o.root_id) AS issue_count FROM obs o GROUP BY o.root_id ORDER BY 1""")
def t13_overview(spark, sf_dir):
    obs = _obs(spark, sf_dir)
    return inventory.overview(obs, inventory.issues(obs))


@query(f"{_WI} SELECT root_id, '' AS path, code, count(*) AS n FROM issues GROUP BY root_id, code")
def t28_sanitized_issues(spark, sf_dir):
    return inventory.sanitized_issues(inventory.issues(_obs(spark, sf_dir)))


# ---- policy ---------------------------------------------------------------------------------------------------------
_VALUES = ", ".join(f"({k}, " + ", ".join(f"'{x}'" for x in r) + ")" for k, r in enumerate(B.RULES))
_MODE = f"""rules(rule, source, system, role, sha256, mode) AS (VALUES {_VALUES}),
ranked AS (SELECT o.*, r.mode AS won, r.rule, row_number() OVER (PARTITION BY o.seq ORDER BY (CASE WHEN r.source <> '' THEN 1 ELSE 0 END + CASE WHEN r.system <> '' THEN 2 ELSE 0 END + CASE WHEN r.role <> '' THEN 4 ELSE 0 END + CASE WHEN r.sha256 <> '' THEN 8 ELSE 0 END) DESC, r.rule) AS rn
  FROM obs o LEFT JOIN rules r ON r.source IN ('', o.root_id) AND r.system IN ('', o.system) AND r.role IN ('', o.role) AND r.sha256 IN ('', o.sha256)),
moded AS (SELECT * EXCLUDE (won, rule, rn), coalesce(won, '{B.DEFAULT_MODE}') AS mode, CAST(coalesce(rule, -1) AS INT) AS matched_rule FROM ranked WHERE rn = 1)"""


def _resolved(spark, sf_dir):
    return policy.resolve(_obs(spark, sf_dir), B.rules(spark), B.DEFAULT_MODE)


@query(f"{_W}, {_MODE} SELECT seq, mode, matched_rule FROM moded")
def j1_policy(spark, sf_dir):
    return _resolved(spark, sf_dir).select("seq", "mode", "matched_rule")


@query(f"{_W}, {_MODE} SELECT mode, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM moded GROUP BY mode")
def t12_policy_impact(spark, sf_dir):
    return policy.impact(_resolved(spark, sf_dir))


@query(f"""{_W}, {_MODE} SELECT CASE mode WHEN 'managed' THEN 'copy' WHEN 'quarantined' THEN 'quarantine' ELSE 'skip' END AS action, root_id AS source_root, path AS source_path, sha256 AS source_sha256, size AS source_size,
  CASE WHEN mode IN ('managed', 'quarantined') THEN 'catalog' ELSE '' END AS destination_root,
  CASE mode WHEN 'managed' THEN 'library/assets/sha256/' || sha256[:2] || '/' || sha256 || '/content.' || CASE WHEN extension = '' THEN 'bin' ELSE extension END WHEN 'quarantined' THEN 'state/quarantine/policy/' || sha256 ELSE '' END AS destination_path,
  CASE WHEN mode IN ('managed', 'quarantined') THEN 'absent-or-same-hash' ELSE '' END AS expected_destination,
  CASE mode WHEN 'managed' THEN 'policy resolves asset to managed canonical storage' WHEN 'tracked-external' THEN 'asset remains tracked at its external source' WHEN 'promote-on-approval' THEN 'asset promotion requires separate explicit approval' ELSE 'policy requires quarantine' END AS reason,
  identity_hint, role, system, '' AS unsafe FROM moded ORDER BY destination_root, destination_path, source_root, source_path""")
def t3_import_plan(spark, sf_dir):
    return policy.import_plan(_resolved(spark, sf_dir))


# ---- listing --------------------------------------------------------------------------------------------------------
_SEL = f"sel AS ({B.ORACLE_SELECTED})"
_LIST = f"""{_SEL}, th AS (SELECT sha256, string_agg(DISTINCT theme, ',' ORDER BY theme) AS themes FROM sel WHERE theme <> '' GROUP BY sha256),
ic AS (SELECT root_id, path, string_agg(code, ',' ORDER BY code) AS issue_codes FROM issues GROUP BY ALL),
listed AS (SELECT m.root_id, m.path, m.size, m.sha256, m.role, m.system, m.identity_hint, m.dimensions, m.mode, m.matched_rule, coalesce(th.themes, '') AS themes, coalesce(ic.issue_codes, '') AS issue_codes
  FROM moded m LEFT JOIN th USING (sha256) LEFT JOIN ic ON ic.root_id = m.root_id AND ic.path = m.path)"""


def _listing(spark, sf_dir, **filters):
    obs = _obs(spark, sf_dir)
    out = listing.listing(obs, B.selected(spark, sf_dir), inventory.issues(obs), B.rules(spark), B.DEFAULT_MODE, **filters)
    return out.withColumns({"themes": _joined("themes"), "issue_codes": _joined("issue_codes")})


@query(f"{_WI}, {_MODE}, {_LIST} SELECT * FROM listed")
def t10_listing(spark, sf_dir):
    return _listing(spark, sf_dir)


_FILTERS = {
    "source": ({"source": "src0"}, "root_id = 'src0'"), "system": ({"system": "n64"}, "system = 'n64'"), "identity_prefix": ({"identity": "steam:"}, "identity_hint LIKE 'steam:%'"),
    "identity": ({"identity": "steam:120"}, "identity_hint = 'steam:120'"), "role_outcome": ({"role": "logo", "outcome": "managed"}, "role = 'logo' AND mode = 'managed'"),
    "theme": ({"theme": "dark"}, "contains(themes, 'dark')"), "issues": ({"validation": "issues"}, "issue_codes <> ''"), "clean": ({"validation": "clean", "dimensions": "300x330"}, "issue_codes = '' AND dimensions = '300x330'"),
}
for _n, (_given, _where) in _FILTERS.items():
    QUERIES[f"w1_filter_{_n}"] = lambda spark, sf_dir, given=_given: _listing(spark, sf_dir, **given)
    SQL[f"w1_filter_{_n}"] = f"{_WI}, {_MODE}, {_LIST} SELECT * FROM listed WHERE {_where}"


@query(f"{_WI}, {_MODE}, {_LIST} SELECT * FROM listed ORDER BY root_id, path, sha256 LIMIT 50 OFFSET 100")
def o13_page(spark, sf_dir):
    return listing.page(_listing(spark, sf_dir), 3, 50)


@query(f"{_W} SELECT count(*) AS total FROM obs WHERE role = 'cover'")
def t10_total(spark, sf_dir):
    return listing.total(_listing(spark, sf_dir, role="cover"))


# ---- metadata -------------------------------------------------------------------------------------------------------
_G = B._GAME.replace("doc_id", "page_id")
_TITLES = f"""SELECT page_id AS seq, CASE page_id % 3 WHEN 0 THEN concat(' steam:', CAST(100 + page_id % 50 AS STRING), ' ') WHEN 1 THEN concat('playnite:', lower({_G})) ELSE concat('retro:n64:example-game-', CAST(page_id % 25 AS STRING)) END AS identity,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE page_id % 5 WHEN 0 THEN 'steam-appinfo' WHEN 1 THEN 'steam-manifest' WHEN 2 THEN 'steam-shortcut' WHEN 3 THEN 'playnite' ELSE 'other' END AS source FROM pages"""
_ALIASES = """SELECT concat('steam:', CAST(100 + page_id % 20 AS STRING)) AS identity, concat('steam:', CAST(CASE WHEN page_id % 40 = 23 THEN 999 ELSE 120 + page_id % 20 END AS STRING)) AS canonical FROM pages WHERE page_id % 20 < 15
UNION ALL SELECT 'steam:125', 'steam:139' UNION ALL SELECT 'steam:136', 'steam:137' UNION ALL SELECT 'steam:137', 'steam:136'"""
_STORES = f"SELECT page_id AS seq, concat('playnite:', lower({_G})) AS identity, CASE page_id % 3 WHEN 0 THEN 'Steam' WHEN 1 THEN '' ELSE 'Other library' END AS store FROM pages"
_LISTS = "SELECT page_id AS seq, CASE page_id % 2 WHEN 0 THEN 'n64' ELSE 'snes' END AS system, concat('Game ', CAST(page_id % 30 AS STRING), CASE page_id % 4 WHEN 0 THEN '!' ELSE '' END) AS raw_stem, concat('Name ', CAST(CASE WHEN page_id % 30 = 7 THEN page_id ELSE page_id % 30 END AS STRING)) AS name FROM pages"


def _pages(spark, sf_dir, *sqls):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = [spark.sql(sql.replace("FROM pages", "FROM {pages}"), pages=pages) for sql in sqls]
    return out if len(out) > 1 else out[0]


def _meta(spark, sf_dir):
    aliases, titles, stores = _pages(spark, sf_dir, _ALIASES, _TITLES, _STORES)
    return metadata.resolve_aliases(aliases), metadata.resolve_titles(titles), metadata.resolve_stores(stores)


def _duck(sql):
    return sql.replace("AS STRING", "AS VARCHAR")


_META = f"""al0 AS ({_duck(_ALIASES)}), al AS (SELECT identity, CASE WHEN count(DISTINCT canonical) = 1 THEN min(canonical) END AS canonical, count(DISTINCT canonical) > 1 AS ambiguous FROM al0 WHERE identity <> canonical GROUP BY identity),
ti0 AS ({_duck(_TITLES)}), ti AS (SELECT identity, title, source FROM (SELECT trim(identity) AS identity, trim(title) AS title, source, row_number() OVER (PARTITION BY trim(identity) ORDER BY CASE source WHEN 'steam-appinfo' THEN 10 WHEN 'steam-manifest' THEN 20 WHEN 'steam-shortcut' THEN 30 WHEN 'playnite' THEN 40 ELSE 100 END, seq) AS rn FROM ti0 WHERE trim(title) <> '') WHERE rn = 1),
st0 AS ({_duck(_STORES)}), st AS (SELECT identity, store FROM (SELECT identity, store, row_number() OVER (PARTITION BY identity ORDER BY seq) AS rn FROM st0 WHERE store <> '') WHERE rn = 1)"""


@query(f"WITH {_META} SELECT * FROM al")
def a22_aliases(spark, sf_dir):
    return _meta(spark, sf_dir)[0]


@query(f"WITH {_META} SELECT * FROM ti")
def a23_titles(spark, sf_dir):
    return _meta(spark, sf_dir)[1]


@query(f"WITH {_META} SELECT * FROM st")
def a25_stores(spark, sf_dir):
    return _meta(spark, sf_dir)[2]


@query(f"""WITH {_META}, ids AS (SELECT DISTINCT identity FROM al0 UNION SELECT DISTINCT canonical FROM al0 UNION SELECT identity FROM ti),
c AS (SELECT i.identity, coalesce(b.canonical, a.canonical, i.identity) AS canonical FROM ids i LEFT JOIN al a ON a.identity = i.identity LEFT JOIN al b ON b.identity = a.canonical)
SELECT c.identity, c.canonical, coalesce(t.title, o.title) AS title FROM c LEFT JOIN ti t ON t.identity = c.canonical LEFT JOIN ti o ON o.identity = c.identity""")
def j8_display_titles(spark, sf_dir):
    aliases, titles, _ = _meta(spark, sf_dir)
    raw = _pages(spark, sf_dir, _ALIASES)
    ids = raw.select("identity").union(raw.select("canonical")).union(titles.select("identity")).distinct()
    return metadata.display_titles(ids, aliases, titles)


@query(f"""WITH g AS ({_duck(_LISTS)}), p AS (SELECT system, raw_stem, min(name) AS name, count(DISTINCT name) AS names, 'retro:' || system || ':' || {_slug("raw_stem")} AS base FROM g GROUP BY system, raw_stem),
q AS (SELECT *, count(*) OVER (PARTITION BY base) AS n FROM p) SELECT CASE WHEN n > 1 THEN base || '~' || sha256(raw_stem)[:8] ELSE base END AS identity, name AS title FROM q WHERE names = 1""")
def a26_gamelist_titles(spark, sf_dir):
    return metadata.gamelist_titles(_pages(spark, sf_dir, _LISTS))


@query("SELECT app_id, title FROM (SELECT page_id % 40 AS app_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, row_number() OVER (PARTITION BY page_id % 40 ORDER BY page_id % 3, page_id) AS rn FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> '') WHERE rn = 1")
def a24_first_titles(spark, sf_dir):
    return metadata.first_titles(_pages(spark, sf_dir, "SELECT page_id % 40 AS app_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, page_id % 3 AS source_rank, page_id AS seq FROM pages"))


@query(f"""WITH g AS (SELECT {_duck(_G)} AS guid, page_id % 4 AS p, CASE page_id % 3 WHEN 0 THEN CAST(page_id AS VARCHAR) WHEN 1 THEN 'x' ELSE '4294967296' END AS game_id FROM pages)
SELECT 'playnite:' || lower(guid) AS identity, 'steam:' || game_id AS canonical FROM g WHERE p = 1 AND regexp_matches(game_id, '^[0-9]+$') AND CAST(game_id AS BIGINT) BETWEEN 1 AND 4294967295""")
def j26_library_aliases(spark, sf_dir):
    games = _pages(spark, sf_dir, f"SELECT {_G} AS guid, CASE page_id % 4 WHEN 1 THEN 'AA-BB' ELSE 'cc' END AS plugin, CASE page_id % 3 WHEN 0 THEN CAST(page_id AS STRING) WHEN 1 THEN 'x' ELSE '4294967296' END AS game_id FROM pages")
    return metadata.library_aliases(games, "aa-bb")


# ---- organizer ------------------------------------------------------------------------------------------------------
_CAT = f"""{_SEL}, {_META},
pid AS (SELECT *, CASE WHEN game_id LIKE 'steam:%' OR game_id LIKE 'playnite:%' THEN game_id WHEN steam <> '' THEN 'steam:' || steam WHEN playnite <> '' THEN 'playnite:' || lower(playnite) ELSE game_id END AS own_game,
   CASE WHEN game_id LIKE 'steam:%' OR steam <> '' THEN 'steam' WHEN game_id LIKE 'playnite:%' OR playnite <> '' THEN 'playnite' ELSE 'retro:' || retro_system END AS own_platform,
   CASE WHEN game_id LIKE 'steam:%' THEN 'Steam app ' || game_id[7:] WHEN game_id LIKE 'playnite:%' THEN 'Playnite game ' || game_id[10:] WHEN steam <> '' THEN 'Steam app ' || steam ELSE {_clean("retro_stem")} END AS own_title FROM sel),
ix AS (SELECT split_part(own_game, ':', 1) AS ns, sha256, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profiles FROM pid GROUP BY ALL),
al2 AS (SELECT a.identity, coalesce(b.canonical, a.canonical) AS canonical FROM al a LEFT JOIN al b ON b.identity = a.canonical WHERE a.canonical IS NOT NULL),
col AS (SELECT identity_hint FROM obs WHERE identity_hint LIKE 'retro:%' GROUP BY 1 HAVING count(DISTINCT stem) > 1),
e AS (SELECT o.*, count(*) OVER (PARTITION BY o.sha256) AS shared_copies, root_kind = 'esde-media' AND system <> '' AND lower(stem) IN (system, 'system', 'platform', 'console') AS is_platform, o.identity_hint IN (SELECT identity_hint FROM col) AS collides FROM obs o),
k1 AS (SELECT *, CASE WHEN collides THEN 'retro:' || split_part(identity_hint, ':', 2) || ':' || {_slug("stem")} || '~' || sha256(stem)[:8] ELSE identity_hint END AS original FROM e WHERE NOT is_platform),
k2 AS (SELECT k1.*, coalesce(al2.canonical, original) AS canonical, coalesce(t1.title, t2.title) AS known, coalesce(al.ambiguous, false) AS doubt, st.store FROM k1 LEFT JOIN al2 ON al2.identity = original LEFT JOIN al ON al.identity = original
   LEFT JOIN ti t1 ON t1.identity = coalesce(al2.canonical, original) LEFT JOIN ti t2 ON t2.identity = original LEFT JOIN st ON st.identity = original),
k AS (SELECT *, CASE WHEN original = '' THEN 'unmapped:' || observation_id WHEN split_part(canonical, ':', 1) = split_part(original, ':', 1) THEN canonical ELSE original END AS game, CASE WHEN role = '' THEN 'other' ELSE role END AS arole FROM k2),
a AS (SELECT *, CASE WHEN known IS NOT NULL THEN known WHEN game LIKE 'steam:%' THEN 'Steam app ' || game[7:] WHEN game LIKE 'playnite:%' THEN 'Playnite game ' || CASE WHEN length(game) > 17 THEN game[10:17] || '…' ELSE game[10:] END ELSE {_clean("stem")} END AS title,
   CASE WHEN game LIKE 'steam:%' THEN 'steam' WHEN game LIKE 'playnite:%' THEN 'playnite' WHEN game LIKE 'retro:%' THEN 'retro:' || split_part(game, ':', 2) WHEN root_kind IN ('steam-grid', 'decky-catalog') THEN 'steam' WHEN system <> '' THEN 'system:' || system ELSE 'other' END AS platform,
   original = '' OR collides OR doubt AS attention FROM k),
pr AS (SELECT p.*, coalesce(al2.canonical, own_game) AS canonical, coalesce(t1.title, t2.title) AS known FROM pid p LEFT JOIN al2 ON al2.identity = own_game LEFT JOIN ti t1 ON t1.identity = coalesce(al2.canonical, own_game) LEFT JOIN ti t2 ON t2.identity = own_game),
pg AS (SELECT * FROM (SELECT CASE WHEN split_part(canonical, ':', 1) = split_part(own_game, ':', 1) THEN canonical ELSE own_game END AS game, coalesce(known, own_title) AS title, own_platform AS platform, row_number() OVER (PARTITION BY CASE WHEN split_part(canonical, ':', 1) = split_part(own_game, ':', 1) THEN canonical ELSE own_game END ORDER BY profile, game_id) AS rn FROM pr) WHERE rn = 1),
og AS (SELECT game, min_by(platform, seq) AS platform, min_by(title, seq) AS title, min_by(attention, seq) AS attention, coalesce(min_by(store, seq) FILTER (WHERE store IS NOT NULL), '') AS store, count(*) AS n, list(DISTINCT arole) AS roles FROM a GROUP BY game),
g0 AS (SELECT coalesce(pg.game, og.game) AS game, coalesce(pg.platform, og.platform) AS platform, coalesce(pg.title, og.title) AS title, CASE WHEN pg.game IS NOT NULL THEN false ELSE og.attention END AS attention, coalesce(og.store, '') AS store, coalesce(n, 0) AS assets,
   list_filter({S.EXPECTED_ROLES}, lambda r: NOT list_contains(coalesce(og.roles, []), r)) AS missing FROM pg FULL JOIN og ON og.game = pg.game),
ident AS (SELECT DISTINCT game, split_part(original, ':', 1) AS ns, original[position(':' IN original) + 1:] AS v FROM a WHERE contains(original, ':') UNION SELECT game, split_part(game, ':', 1), game[position(':' IN game) + 1:] FROM g0 WHERE contains(game, ':') AND game NOT LIKE 'unmapped:%'),
gp AS (SELECT DISTINCT g.game, p.profile FROM g0 g JOIN pid p ON p.own_platform = g.platform WHERE p.game_id = g.game OR EXISTS (SELECT 1 FROM ident i WHERE i.game = g.game AND ((i.ns = 'steam' AND p.steam <> '' AND i.v = p.steam) OR (i.ns = 'playnite' AND p.playnite <> '' AND i.v = p.playnite) OR (i.ns = 'romm' AND p.romm <> '' AND i.v = p.romm)))),
g AS (SELECT g0.*, CASE WHEN platform = 'steam' THEN 'Steam' WHEN platform = 'playnite' THEN 'Playnite' WHEN platform LIKE 'retro:%' OR platform LIKE 'system:%' THEN {_sysname("split_part(platform, ':', 2)")} ELSE 'Other' END AS platform_name,
   CASE WHEN platform = 'steam' THEN list_filter(['grid', 'portrait', 'hero', 'logo', 'icon'], lambda r: list_contains(missing, r)) WHEN platform = 'playnite' THEN list_filter(['cover', 'logo', 'icon'], lambda r: list_contains(missing, r)) WHEN game LIKE 'retro:%' THEN list_filter(['cover', 'marquee', 'screenshot', 'miximage', 'video'], lambda r: list_contains(missing, r)) ELSE [] END AS fb FROM g0)"""
_WC = f"WITH {_OBS}, {_CAT}"


def _catalog(spark, sf_dir):
    return organizer.build(_obs(spark, sf_dir), B.selected(spark, sf_dir), *_meta(spark, sf_dir))


@query(f"""{_WC} SELECT g.game, platform, title, attention, store, assets, array_to_string(missing, ',') AS missing_roles, platform_name, CASE WHEN len(fb) = 0 THEN '' WHEN platform = 'steam' THEN 'Steam' WHEN platform = 'playnite' THEN 'Playnite' ELSE 'ES-DE' END AS fallback_frontend,
  array_to_string(fb, ',') AS fallback_roles, coalesce(p.profiles, '') AS profiles FROM g LEFT JOIN (SELECT game, string_agg(profile, ',' ORDER BY profile) AS profiles FROM gp GROUP BY game) p ON p.game = g.game""")
def t1_games(spark, sf_dir):
    return _catalog(spark, sf_dir).games.withColumns({c: _joined(c) for c in ("missing_roles", "fallback_roles", "profiles")})


@query(f"""{_WC} SELECT observation_id, game, a.sha256, arole AS role, width, height, mime, extension, size, root_id, shared_copies, coalesce(ix.profiles, '') AS profiles, artwork_set, root_id || ':' || path AS location FROM a LEFT JOIN ix ON ix.ns = split_part(a.identity_hint, ':', 1) AND ix.sha256 = a.sha256""")
def t1_assets(spark, sf_dir):
    out = _catalog(spark, sf_dir).assets
    return out.select("observation_id", "game", "sha256", "role", "width", "height", "mime", "extension", "size", "root_id", "shared_copies", _joined("profiles").alias("profiles"), "artwork_set", "location")


@query(f"{_WC} SELECT platform, platform_name, count(*) AS games, CAST(sum(assets) AS BIGINT) AS artwork, count(*) FILTER (WHERE assets = 0) AS without_art, CAST((count(*) - count(*) FILTER (WHERE assets = 0)) * 100 // count(*) AS BIGINT) AS coverage FROM g GROUP BY ALL")
def t1_platforms(spark, sf_dir):
    return _catalog(spark, sf_dir).platforms


@query(f"{_WC} SELECT observation_id, 'retro:' || lower(system) AS platform FROM e WHERE is_platform")
def w12_platform_assets(spark, sf_dir):
    return _catalog(spark, sf_dir).platform_assets.select("observation_id", "platform")


@query(f"{_WC}, r AS (SELECT platform, observation_id, row_number() OVER (PARTITION BY platform ORDER BY game, arole, observation_id) AS n FROM a WHERE arole IN ('portrait', 'cover', 'grid', 'miximage', 'hero')) SELECT platform, CAST(n AS INT) AS n, observation_id FROM r WHERE n <= 4")
def x2_previews(spark, sf_dir):
    return organizer.previews(_catalog(spark, sf_dir).assets)


@query(f"{_WC} SELECT game, min_by(observation_id, (CASE WHEN arole IN ('portrait', 'cover', 'grid', 'miximage') THEN 0 ELSE 1 END) || arole || ' ' || observation_id) AS observation_id FROM a GROUP BY game")
def o18_representative(spark, sf_dir):
    return organizer.representative(_catalog(spark, sf_dir).assets)


@query(f"{_WC} SELECT g.game, title FROM g WHERE platform = 'steam' AND contains(lower(title), 'an') AND assets > 0 AND EXISTS (SELECT 1 FROM a WHERE a.game = g.game AND arole = 'grid') ORDER BY title, game")
def w17_visible_games(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    return organizer.visible_games(c.games, c.assets, platform="steam", text="AN", art="has-art", role="grid").select("game", "title")


@query(f"{_WC} SELECT game, len(missing) AS n FROM g ORDER BY len(missing) DESC, title, game LIMIT 20")
def o16_by_missing(spark, sf_dir):
    """The games that lack most roles."""
    c = _catalog(spark, sf_dir)
    return organizer.visible_games(c.games, c.assets, by_missing=True).limit(20).select("game", F.size("missing_roles").cast("long").alias("n"))


@query(f"{_WC} SELECT DISTINCT platform_name, platform FROM g ORDER BY platform_name, platform LIMIT 4")
def o5_first_platforms(spark, sf_dir):
    return orders.in_order(organizer.platforms(_catalog(spark, sf_dir).games), "platforms").limit(4).select("platform_name", "platform")


@query(f"{_WC} SELECT platform_name, title, game FROM g ORDER BY platform_name, title, game LIMIT 30")
def o5_first_games(spark, sf_dir):
    return orders.in_order(_catalog(spark, sf_dir).games, "games").limit(30).select("platform_name", "title", "game")


@query(f"{_WC} SELECT count(*) FILTER (WHERE attention) AS needs_attention, count(*) AS games FROM g")
def a10_attention(spark, sf_dir):
    return _catalog(spark, sf_dir).games.agg(F.count_if("attention").alias("needs_attention"), F.count(F.lit(1)).alias("games"))


# ---- coverage -------------------------------------------------------------------------------------------------------
_DECL = """SELECT concat('Set ', r_name) AS name, CASE r_regionkey % 3 WHEN 0 THEN 'steam' WHEN 1 THEN 'playnite' ELSE 'retro' END AS platform, CASE WHEN r_regionkey < 3 THEN concat('set', CAST(r_regionkey AS STRING)) ELSE '' END AS artwork FROM region
UNION ALL SELECT 'Steam All', 'steam', 'set3'"""
_COV = f"""decl AS ({_duck(_DECL)}), d AS (SELECT *, platform || '/' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM decl),
h AS (SELECT artwork_set, game, string_agg(DISTINCT arole, ',' ORDER BY arole) AS roles, count(*) AS n FROM a WHERE artwork_set <> '' GROUP BY ALL),
gg AS (SELECT game, title, CASE WHEN platform LIKE 'retro:%' THEN 'retro' ELSE platform END AS platform FROM g),
pgm AS (SELECT d.key, h.game, gg.title, h.roles, h.n FROM d JOIN h ON h.artwork_set = d.artwork AND d.artwork <> '' JOIN gg ON gg.game = h.game AND gg.platform = d.platform)"""
_WV = f"{_WC}, {_COV}"


def _cov(spark, sf_dir):
    c = _catalog(spark, sf_dir)
    decl = spark.sql(_DECL.replace("FROM region", "FROM {region}"), region=spark.read.parquet(f"{sf_dir}/region.parquet"))
    return c.games, coverage.held(c.assets), decl, c.assets


@query(f"{_WV} SELECT * FROM pgm")
def t2_profile_games(spark, sf_dir):
    return coverage.profile_games(*_cov(spark, sf_dir)[:3]).withColumn("roles", _joined("roles"))


@query(f"{_WV} SELECT d.key, d.name, d.platform, d.artwork, count(p.game) AS games, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS assets, count(p.game) = 0 AS empty FROM d LEFT JOIN pgm p ON p.key = d.key GROUP BY ALL")
def t2_profile_totals(spark, sf_dir):
    return coverage.profile_totals(*_cov(spark, sf_dir)[:3])


@query(f"{_WV} SELECT key, role, count(*) AS n FROM (SELECT key, unnest(string_split(roles, ',')) AS role FROM pgm) GROUP BY ALL")
def a13_profile_roles(spark, sf_dir):
    return coverage.profile_roles(*_cov(spark, sf_dir)[:3])


@query(f"{_WV} SELECT artwork_set, count(*) AS games, CAST(sum(n) AS BIGINT) AS assets, string_agg(DISTINCT gg.platform, ',' ORDER BY gg.platform) AS platforms FROM h LEFT JOIN gg ON gg.game = h.game WHERE artwork_set NOT IN (SELECT artwork FROM decl) GROUP BY 1")
def a14_unbound(spark, sf_dir):
    return coverage.unbound(*_cov(spark, sf_dir)[:3]).withColumn("platforms", _joined("platforms"))


@query(f"{_WV} SELECT gg.game, d.key, h.n IS NOT NULL AS covered, coalesce(h.n, 0) AS assets, coalesce(h.roles, '') AS roles FROM gg JOIN d ON d.platform = gg.platform LEFT JOIN h ON h.artwork_set = d.artwork AND h.game = gg.game")
def t2_game_profiles(spark, sf_dir):
    return coverage.game_profiles(*_cov(spark, sf_dir)[:3]).withColumn("roles", _joined("roles"))


@query(f"{_WV} SELECT gg.game, count(d.key) AS relevant, count(h.n) AS covered FROM gg LEFT JOIN d ON d.platform = gg.platform LEFT JOIN h ON h.artwork_set = d.artwork AND h.game = gg.game GROUP BY 1")
def a16_covered_counts(spark, sf_dir):
    return coverage.covered_counts(*_cov(spark, sf_dir)[:3])


@query(f"{_WC} SELECT root_id, root_kind, count(*) AS assets, count(DISTINCT game) AS games FROM a WHERE artwork_set = '' AND root_kind <> 'decky-catalog' GROUP BY ALL")
def a15_surfaces(spark, sf_dir):
    return coverage.surfaces(_cov(spark, sf_dir)[3]).drop("source_name")


@query("SELECT r_name AS platform, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS devices FROM nation JOIN region ON r_regionkey IN (n_regionkey, n_nationkey % 5) GROUP BY 1")
def j12_devices(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    both = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")
    also = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_nationkey") % 5).select("n_nationkey", "n_name", "r_name")
    devices = both.union(also).groupBy(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).agg(F.collect_set("r_name").alias("platforms"))
    text = F.array_join(F.transform("devices", lambda d: F.concat(d["id"].cast("string"), F.lit(":"), d["name"])), ",")
    return coverage.devices_of(devices).withColumn("devices", text)


# ---- profiles -------------------------------------------------------------------------------------------------------
_STORE = "store AS (SELECT 'library/assets/sha256/' || sha256[:2] || '/' || sha256 || '/content.' || extension AS path, CASE WHEN ascii(sha256) % 7 = 0 THEN 'damaged' ELSE sha256 END AS sha256 FROM (SELECT DISTINCT sha256, extension FROM sel) WHERE ascii(sha256[2]) % 5 <> 0)"
_RES = f"WITH {_SEL}, {_STORE}, res AS (SELECT s.profile, game_id, role, s.sha256, extension, c AS canonical_path, CASE WHEN t.sha256 IS NULL THEN 'managed content is absent' WHEN t.sha256 <> s.sha256 THEN 'managed content SHA-256 does not match profile lock' ELSE '' END AS issue FROM (SELECT *, 'library/assets/sha256/' || sha256[:2] || '/' || sha256 || '/content.' || extension AS c FROM sel) s LEFT JOIN store t ON t.path = s.c)"


def _resolution(spark, sf_dir):
    sel = B.selected(spark, sf_dir)
    store = sel.select("sha256", "extension").distinct().where(F.ascii(F.substring("sha256", 2, 1)) % 5 != 0)
    store = store.select(S.asset_path(F.col("sha256"), F.col("extension")).alias("path"), F.when(F.ascii("sha256") % 7 == 0, "damaged").otherwise(F.col("sha256")).alias("sha256"))
    return profiles.resolve(sel, store)


@query(f"{_RES} SELECT *, issue = '' AS available FROM res")
def t6_resolve(spark, sf_dir):
    return _resolution(spark, sf_dir)


@query(f"{_RES} SELECT profile, bool_and(issue = '') AS complete, count(*) AS assets, count(*) FILTER (WHERE issue <> '') AS missing FROM res GROUP BY 1")
def a28_completeness(spark, sf_dir):
    return profiles.completeness(_resolution(spark, sf_dir))


@query(f"""{_RES}, k AS (SELECT *, trim(regexp_replace(lower(game_id), '[^a-z0-9._-]', '-', 'g'), '-') || '--' || sha256(game_id)[:12] AS gk, trim(regexp_replace(lower(profile), '[^a-z0-9]+', '-', 'g'), '-') AS pid FROM res)
SELECT profile, CASE WHEN issue = '' THEN 'copy' ELSE 'blocked' END AS action, canonical_path AS source_path, 'bundles/' || pid || '/r1/assets/' || gk || '/' || role || '.' || extension AS destination_path,
  CASE WHEN issue = '' THEN 'materialize retained profile bundle asset' ELSE 'canonical asset is unavailable; promotion is required before bundle build' END AS reason FROM k
UNION ALL SELECT DISTINCT profile, 'render', '', 'bundles/' || pid || '/r1/bundle.lock.json', 'write deterministic bundle lock after all assets verify' FROM k""")
def t7_bundle_plan(spark, sf_dir):
    res = _resolution(spark, sf_dir)
    revisions = res.select("profile").distinct().select("profile", S.slug(F.col("profile")).alias("profile_id"), F.lit("r1").alias("revision"))
    return profiles.bundle_plan(res, revisions)


_TAKES = {
    "steam": ("steam <> '' AND role IN ('grid', 'portrait', 'hero', 'logo', 'icon')", "steam || CASE role WHEN 'grid' THEN '' WHEN 'portrait' THEN 'p' ELSE '_' || role END || '.' || extension", "extension IN ('png', 'jpg') OR (role = 'icon' AND extension = 'ico')"),
    "playnite": ("playnite <> '' AND role IN ('logo', 'video')", "'games/' || lower(playnite) || '/' || CASE role WHEN 'logo' THEN 'Logo.png' ELSE 'VideoTrailer.mp4' END", "(role = 'logo' AND extension = 'png') OR (role = 'video' AND extension = 'mp4')"),
    "esde": ("retro_stem <> '' AND role IN ('cover', 'fanart', 'manual', 'marquee', 'miximage', 'physicalmedia', 'screenshot', 'titlescreen', 'video')", "retro_system || '/' || CASE role WHEN 'fanart' THEN 'fanart' ELSE role || 's' END || '/' || retro_stem || '.' || extension", "CASE role WHEN 'manual' THEN extension = 'pdf' WHEN 'video' THEN extension = 'mp4' ELSE extension IN ('png', 'jpg') END"),
    "romm": ("romm <> '' AND role IN ('manual', 'screenshot', 'cover')", "'api/roms/' || romm || '/' || role", "CASE role WHEN 'manual' THEN extension = 'pdf' ELSE extension IN ('png', 'jpg') END"),
}
_PID = "trim(regexp_replace(lower(profile), '[^a-z0-9]+', '-', 'g'), '-')"
_TAKES["decky"] = (_TAKES["steam"][0], f"'artwork/' || {_PID} || '/grid/' || " + _TAKES["steam"][1], _TAKES["steam"][2])
for _a, (_takes, _path, _fits) in _TAKES.items():
    QUERIES[f"t8_export_{_a}"] = lambda spark, sf_dir, adapter=_a: profiles.export_plan(adapter, B.selected(spark, sf_dir))
    SQL[f"t8_export_{_a}"] = f"""WITH {_SEL} SELECT profile, 'copy' AS action, 'library/assets/sha256/' || sha256[:2] || '/' || sha256 || '/content.' || extension AS source_path, sha256, {_path} AS destination_path, game_id, role,
  CASE WHEN {_fits} THEN '' ELSE '{_a} adapter does not support .' || extension || ' for role ' || role || '; create a derived canonical asset first' END AS problem FROM sel WHERE {_takes}""" + (
        f""" UNION ALL SELECT DISTINCT profile, 'render', '', '', 'profiles/' || {_PID} || '.json', '', '', '' FROM sel
  UNION ALL SELECT profile, 'render', '', '', 'artwork/' || any_value({_PID}) || '/grid/.deck-profile-empty', '', '', '' FROM sel GROUP BY profile HAVING count(*) FILTER (WHERE {_takes}) = 0""" if _a == "decky" else ""
    )


# ---- plans and parity -----------------------------------------------------------------------------------------------
_ACT = """SELECT concat('root', CAST(l_suppkey % 4 AS STRING)) AS destination_root, CASE WHEN l_partkey % 10 = 0 THEN '' ELSE concat('p/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END AS destination_path,
  CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'copy' END AS action, concat('h', CAST(l_partkey AS STRING)) AS source_sha256, CAST(l_quantity AS BIGINT) AS source_size, l_orderkey, l_linenumber, l_partkey FROM lineitem"""
_NOW = "SELECT DISTINCT destination_root AS root, destination_path AS path, CASE WHEN l_partkey % 3 = 0 THEN 'changed' ELSE source_sha256 END AS sha256, source_size + 1 AS size, CASE l_partkey % 7 WHEN 0 THEN 'link' WHEN 1 THEN 'other' ELSE 'file' END AS type FROM act WHERE l_orderkey % 2 = 0 AND destination_path <> ''"
_AN = f"""act AS ({_duck(_ACT)}), now AS ({_NOW}), an AS (SELECT act.*, n.sha256 AS nh, n.size AS ns, n.type AS nt, CASE WHEN destination_path = '' THEN 'no-filesystem-change' WHEN destination_root = 'root3' THEN 'root-unavailable' WHEN action = 'remove' AND n.type IS NULL THEN 'no-filesystem-change' WHEN action = 'remove' THEN 'would-remove' WHEN n.type IS NULL THEN 'create' WHEN n.type = 'file' AND n.sha256 = source_sha256 THEN 'replace-same-hash' ELSE 'conflict' END AS effect
  FROM act LEFT JOIN now n ON n.root = destination_root AND n.path = destination_path)"""
_BYTES = "CASE WHEN effect IN ('create', 'conflict') THEN source_size ELSE 0 END AS new_bytes, CASE WHEN effect = 'conflict' AND nt = 'file' THEN ns ELSE 0 END AS backup_bytes, CASE WHEN effect = 'would-remove' AND nt = 'file' THEN ns ELSE 0 END AS freed_bytes"


def _analysis(spark, sf_dir):
    act = spark.sql(_ACT.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    now = spark.sql(_NOW.replace("FROM act", "FROM {act}"), act=act)
    return parity.analyze(act, spark.createDataFrame([(f"root{k}",) for k in range(3)], "root string"), now)


@query(f"""WITH {_AN} SELECT l_orderkey, l_linenumber, effect, effect IN ('conflict', 'root-unavailable') AS conflict, CASE WHEN effect = 'root-unavailable' THEN 'destination root "' || destination_root || '" is not configured' WHEN effect = 'conflict' AND nt = 'link' THEN 'destination is a symlink'
  WHEN effect = 'conflict' AND nt <> 'file' THEN 'destination exists and is not a regular file' WHEN effect = 'conflict' THEN 'destination exists with content that differs from the plan' ELSE '' END AS conflict_reason, {_BYTES} FROM an""")
def t15_analysis(spark, sf_dir):
    return _analysis(spark, sf_dir).select("l_orderkey", "l_linenumber", "effect", "conflict", "conflict_reason", "new_bytes", "backup_bytes", "freed_bytes")


@query(f"WITH {_AN}, b AS (SELECT *, {_BYTES} FROM an) SELECT count(*) FILTER (WHERE effect IN ('conflict', 'root-unavailable')) AS conflicts, CAST(sum(new_bytes) AS BIGINT) AS new_bytes, CAST(sum(backup_bytes) AS BIGINT) AS backup_bytes, CAST(sum(freed_bytes) AS BIGINT) AS freed_bytes FROM b")
def a18_totals(spark, sf_dir):
    return parity.analysis_totals(_analysis(spark, sf_dir))


@query(f"WITH {_AN}, b AS (SELECT *, {_BYTES} FROM an WHERE destination_path <> '' AND effect <> 'root-unavailable') SELECT destination_root AS root, CAST(sum(new_bytes) AS BIGINT) AS needed, CASE WHEN destination_root = 'root1' THEN 100 ELSE 500000 END AS available, sum(new_bytes) <= CASE WHEN destination_root = 'root1' THEN 100 ELSE 500000 END AS sufficient FROM b GROUP BY 1")
def a18_space(spark, sf_dir):
    return parity.destination_space(_analysis(spark, sf_dir), spark.createDataFrame([("root0", 500000), ("root1", 100), ("root2", 500000)], "root string, available int"))


_FILES = "SELECT concat('f/', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS path, concat('h', CAST(l_partkey AS STRING)) AS sha256, l_partkey % 9 = 0 AS blocked, l_orderkey, l_partkey FROM lineitem"
_CMP = f"f AS ({_duck(_FILES)}), t AS (SELECT path, CASE WHEN l_partkey % 4 = 0 THEN 'x' ELSE sha256 END AS previous FROM f WHERE l_orderkey % 3 <> 0), c AS (SELECT f.path, f.sha256, f.blocked, coalesce(t.previous, '') AS previous, CASE WHEN t.previous IS NULL THEN 'missing' WHEN t.previous = f.sha256 THEN 'matching' ELSE 'different' END AS status FROM f LEFT JOIN t ON t.path = f.path)"


def _compared(spark, sf_dir):
    files = spark.sql(_FILES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    target = files.where("l_orderkey % 3 <> 0").select("path", F.expr("CASE WHEN l_partkey % 4 = 0 THEN 'x' ELSE sha256 END").alias("sha256"))
    return parity.compare(files.select("path", "sha256", "blocked"), target)


@query(f"WITH {_CMP} SELECT * FROM c")
def t22_parity(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"WITH {_CMP} SELECT count(*) AS files, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}, count(*) FILTER (WHERE status = '{s}' AND NOT blocked) AS publishable_{s}" for s in parity.STATUSES) + ", count(*) FILTER (WHERE NOT blocked) AS publishable, count(*) FILTER (WHERE blocked) AS blocked FROM c")
def a17_counts(spark, sf_dir):
    return parity.counts(_compared(spark, sf_dir))


@query(f"WITH {_CMP} SELECT bool_and(blocked OR status = 'matching') AS all_match FROM c")
def w22_all_published(spark, sf_dir):
    return parity.all_published(_compared(spark, sf_dir))


@query(f"""{_WI}, b AS (SELECT root_id, path, max(message) AS issue FROM issues GROUP BY ALL), r AS (SELECT o.*, b.issue, CASE WHEN NOT (identity_hint LIKE 'steam:%' AND role IN ('grid', 'portrait', 'hero', 'logo', 'icon')) THEN 'unsupported or unidentified file; the artwork adapter does not copy layout metadata'
  WHEN b.issue IS NOT NULL THEN b.issue WHEN NOT (extension IN ('png', 'jpg', 'jpeg') OR (role = 'icon' AND extension = 'ico')) THEN 'steam adapter does not support .' || extension || ' for role ' || role || '; create a derived canonical asset first' ELSE '' END AS problem FROM obs o LEFT JOIN b ON b.root_id = o.root_id AND b.path = o.path WHERE artwork_set <> ''),
v AS (SELECT *, role IN ('grid', 'portrait', 'hero', 'logo', 'icon') AND count(*) OVER (PARTITION BY artwork_set, CASE WHEN role IN ('grid', 'portrait', 'hero', 'logo', 'icon') THEN lower(stem) END) > 1 AS many FROM r)
SELECT artwork_set AS profile, CASE WHEN many OR problem <> '' THEN 'blocked' ELSE 'copy' END AS action, sha256, size, name AS destination_path, role, CASE WHEN many THEN 'multiple filename variants for one Steam artwork role; choose an explicit asset before publishing' ELSE problem END AS reason FROM v""")
def t21_artwork_actions(spark, sf_dir):
    obs = _obs(spark, sf_dir).withColumn("artwork_set", S.artwork_set(F.col("root_kind"), F.col("path")))
    return parity.artwork_actions(obs, inventory.issues(obs))


@query(f"{_W} SELECT regexp_replace(lower(path), '\\.[^./]*$', '') AS key, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) > 1")
def a20_name_collisions(spark, sf_dir):
    return parity.name_collisions(_obs(spark, sf_dir))


@query("SELECT lower(id) AS key, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || c_nationkey ELSE lower(c_mktsegment) || c_nationkey END AS id FROM customer) GROUP BY 1 HAVING count(*) > 1")
def a21_case_collisions(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    ids = c.select(F.concat(F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")), F.col("c_nationkey").cast("string")).alias("id"))
    return parity.case_collisions(ids).withColumn("ids", _joined("ids"))
