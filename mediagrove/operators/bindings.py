"""The catalog's relations over the driver's tables, so that every operator can be run and checked on them.

``OBSERVED`` is plain SQL that Spark and the oracle read alike; it only makes file facts up from documents. What operators derive
from these facts (roles, systems, identities, issues, plans) is never part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KIND = "CASE CAST(substring(source, 4) AS INT) % 6 WHEN 0 THEN 'steam-grid' WHEN 1 THEN 'playnite-library' WHEN 2 THEN 'playnite-extra' WHEN 3 THEN 'decky-catalog' WHEN 4 THEN 'esde-media' ELSE 'romm' END"
_EXT = "CASE doc_id % 9 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'PNG' WHEN 3 THEN 'webp' WHEN 4 THEN 'ico' WHEN 5 THEN 'gif' WHEN 6 THEN 'pdf' WHEN 7 THEN 'mp4' ELSE 'jpeg' END"
_APP = "concat(CAST(100 + doc_id % 40 AS STRING), CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'p' WHEN 2 THEN '_hero' WHEN 3 THEN '_logo' ELSE '_icon' END)"
_GAME = "concat('0000', lpad(CAST(doc_id % 60 AS STRING), 4, '0'), '-00aB-4000-8000-', lpad(CAST(doc_id % 60 AS STRING), 12, '0'))"
_FILE = "concat('1111', lpad(CAST(doc_id % 1000 AS STRING), 4, '0'), '-0000-4000-8000-', lpad(CAST(doc_id AS STRING), 12, '0'))"
_DIR = "CASE doc_id % 7 WHEN 0 THEN 'covers' WHEN 1 THEN 'manuals' WHEN 2 THEN 'videos' WHEN 3 THEN 'screenshots' WHEN 4 THEN 'marquees' WHEN 5 THEN '3dboxes' ELSE 'other' END"
_SYS = "CASE doc_id % 4 WHEN 0 THEN 'n64' WHEN 1 THEN 'SNES' WHEN 2 THEN 'pc_engine' ELSE 'psp' END"
_STEM = "concat('Example Game_', CAST(doc_id % 25 AS STRING), CASE doc_id % 3 WHEN 0 THEN ' (Region) [Rev 1]' WHEN 1 THEN '' ELSE '!' END)"

OBSERVED = f"""
SELECT doc_id AS seq, source AS root_id, {_KIND} AS root_kind, '' AS configured_system,
  CASE {_KIND}
    WHEN 'steam-grid' THEN concat({_APP}, '.', {_EXT})
    WHEN 'playnite-library' THEN concat({_GAME}, '/', {_FILE}, '.', {_EXT})
    WHEN 'playnite-extra' THEN concat('games/', {_GAME}, '/', CASE doc_id % 3 WHEN 0 THEN 'Logo' WHEN 1 THEN 'VideoTrailer' ELSE 'Backdrop' END, '.', {_EXT})
    WHEN 'decky-catalog' THEN concat('artwork/set', CAST(doc_id % 5 AS STRING), '/grid/', CASE WHEN doc_id % 11 = 0 THEN '.deck-profile-empty' ELSE concat({_APP}, '.', {_EXT}) END)
    WHEN 'esde-media' THEN concat({_SYS}, '/', {_DIR}, '/', CASE WHEN doc_id % 13 = 0 THEN 'system' ELSE {_STEM} END, '.', {_EXT})
    ELSE concat('roms/', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.bin' END) END AS path,
  CAST({{size}} AS BIGINT) AS size, {{sha}} AS sha256,
  CASE WHEN doc_id % 17 = 0 THEN 'image/png' ELSE CASE doc_id % 9 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/x-icon' WHEN 5 THEN 'image/gif' WHEN 6 THEN 'application/pdf' WHEN 7 THEN 'video/mp4' ELSE 'image/jpeg' END END AS mime,
  CAST(CASE WHEN doc_id % 23 = 0 OR doc_id % 9 IN (6, 7) THEN 0 ELSE 100 + doc_id % 7 * 100 END AS INT) AS width,
  CAST(CASE WHEN doc_id % 23 = 0 OR doc_id % 9 IN (6, 7) THEN 0 ELSE 150 + doc_id % 11 * 90 END AS INT) AS height
FROM documents
"""

#: Rules of the example policy: selectors ('' matches anything) and a mode, in order.
RULES = [("src0", "", "", "", "managed"), ("", "n64", "", "", "quarantined"), ("", "", "cover", "", "promote-on-approval"), ("src4", "", "cover", "", "managed"), ("", "snes", "video", "", "quarantined"), ("src3", "", "grid", "", "tracked-external"), ("", "", "logo", "", "managed")]
DEFAULT_MODE = "tracked-external"

#: Profiles' selections over labelled documents: profile, theme, game, its identities, role, content and extension.
SELECTED = """
SELECT concat('Profile q', CAST(quality AS STRING), ' t', CAST(toxic AS STRING)) AS profile, CASE WHEN toxic = 1 THEN 'dark' ELSE '' END AS theme,
  CASE d.doc_id % 4 WHEN 0 THEN concat('steam:', CAST(100 + d.doc_id % 40 AS STRING)) WHEN 1 THEN concat('playnite:', lower({game})) WHEN 2 THEN concat('retro:n64:example-game-', CAST(d.doc_id % 25 AS STRING)) ELSE concat('game-', CAST(d.doc_id % 40 AS STRING)) END AS game_id,
  CASE WHEN d.doc_id % 4 IN (0, 3) THEN CAST(100 + d.doc_id % 40 AS STRING) ELSE '' END AS steam,
  CASE WHEN d.doc_id % 4 = 1 THEN {game} ELSE '' END AS playnite,
  CASE WHEN d.doc_id % 8 = 3 THEN CAST(d.doc_id % 40 AS STRING) ELSE '' END AS romm,
  CASE WHEN d.doc_id % 4 = 2 THEN 'n64' ELSE '' END AS retro_system, CASE WHEN d.doc_id % 4 = 2 THEN concat('Example Game ', CAST(d.doc_id % 25 AS STRING)) ELSE '' END AS retro_stem,
  CASE d.doc_id % 11 WHEN 0 THEN 'grid' WHEN 1 THEN 'portrait' WHEN 2 THEN 'cover' WHEN 3 THEN 'hero' WHEN 4 THEN 'logo' WHEN 5 THEN 'icon' WHEN 6 THEN 'manual' WHEN 7 THEN 'video' WHEN 8 THEN 'screenshot' WHEN 9 THEN 'fanart' ELSE 'marquee' END AS role,
  min({sha}) AS sha256, min(CASE d.doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'pdf' WHEN 3 THEN 'mp4' ELSE 'ico' END) AS extension
FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL
""".replace("{game}", _GAME.replace("doc_id", "d.doc_id"))


def _view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, OBSERVED.format(size="octet_length(text)", sha="sha2(text, 256)").replace("FROM documents", "FROM {documents}"), "documents")


def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SELECTED.replace("{sha}", "sha2(text, 256)").replace("FROM documents", "FROM {documents}").replace("JOIN labels", "JOIN {labels}"), "documents", "labels")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(RULES)], "rule int, source string, system string, role string, sha256 string, mode string")


#: The same relations for the oracle.
ORACLE_OBSERVED = OBSERVED.format(size="strlen(text)", sha="sha256(text)").replace("AS STRING", "AS VARCHAR")
ORACLE_SELECTED = SELECTED.replace("{sha}", "sha256(text)").replace("AS STRING", "AS VARCHAR")
