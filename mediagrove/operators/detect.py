"""Source detection: candidates of well-known places, told apart by path and file, with unique ids, bounded counts and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ITEMS = 10_000

# The sources that can be supported, and what is said where one is missing.
SUPPORTED = [
    ("supported-steam", "steam-grid", "Steam custom artwork", "No Steam custom artwork was found on this device."),
    ("supported-playnite", "playnite-library", "Playnite", "Playnite is not installed on this device."),
    ("supported-gaming-profiles", "decky-catalog", "Deck Gaming Profiles", "The synced GamingProfiles catalog is not on this device."),
    ("supported-retrodeck", "esde-media", "RetroDECK / ES-DE", "Not on this device - RetroDECK media may live on your Steam Deck."),
    ("supported-romm", "romm", "RomM", "No local RomM artwork source is configured on this device."),
]
UNAVAILABLE = "Configured source is not available on this device."


def _key(path: str, fold: bool):
    return F.lower(path) if fold else F.col(path)


def detect(places: DataFrame, files: DataFrame, roots: DataFrame, *, fold_case: bool = False) -> DataFrame:
    """(id, kind, name, path, items, configured, status) of ``places`` (seq, id, kind, name, path, is_dir, file_key).

    A place counts if it is a folder that no earlier place (by seq) names by path or by file. Ids that repeat get -2, -3 in that order.
    ``files``: (path of the place, n: regular files below); counts stop at ``MOST_ITEMS``. ``roots``: configured (path).
    """
    real = places.where("is_dir and path not in ('', '.')").withColumn("key", _key("path", fold_case))
    first = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("seq"))
    once = real.withColumn("k", first("key")).where("k = 1").withColumn("k", first("file_key")).where("k = 1").withColumn("k", first("id"))
    known = roots.select(_key("path", fold_case).alias("key")).distinct().withColumn("configured", F.lit(True))
    out = once.join(known, "key", "left").join(files.select("path", "n"), "path", "left").withColumn("configured", F.coalesce("configured", F.lit(False)))
    return out.select(
        F.when(F.col("k") == 1, F.col("id")).otherwise(F.concat_ws("-", "id", F.col("k").cast("string"))).alias("id"), "kind", "name", "path",
        F.least(F.coalesce("n", F.lit(0)), F.lit(MOST_ITEMS)).alias("items"), "configured", F.when(F.col("configured"), "connected").otherwise("detected").alias("status"),
    )


def supported(detected: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, kind, name, status, message): supported sources that are neither detected nor configured; extra metadata implies its library."""
    spark = detected.sparkSession
    present = detected.select("kind").union(roots.select("kind"))
    implied = present.where("kind = 'playnite-extra'").select(F.lit("playnite-library").alias("kind"))
    every = spark.createDataFrame(SUPPORTED, "id string, kind string, name string, message string")
    return every.join(present.union(implied).distinct(), "kind", "left_anti").select("id", "kind", "name", F.lit("not-on-this-device").alias("status"), "message")


def source_cards(detected: DataFrame, roots: DataFrame, *, fold_case: bool = False) -> DataFrame:
    """Detected and supported sources, and configured roots (id, kind, path) that weren't detected, as unavailable."""
    seen = detected.select(_key("path", fold_case).alias("key"))
    gone = roots.withColumn("key", _key("path", fold_case)).join(seen, "key", "left_anti").select(
        "id", "kind", F.col("id").alias("name"), "path", F.lit(True).alias("configured"), F.lit("temporarily-unavailable").alias("status"), F.lit(UNAVAILABLE).alias("message"),
    )
    return detected.unionByName(supported(detected, roots), allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


def diagnostics_of(diagnostics: DataFrame, kind: str) -> DataFrame:
    """Diagnostics (source, status, message) that belong to a kind of source."""
    prefix = "steam" if kind == "steam-grid" else "playnite" if kind.startswith("playnite") else "esde" if kind == "esde-media" else None
    return diagnostics.where(F.col("source").startswith(prefix) if prefix else F.lit(False))
