"""Which artwork sets cover which games, seen from profiles, games, unbound sets and live folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def held(assets: DataFrame) -> DataFrame:
    """(artwork_set, game, roles, n): what each set holds for each game."""
    return assets.where("artwork_set != ''").groupBy("artwork_set", "game").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("n"))


def _declared(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("key", S.profile_key(F.col("platform"), F.col("name")))


def profile_games(games: DataFrame, holdings: DataFrame, profiles: DataFrame) -> DataFrame:
    """A row a game that a profile's set holds and whose folded platform is the profile's."""
    at = games.select("game", "title", S.folded_platform(F.col("platform")).alias("platform"))
    return (
        _declared(profiles).where("artwork != ''").join(holdings.withColumnRenamed("artwork_set", "artwork"), "artwork").join(at, ["game", "platform"])
        .select("key", "game", F.when(F.col("title") == "", F.col("game")).otherwise(F.col("title")).alias("title"), "roles", "n")
    )


def ordered_games(games: DataFrame) -> DataFrame:
    """Profile games with their place in the profile: by title in lower case, then by id. Sorted within profiles, not over all of them."""
    return games.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.lower("title"), "game")))


def profile_totals(games: DataFrame, holdings: DataFrame, profiles: DataFrame) -> DataFrame:
    own = profile_games(games, holdings, profiles).groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("a"))
    out = _declared(profiles).join(own, "key", "left")
    return out.select("key", "name", "platform", "artwork", F.coalesce("g", F.lit(0)).alias("games"), F.coalesce("a", F.lit(0)).alias("assets"), F.col("g").isNull().alias("empty"))


def profile_roles(games: DataFrame, holdings: DataFrame, profiles: DataFrame) -> DataFrame:
    """(key, role, n): games of a profile that have a role, most first."""
    return profile_games(games, holdings, profiles).select("key", F.explode("roles").alias("role")).groupBy("key", "role").agg(F.count(F.lit(1)).alias("n")).orderBy("key", F.desc("n"), "role")


def unbound(games: DataFrame, holdings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sets that no profile of any platform claims."""
    claimed = profiles.where("artwork != ''").select(F.col("artwork").alias("artwork_set")).distinct()
    at = games.select("game", S.folded_platform(F.col("platform")).alias("platform"))
    rows = holdings.join(claimed, "artwork_set", "left_anti").join(at, "game", "left")
    return rows.groupBy("artwork_set").agg(F.count(F.lit(1)).alias("games"), F.sum("n").alias("assets"), F.array_sort(F.collect_set("platform")).alias("platforms")).orderBy("artwork_set")


def game_profiles(games: DataFrame, holdings: DataFrame, profiles: DataFrame) -> DataFrame:
    """A row a game and profile of its folded platform: whether the profile's set covers it, and with what."""
    at = games.select("game", S.folded_platform(F.col("platform")).alias("platform"))
    pairs = at.join(_declared(profiles), "platform")
    have = holdings.select(F.col("artwork_set").alias("artwork"), "game", "roles", "n")
    out = pairs.join(have, ["artwork", "game"], "left")
    return out.select("game", "key", F.col("n").isNotNull().alias("covered"), F.coalesce("n", F.lit(0)).alias("assets"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))


def covered_counts(games: DataFrame, holdings: DataFrame, profiles: DataFrame) -> DataFrame:
    per = game_profiles(games, holdings, profiles).groupBy("game").agg(F.count(F.lit(1)).alias("p"), F.count_if("covered").alias("c"))
    return games.select("game").join(per, "game", "left").select("game", F.coalesce("p", F.lit(0)).alias("relevant"), F.coalesce("c", F.lit(0)).alias("covered"))


def surfaces(assets: DataFrame) -> DataFrame:
    """Live folders: assets outside the catalog and its sets, by source."""
    live = assets.where("artwork_set = '' AND root_kind NOT IN ('', 'decky-catalog')")
    return live.groupBy("root_id").agg(F.min("source_name").alias("source_name"), F.min("root_kind").alias("root_kind"), F.count(F.lit(1)).alias("assets"), F.count_distinct("game").alias("games")).orderBy("root_id")


def devices_of(devices: DataFrame) -> DataFrame:
    """(platform, devices) of devices with arrays of platforms."""
    rows = devices.select(F.explode("platforms").alias("platform"), "id", "name").distinct()
    return rows.groupBy("platform").agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("devices"))
