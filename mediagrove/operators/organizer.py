"""The catalog of games, platforms and assets, from observations, profiles and resolved metadata.

Relations stay flat: games, assets and platforms are tables of their own, keyed by game, observation and platform id, and nest
only where a caller asks for it. The first statement about a game wins: profiles come before observations, and each row
carries its place (``seq``) instead of relying on any order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.cuts import cut, release, together
from ..functions.udf import aspect
from . import metadata

REPRESENTATIVE = ("portrait", "cover", "grid", "miximage", "hero")


@dataclass
class Catalog:
    games: DataFrame
    assets: DataFrame
    platforms: DataFrame
    platform_assets: DataFrame


def profile_identity() -> dict[str, Column]:
    """game, platform and title of a selected game (game_id, steam, playnite, retro_system, retro_stem)."""
    gid, steam, playnite, rs = F.col("game_id"), F.col("steam"), F.col("playnite"), F.col("retro_system")
    direct = gid.startswith("steam:") | gid.startswith("playnite:")
    retro_id = F.when(gid.startswith("retro:"), gid).otherwise(F.concat(F.lit("retro:"), rs, F.lit(":"), F.col("retro_stem")))
    game = F.when(direct, gid).when(steam != "", F.concat(F.lit("steam:"), steam)).when(playnite != "", F.concat(F.lit("playnite:"), F.lower(playnite))).when(rs != "", retro_id).otherwise(gid)
    platform = F.when(direct, S.platform_of_identity(gid, F.lit(""))).when(steam != "", F.lit("steam")).when(playnite != "", F.lit("playnite")).when(rs != "", F.concat(F.lit("retro:"), rs)).otherwise(F.lit("other"))
    title = (
        F.when(gid.startswith("steam:"), F.concat(F.lit("Steam app "), F.substring(gid, 7, 1000))).when(gid.startswith("playnite:"), F.concat(F.lit("Playnite game "), F.substring(gid, 10, 1000)))
        .when(steam != "", F.concat(F.lit("Steam app "), steam)).when(playnite != "", F.concat(F.lit("Playnite game "), S.short_id(playnite)))
        .when(rs != "", S.clean_title(F.col("retro_stem"))).otherwise(S.clean_title(gid))
    )
    return {"own_game": game, "own_platform": platform, "own_title": title}


def is_platform_asset() -> Column:
    low = F.lower(S.stem(F.col("path")))
    return (F.col("root_kind") == "esde-media") & (F.col("system") != "") & ((low == F.lower("system")) | low.isin("system", "platform", "console"))


def colliding_hints(obs: DataFrame) -> DataFrame:
    """Retro hints that stand for files of several stems."""
    per = obs.where(F.col("identity_hint").startswith("retro:")).groupBy("identity_hint").agg(F.min(S.stem(F.col("path"))).alias("lo"), F.max(S.stem(F.col("path"))).alias("hi"))
    return per.where("lo != hi").select("identity_hint", F.lit(True).alias("collides"))


def profile_index(selected: DataFrame) -> DataFrame:
    """(namespace, sha256, profiles): the profiles that select a content for a game of a namespace."""
    own = selected.withColumns(profile_identity()).select(S.namespace(F.col("own_game")).alias("namespace"), "sha256", "profile").distinct()
    return own.groupBy("namespace", "sha256").agg(F.array_sort(F.collect_list("profile")).alias("profiles"))


def keyed(obs: DataFrame, aliases: DataFrame, ends: DataFrame, titles: DataFrame, stores: DataFrame) -> DataFrame:
    """Observations with game, platform, title, store and attention as each would state them for a new game.

    Observations without a hint have one key, '', and nothing to meet: they stay out of the joins.
    """
    hint = F.col("identity_hint")
    none = F.lit(None).cast("string")
    bare = obs.where(hint == "").withColumns({"collides": F.lit(False), "original": F.lit(""), "canonical": F.lit(""), "known_title": none, "doubtful": F.lit(False), "store": none, "mapped": F.lit("")})
    out = obs.where(hint != "")
    out = out.join(colliding_hints(out), "identity_hint", "left").withColumn("collides", F.coalesce("collides", F.lit(False)))
    parts = F.split("identity_hint", ":", 3)
    out = out.withColumn("original", F.when(F.col("collides") & (F.size(parts) == 3), S.disambiguated(parts[1], F.col("stem"))).otherwise(hint))
    out = metadata.with_titles(out, "original", ends, titles)
    doubt = aliases.where("ambiguous").select(F.col("identity").alias("original"), F.lit(True).alias("doubtful"))
    out = out.join(doubt, "original", "left").withColumn("doubtful", F.coalesce("doubtful", F.lit(False))).join(stores.withColumnRenamed("identity", "original"), "original", "left")
    same = S.namespace(F.col("canonical")) == S.namespace(F.col("original"))
    out = out.withColumn("mapped", F.when(same, F.col("canonical")).otherwise(F.col("original"))).unionByName(bare)
    out = out.withColumn("game", F.when(F.col("mapped") == "", F.concat(F.lit("unmapped:"), F.col("observation_id"))).otherwise(F.col("mapped")))
    game = F.col("game")
    title = (
        F.when(F.col("known_title").isNotNull(), F.col("known_title")).when(game.startswith("steam:"), F.concat(F.lit("Steam app "), F.substring(game, 7, 1000)))
        .when(game.startswith("playnite:"), F.concat(F.lit("Playnite game "), S.short_id(F.substring(game, 10, 1000)))).otherwise(S.clean_title(F.col("stem")))
    )
    return out.withColumns({
        "title": title,
        "platform": S.platform_of_identity(game, S.platform_of_observation(hint, F.col("root_kind"), F.col("system"))),
        "attention": (F.col("mapped") == "") | F.col("collides") | F.col("doubtful"),
    })


def build(obs: DataFrame, selected: DataFrame, aliases: DataFrame, titles: DataFrame, stores: DataFrame) -> Catalog:
    """The catalog's tables. What several of them start from is written to the shared checkpoint folder once, so each later
    plan begins at a scan of a few columns and nothing stays in the executors' memory."""
    spark = obs.sparkSession
    derived = obs.withColumns({
        "stem": S.stem(F.col("path")), "namespace": S.namespace(F.col("identity_hint")), "artwork_set": S.artwork_set(F.col("root_kind"), F.col("path")),
        "source_name": S.source_name(F.col("root_kind")), "location": F.concat(F.col("root_id"), F.lit(":"), F.col("path")), "is_platform": is_platform_asset(),
    })

    def chains() -> tuple[DataFrame, DataFrame]:
        own = cut(aliases)
        return own, metadata.closure(own)

    obs, selected, (aliases, ends), titles, stores = together(spark, lambda: cut(derived), lambda: cut(selected), chains, lambda: cut(titles), lambda: cut(stores))
    copies = obs.groupBy("sha256").agg(F.count(F.lit(1)).alias("shared_copies")).where("shared_copies > 1")
    every = (
        obs.join(copies, "sha256", "left").join(profile_index(selected), ["namespace", "sha256"], "left")
        .withColumns({"shared_copies": F.coalesce("shared_copies", F.lit(1)), "profiles": F.coalesce("profiles", F.array().cast("array<string>"))})
    )
    platform_assets = every.where("is_platform").withColumn("platform", F.concat(F.lit("retro:"), F.lower("system")))
    assets = keyed(every.where("not is_platform"), aliases, ends, titles, stores).withColumn("role", F.when(F.col("role") == "", F.lit("other")).otherwise(F.col("role")))

    picked = selected.withColumns(profile_identity())
    picked = metadata.with_titles(picked.select("profile", "game_id", "own_game", "own_platform", "own_title").distinct(), "own_game", ends, titles)
    same = S.namespace(F.col("canonical")) == S.namespace(F.col("own_game"))
    declared = (
        picked.withColumn("game", F.when(same, F.col("canonical")).otherwise(F.col("own_game")))
        .where("game != ''")
        .select("game", S.platform_of_identity(F.col("game"), F.col("own_platform")).alias("platform"), F.coalesce("known_title", "own_title").alias("title"), F.struct("profile", "game_id").alias("seq"))
        .groupBy("game")
        .agg(F.min_by(F.struct("platform", "title"), "seq").alias("p"))
        .select("game", "p.platform", "p.title", F.lit(False).alias("attention"))
    )
    assets, declared = together(spark, lambda: cut(assets), lambda: cut(declared))
    seen = assets.groupBy("game").agg(F.min_by(F.struct("platform", "title", "attention"), "seq").alias("o"), F.min_by("store", "seq").alias("store"), F.count(F.lit(1)).alias("n"), F.collect_set("role").alias("roles"))
    games = declared.withColumnsRenamed({"platform": "dp", "title": "dt", "attention": "da"}).join(seen, "game", "full_outer")
    have = F.coalesce("roles", F.array().cast("array<string>"))
    games = games.select(
        "game", F.coalesce("dp", "o.platform").alias("platform"), F.coalesce("dt", "o.title").alias("title"), F.coalesce("da", "o.attention").alias("attention"),
        F.coalesce("store", F.lit("")).alias("store"), F.coalesce("n", F.lit(0)).alias("assets"), F.array_except(F.array(*map(F.lit, S.EXPECTED_ROLES)), have).alias("missing_roles"),
    ).withColumns({"platform_name": S.platform_name(F.col("platform")), "fallback_frontend": fallback()[0], "fallback_roles": fallback()[1]})
    games = cut(games)
    release(aliases, titles, stores)
    used = game_profiles(games, assets, selected)
    games = games.join(used, "game", "left").withColumn("profiles", F.coalesce("profiles", F.array().cast("array<string>")))
    return Catalog(games, assets, platforms(games), platform_assets)


def fallback() -> tuple[Column, Column]:
    """The frontend that stands in for missing roles, and those roles; '' and none otherwise."""
    roles = {"Steam": ["grid", "portrait", "hero", "logo", "icon"], "Playnite": ["cover", "logo", "icon"], "ES-DE": ["cover", "marquee", "screenshot", "miximage", "video"]}
    which = F.when(F.col("platform") == "steam", "Steam").when(F.col("platform") == "playnite", "Playnite").when(F.col("game").startswith("retro:"), "ES-DE").otherwise("")
    held = F.array().cast("array<string>")
    for name, own in roles.items():
        held = F.when(which == name, F.array_intersect(F.array(*map(F.lit, own)), F.col("missing_roles"))).otherwise(held)
    return F.when(F.size(held) > 0, which).otherwise(""), held


def game_profiles(games: DataFrame, assets: DataFrame, selected: DataFrame) -> DataFrame:
    """(game, profiles) that name a game of the same platform by its id or by one of its identities: two equi-joins instead of one on a choice."""
    named = selected.withColumns(profile_identity()).select("profile", "game_id", F.col("own_platform").alias("platform"), "steam", "playnite", "romm").distinct()
    by_id = games.select("game", "platform").join(named.withColumnRenamed("game_id", "game"), ["game", "platform"]).select("game", "profile")
    pairs = F.array(*(F.struct(F.lit(n).alias("ns"), F.col(n).alias("value")) for n in ("steam", "playnite", "romm")))
    stated = named.select("profile", "platform", F.explode(pairs).alias("i")).where("i.value != ''").select("profile", "platform", "i.ns", "i.value")
    split = lambda c: F.split(c, ":", 2)
    own = assets.where(F.col("original").contains(":")).select("game", split(F.col("original"))[0].alias("ns"), split(F.col("original"))[1].alias("value"))
    also = games.where(F.col("game").contains(":") & ~F.col("game").startswith("unmapped:")).select("game", split(F.col("game"))[0].alias("ns"), split(F.col("game"))[1].alias("value"))
    identities = own.unionByName(also).distinct().join(games.select("game", "platform"), "game")
    by_identity = identities.join(stated, ["platform", "ns", "value"]).select("game", "profile")
    return by_id.unionByName(by_identity).distinct().groupBy("game").agg(F.array_sort(F.collect_list("profile")).alias("profiles"))


def platforms(games: DataFrame) -> DataFrame:
    empty = F.count_if(F.col("assets") == 0)
    return games.groupBy("platform", "platform_name").agg(
        F.count(F.lit(1)).alias("games"), F.sum("assets").alias("artwork"), empty.alias("without_art"),
        S.percent(F.count(F.lit(1)) - empty, F.count(F.lit(1))).alias("coverage"),
    )


def previews(assets: DataFrame, most: int = 4) -> DataFrame:
    """Up to ``most`` assets a platform that can stand for it, by game, role and id. Tasks keep the first ``most`` of their own rows by platform (a group limit below the
    exchange), so a platform's task sees ``most`` rows a task, not the platform."""
    w = Window.partitionBy("platform").orderBy("game", "role", "observation_id")
    return assets.where(F.col("role").isin(*REPRESENTATIVE)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("platform", "n", "observation_id")


def asset_rows(assets: DataFrame) -> DataFrame:
    """The projection of assets, with the aspect text."""
    cols = ["observation_id", "game", "sha256", "role", "width", "height", "mime", "extension", "size", "root_id", "source_name", "location", "shared_copies", "profiles", "artwork_set", "root_kind"]
    return assets.select(*cols, aspect("width", "height").alias("aspect"))


def visible_games(games: DataFrame, assets: DataFrame, *, platform: str = "", text: str = "", art: str = "", role: str = "", source: str = "", by_missing: bool = False) -> DataFrame:
    """The games of a grid view: filters by platform, title, presence of art, role and source; by title or by missing roles first."""
    out = games
    if platform:
        out = out.where(F.col("platform") == platform)
    if text:
        out = out.where(F.lower("title").contains(text.lower()))
    if art:
        out = out.where((F.col("assets") > 0) if art == "has-art" else (F.size("missing_roles") > 0))
    for column, value in (("role", role), ("root_id", source)):
        if value:
            out = out.join(assets.where(F.col(column) == value).select("game").distinct(), "game", "left_semi")
    order = [F.size("missing_roles").desc(), "title", "game"] if by_missing else ["title", "game"]
    return out.orderBy(*order)


def representative(assets: DataFrame) -> DataFrame:
    """(game, observation_id): the first portrait, cover, grid or miximage by role and id, else the first asset."""
    rank = F.when(F.col("role").isin("portrait", "cover", "grid", "miximage"), 0).otherwise(1)
    return assets.groupBy("game").agg(F.min_by("observation_id", F.struct(rank, F.col("role"), F.col("observation_id"))).alias("observation_id"))
