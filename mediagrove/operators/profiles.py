"""Profiles: closure over a content store, bundle plans and frontend export plans, all over flat selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

# Where each frontend expects a role, and the extensions it takes.
SUFFIX = {"grid": "", "portrait": "p", "hero": "_hero", "logo": "_logo", "icon": "_icon"}
PLAYNITE = {"logo": "Logo.png", "video": "VideoTrailer.mp4"}
ESDE = {"cover": "covers", "fanart": "fanart", "manual": "manuals", "marquee": "marquees", "miximage": "miximages", "physicalmedia": "physicalmedia", "screenshot": "screenshots", "titlescreen": "titlescreens", "video": "videos"}
PLAIN = ["png", "jpg", "jpeg"]


def flatten(profiles: DataFrame) -> DataFrame:
    """A row a selected asset of nested profiles (name, games: array of (id, identities, retro, assets: map of role to (sha256, extension)))."""
    games = profiles.select(F.col("name").alias("profile"), F.explode("games").alias("g"))
    rows = games.select("profile", "g", F.explode(F.map_entries("g.assets")).alias("a"))
    ident = lambda n: F.coalesce(F.col("g.identities")[n], F.lit("")).alias(n)
    return rows.select(
        "profile", F.col("g.id").alias("game_id"), ident("steam"), ident("playnite"), ident("romm"), F.coalesce("g.retro.system", F.lit("")).alias("retro_system"),
        F.coalesce("g.retro.stem", F.lit("")).alias("retro_stem"), F.col("a.key").alias("role"), F.col("a.value.sha256").alias("sha256"), F.col("a.value.extension").alias("extension"),
    )


def _ext() -> Column:
    return F.regexp_replace(F.lower("extension"), r"^\.", "")


def resolve(selected: DataFrame, store: DataFrame) -> DataFrame:
    """Selections with their canonical path, whether the store (path, sha256) holds that content, and why not."""
    path = S.asset_path(F.col("sha256"), F.col("extension"), "")
    have = store.select(F.col("path").alias("canonical_path"), F.col("sha256").alias("found"))
    out = selected.withColumn("canonical_path", path).join(have, "canonical_path", "left")
    problem = F.when(F.col("found").isNull(), "managed content is absent").when(F.col("found") != F.col("sha256"), "managed content SHA-256 does not match profile lock").otherwise("")
    return out.select("profile", "game_id", "role", "sha256", _ext().alias("extension"), "canonical_path", (problem == "").alias("available"), problem.alias("issue"))


def completeness(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("profile").agg(F.bool_and("available").alias("complete"), F.count(F.lit(1)).alias("assets"), F.count_if(~F.col("available")).alias("missing"))


def bundle_plan(resolved: DataFrame, revisions: DataFrame) -> DataFrame:
    """Copy or blocked actions for each asset and one render action a profile. ``revisions``: (profile, profile_id, revision)."""
    rows = resolved.join(revisions, "profile")
    base = F.concat(F.lit("bundles/"), F.col("profile_id"), F.lit("/"), F.col("revision"))
    copy = rows.select(
        "profile", F.when(F.col("available"), "copy").otherwise("blocked").alias("action"), F.col("canonical_path").alias("source_path"),
        F.concat(base, F.lit("/assets/"), S.safe_path_key(F.col("game_id")), F.lit("/"), F.col("role"), F.lit("."), F.col("extension")).alias("destination_path"),
        F.when(F.col("available"), "materialize retained profile bundle asset").otherwise("canonical asset is unavailable; promotion is required before bundle build").alias("reason"),
    )
    lock = revisions.select("profile", F.lit("render").alias("action"), F.lit("").alias("source_path"), F.concat(base, F.lit("/bundle.lock.json")).alias("destination_path"), F.lit("write deterministic bundle lock after all assets verify").alias("reason"))
    return copy.unionByName(lock)


def destination(adapter: str, profile_id: Column) -> tuple[Column, Column]:
    """(path, problem) of a selection for an adapter: path '' if the adapter doesn't take it, problem '' if its extension fits."""
    role, ext, none = F.col("role"), _ext(), F.lit("")
    if adapter in ("steam", "decky"):
        takes = F.col("steam").rlike(r"^[0-9]+\z") & role.isin(*SUFFIX)
        name = F.concat(F.col("steam"), S.lookup(SUFFIX, role), F.lit("."), ext)
        path = F.concat(F.lit("artwork/"), profile_id, F.lit("/grid/"), name) if adapter == "decky" else name
        fits = ext.isin(PLAIN) | ((role == "icon") & (ext == "ico"))
    elif adapter == "playnite":
        takes = F.col("playnite").rlike(S.UUID) & role.isin(*PLAYNITE)
        path = F.concat(F.lit("games/"), F.lower("playnite"), F.lit("/"), S.lookup(PLAYNITE, role))
        fits = ((role == "logo") & (ext == "png")) | ((role == "video") & (ext == "mp4"))
    elif adapter == "esde":
        takes = (F.col("retro_system") != "") & (F.col("retro_stem") != "") & role.isin(*ESDE)
        path = F.concat(F.col("retro_system"), F.lit("/"), S.lookup(ESDE, role), F.lit("/"), F.col("retro_stem"), F.lit("."), ext)
        fits = F.when(role == "manual", ext == "pdf").when(role == "video", ext.isin("mp4", "mkv", "avi", "mov", "webm")).otherwise(ext.isin([*PLAIN, "webp"]))
    elif adapter == "romm":
        takes = F.col("romm").rlike(r"^[0-9]+\z") & role.isin("manual", "screenshot", "cover")
        path = F.concat(F.lit("api/roms/"), F.col("romm"), F.lit("/"), role)
        fits = F.when(role == "manual", ext == "pdf").otherwise(ext.isin([*PLAIN, "webp"]))
    else:
        raise ValueError(f"unsupported adapter {adapter!r}")
    problem = F.concat(F.lit(f"{adapter} adapter does not support ."), ext, F.lit(" for role "), role, F.lit("; create a derived canonical asset first"))
    return F.when(takes, path).otherwise(none), F.when(takes & ~fits, problem).otherwise(none)


def export_plan(adapter: str, selected: DataFrame) -> DataFrame:
    """Actions of each profile's export; ``problem`` names the selections that make the reference's plan fail. Decky adds its
    profile document, and a marker where there is nothing else."""
    pid = S.slug(F.col("profile"))
    path, problem = destination(adapter, pid)
    rows = selected.withColumns({"destination_path": path, "problem": problem}).where("destination_path != ''")
    out = rows.select("profile", F.lit("copy").alias("action"), S.asset_path(F.col("sha256"), F.col("extension"), "").alias("source_path"), "sha256", "destination_path", "game_id", "role", "problem")
    if adapter == "decky":
        every = selected.select("profile").distinct()
        extra = lambda p: every.select("profile", F.lit("render").alias("action"), F.lit("").alias("source_path"), F.lit("").alias("sha256"), p.alias("destination_path"), F.lit("").alias("game_id"), F.lit("").alias("role"), F.lit("").alias("problem"))
        marker = extra(F.concat(F.lit("artwork/"), pid, F.lit("/grid/" + S.MARKER))).join(rows.select("profile").distinct(), "profile", "left_anti")
        out = out.unionByName(extra(F.concat(F.lit("profiles/"), pid, F.lit(".json")))).unionByName(marker)
    return out
