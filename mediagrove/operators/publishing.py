"""Publishing views: targets, requests, file labels, receipts, media that may be served, profile documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

MOST_MEDIA_BYTES = 64 << 20

# The types that may be downloaded, and the extension each gets.
DOWNLOADS = {
    "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/x-icon": "ico",
    "application/pdf": "pdf", "video/mp4": "mp4", "video/webm": "webm", "video/x-matroska": "mkv",
}


# The topology of a host that has none stored: platforms (id, name), devices (id, name, platforms) and profiles (platform, name).
PLATFORMS = [("steam", "Steam"), ("playnite", "Playnite"), ("retro", "Retro gaming")]
DEVICES = [("pc", "Gaming PC", ["steam", "playnite"]), ("steam-deck", "Steam Deck", ["steam", "retro"]), ("rog-ally-x", "ROG Ally X", ["steam"])]
PROFILES = [
    ("steam", "Standard"), ("steam", "Retro"), ("steam", "Minimalist"), ("steam", "Tasteful"), ("playnite", "Standard"), ("playnite", "Minimalist"),
    ("retro", "Retro"), ("retro", "Minimalist"), ("retro", "Tasteful"), ("retro", "Canon"),
]


def topologies(stored: DataFrame) -> DataFrame:
    """(host, found, what, id, name, platforms) of hosts (host, text: the stored document, null where there is none): the document's platforms, devices and profiles, or the built-in ones.

    A profile's id is its key. A document that isn't JSON gives nothing (``documents.invalid`` says so).
    """
    kind = "array<struct<what: string, id: string, name: string, platforms: array<string>>>"
    text = lambda v, f: F.expr(f"try_variant_get({v}, '$.{f}', 'string')")
    built_in = [("platform", i, n, []) for i, n in PLATFORMS] + [("device", i, n, p) for i, n, p in DEVICES]
    row = lambda what, i, n, p: F.struct(F.lit(what).alias("what"), i.alias("id"), n.alias("name"), p.alias("platforms"))
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    default = F.array(*(row(w, F.lit(i), F.lit(n), lits(p)) for w, i, n, p in built_in), *(row("profile", S.profile_key(F.lit(p), F.lit(n)), F.lit(n), lits([p])) for p, n in PROFILES)).cast(kind)
    doc = F.try_parse_json("text")
    items = lambda f: F.coalesce(F.expr(f"try_variant_get(doc, '$.{f}', 'array<variant>')"), F.array().cast("array<variant>"))
    platforms = F.coalesce(F.expr("try_variant_get(v, '$.platforms', 'array<string>')"), lits([]))
    rows = stored.select("host", F.col("text").isNotNull().alias("found"), doc.alias("doc"))
    none = rows.where("not found").select("host", "found", F.inline(default))
    parts = [rows.where("found").select("host", "found", F.lit(w).alias("what"), F.explode(items(f)).alias("v")) for w, f in (("platform", "platforms"), ("device", "devices"), ("profile", "profiles"))]
    own = parts[0].unionByName(parts[1]).unionByName(parts[2])
    platform = text("v", "platform")
    key = F.when(F.col("what") == "profile", S.profile_key(platform, text("v", "name"))).otherwise(text("v", "id"))
    listed = F.when(F.col("what") == "device", platforms).when(F.col("what") == "profile", F.array(platform)).otherwise(lits([]))
    return own.select("host", "found", "what", key.alias("id"), text("v", "name").alias("name"), listed.alias("platforms")).unionByName(none)


def default_targets(devices: DataFrame, platforms: DataFrame) -> DataFrame:
    """(id, name, device, platform, adapter): one target a device (id, name, platforms) and platform (id, name), where none are stored."""
    rows = devices.select("id", "name", F.explode("platforms").alias("platform")).join(platforms.select(F.col("id").alias("platform"), F.col("name").alias("shown")), "platform", "left")
    return rows.select(
        F.concat_ws("-", "id", "platform").alias("id"), F.concat("name", F.lit(" · "), F.coalesce("shown", "platform")).alias("name"), F.col("id").alias("device"), "platform",
        F.when(F.col("platform") == "steam", "steam").otherwise("").alias("adapter"),
    )


def selections(requests: DataFrame, targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """``requests`` (request, profile, target) with artwork and problem ('' if the request can be met). Profiles: (key, platform, artwork);
    of targets of one id the last (by seq) counts, of profiles of one key the first."""
    t = targets.groupBy(F.col("id").alias("target")).agg(F.max_by("platform", "seq").alias("target_platform"))
    p = profiles.groupBy(F.col("key").alias("profile")).agg(F.min_by(F.struct("platform", "artwork"), "seq").alias("p"))
    problem = (
        F.when(F.col("target_platform").isNull(), "unknown frontend target").when(F.col("p").isNull(), "unknown platform profile")
        .when(F.col("p.platform") != F.col("target_platform"), "profile and frontend platforms must match").otherwise("")
    )
    return requests.join(t, "target", "left").join(p, "profile", "left").select("request", F.when(problem == "", F.col("p.artwork")).otherwise("").alias("artwork"), problem.alias("problem"))


def file_labels(compared: DataFrame) -> DataFrame:
    """Compared files (path, blocked, status, reason, previous, sha256) in order of path, with what will be done with each and what is there now."""
    label = (
        F.when(F.col("blocked"), F.concat(F.lit("Excluded: "), F.col("reason"))).when(F.col("status") == "matching", "Keep matching file")
        .when(F.col("status") == "different", "Back up and replace").when(F.col("status") == "missing", "Add copy").otherwise("Not observed")
    )
    now = F.when(F.col("previous") == "", "Absent / not observed").otherwise(F.col("previous"))
    return compared.select("path", label.alias("label"), now.alias("now"), "sha256")


def profile_receipts(receipts: DataFrame, profile: str) -> DataFrame:
    """(digest, target, state, prepared, can_roll_back) of a profile's receipts (digest, profile, target, state, prepared: array)."""
    return receipts.where(F.col("profile") == profile).select("digest", "target", "state", F.size("prepared").alias("prepared"), (F.col("state") != "rolled-back").alias("can_roll_back"))


def rollback(files: DataFrame, prepared: DataFrame, now: DataFrame) -> DataFrame:
    """(receipt, path, action, expected, problem) of receipts' files (receipt, path, sha256, previous) that were prepared.

    A file that had a predecessor gets it back if what is there is the published or the previous content, else it drifted; a new file is kept.
    """
    own = files.join(prepared.select("receipt", "path").distinct(), ["receipt", "path"], "left_semi").join(now.select("path", F.col("sha256").alias("actual")), "path", "left")
    actual = F.coalesce("actual", F.lit(""))
    new = F.col("previous") == ""
    action = F.when(new & (actual != ""), "retain").when(new, "none").when((actual == F.col("sha256")) | (actual == F.col("previous")), "copy").otherwise("blocked")
    return own.select("receipt", "path", action.alias("action"), actual.alias("expected"), F.when(action == "blocked", "published file drifted; rollback will not overwrite it").otherwise("").alias("problem"))


def media(requests: DataFrame, obs: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """``requests`` (id) with outcome (ok, not-found or unsafe), whether the medium can be previewed, and the extension of a download.

    ``roots``: configured (root_id); ``files``: what is there now (root_id, path, type: file, dir or link, size, linked: a link stands on the way).
    """
    known = obs.select(F.col("observation_id").alias("id"), "root_id", "path", "mime").join(roots.select("root_id").distinct(), "root_id").join(files, ["root_id", "path"], "left")
    out = requests.join(known, "id", "left")
    safe = S.safe_relative_path(F.col("path")) & (F.col("type") == "file") & (F.col("size") <= MOST_MEDIA_BYTES) & ~F.col("linked")
    outcome = F.when(F.col("path").isNull() | (S.safe_relative_path(F.col("path")) & F.col("type").isNull()), "not-found").when(safe, "ok").otherwise("unsafe")
    ok = outcome == "ok"
    return out.select("id", outcome.alias("outcome"), (ok & F.coalesce(F.col("mime").startswith("image/"), F.lit(False))).alias("preview"), F.coalesce(F.when(ok, S.lookup(DOWNLOADS, F.col("mime"))), F.lit("")).alias("download"))


def profile_documents(profiles: DataFrame, plan: DataFrame) -> DataFrame:
    """(profile, document, has_grid_artwork): the frontend's profile document of profiles (profile, name, description, mods: array) as JSON, and
    whether their plan (``profiles.export_plan`` of decky) copies artwork. No mods are an empty list, not null."""
    pid = S.slug(F.col("profile"))
    mods = F.coalesce("mods", F.array().cast("array<string>"))
    document = F.to_json(F.struct(F.lit(1).alias("version"), pid.alias("id"), "name", "description", pid.alias("artwork"), mods.alias("mods")))
    copies = plan.where((F.col("action") == "copy") & F.col("destination_path").contains("/grid/")).select("profile").distinct().withColumn("has", F.lit(True))
    return profiles.select("profile", document.alias("document")).join(copies, "profile", "left").select("profile", "document", F.coalesce("has", F.lit(False)).alias("has_grid_artwork"))


def identities(canonical, original):
    """Map of namespace to value of a game's canonical and original identity; the original wins. Unmapped ones state nothing."""
    one = lambda c: F.when(c.contains(":") & ~c.startswith("unmapped:"), F.array(F.struct(F.split(c, ":", 2)[0].alias("key"), F.split(c, ":", 2)[1].alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    mine, theirs = one(original), one(canonical)
    return F.map_from_entries(F.concat(F.filter(theirs, lambda t: ~F.exists(mine, lambda m: m["key"] == t["key"])), mine))


def search_games(games: DataFrame, term: str = "") -> DataFrame:
    """A profile's games (key, game, title) whose title holds ``term``, in order of title and id within each profile."""
    low = term.strip().lower()
    return games.where(F.lower("title").contains(low)) if low else games


def assignable(unbound: DataFrame, totals: DataFrame) -> DataFrame:
    """(artwork_set, key): the empty profiles that each unbound set could be assigned to, by its platforms."""
    empty = totals.where("empty").select("platform", "key")
    return unbound.select("artwork_set", F.explode("platforms").alias("platform")).join(empty, "platform").select("artwork_set", "key").distinct()


def profile_of_set(sets: DataFrame, profiles: DataFrame) -> DataFrame:
    """(artwork_set, key): the first profile (by seq) that binds each set; null if none does."""
    first = profiles.where("artwork != ''").groupBy(F.col("artwork").alias("artwork_set")).agg(F.min_by("key", "seq").alias("key"))
    return sets.where("artwork_set != ''").join(first, "artwork_set", "left").select("artwork_set", "key")


def card_roles(roles: DataFrame, most: int = 6) -> DataFrame:
    """(key, place, role, n): the roles on a profile's card, those of most games first; tasks keep their own first ``most`` by profile."""
    w = Window.partitionBy("key").orderBy(F.desc("n"), "role")
    return roles.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("key", "place", "role", "n")
