"""Scalar expressions on paths, identities, titles and sizes. All are built-in column functions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the catalog's vocabulary.
ROLE_OF_DIRECTORY = {
    "3dboxes": "cover", "backcovers": "cover", "covers": "cover", "custom": "custom", "fanart": "fanart", "manuals": "manual",
    "marquees": "marquee", "miximages": "miximage", "physicalmedia": "physicalmedia", "screenshots": "screenshot",
    "titlescreens": "titlescreen", "videos": "video",
}
SYSTEM_NAMES = {
    "3ds": "Nintendo 3DS", "gc": "Nintendo GameCube", "gamecube": "Nintendo GameCube", "gb": "Game Boy", "gba": "Game Boy Advance",
    "gbc": "Game Boy Color", "genesis": "Sega Genesis", "megadrive": "Sega Mega Drive", "n64": "Nintendo 64", "nds": "Nintendo DS",
    "nes": "Nintendo Entertainment System", "ps2": "PlayStation 2", "ps3": "PlayStation 3", "psp": "PlayStation Portable",
    "saturn": "Sega Saturn", "snes": "Super Nintendo Entertainment System", "switch": "Nintendo Switch", "wii": "Nintendo Wii", "wiiu": "Nintendo Wii U",
}
SOURCE_NAMES = {
    "steam-grid": "Steam custom artwork", "playnite-library": "Playnite library", "playnite-extra": "Playnite ExtraMetadata",
    "decky-catalog": "Deck Gaming Profiles", "esde-media": "RetroDECK / ES-DE", "romm": "RomM",
}
EXPECTED_ROLES = ["grid", "portrait", "cover", "hero", "logo", "icon", "banner", "marquee", "screenshot", "fanart", "miximage", "physicalmedia", "manual", "video"]
MIME_OF_EXTENSION = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "ico": "image/x-icon", "pdf": "application/pdf", "mp4": "video/mp4"}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
APP_FILE = r"^([0-9]+)(p|_hero|_logo|_icon)?\z"
MARKER = ".deck-profile-empty"
IMAGES = ["png", "jpg", "jpeg", "webp", "ico"]


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of a fixed table, or null."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


@functools.cache
def fold_table() -> tuple[str, str]:
    """Characters and what simple case folding makes of them, one for one: the characters that single upper, lower or title cases lead to are one, named by its ASCII letter or else its
    first. The dotted capital and the dotless small i fold to themselves, as outside the Turkic rules."""
    same: dict[str, set[str]] = {}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x1F000)]):
        for d in (c.lower(), c.upper(), c.title()):
            if len(d) == 1 and d != c and not {c, d} & {"\u0130", "\u0131"}:
                both = same.get(c, {c}) | same.get(d, {d})
                same.update(dict.fromkeys(both, both))
    named = {c: next((x for x in sorted(every) if "a" <= x <= "z"), min(every)) for c, every in same.items()}
    moved = sorted((c, x) for c, x in named.items() if c != x)
    return "".join(c for c, _ in moved), "".join(x for _, x in moved)


def folded(value: Column) -> Column:
    """Text under simple case folding: equal for texts that differ in case alone, by any script's rule (ſ is an s, the Kelvin sign a k, ß isn't ss)."""
    return F.when(value.rlike(r"^[\x00-\x7F]*\z"), F.lower(value)).otherwise(F.translate(value, *fold_table()))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """The last extension in lower case, without its dot; none for a name whose only dot is its first character."""
    name = base_name(path)
    return F.when(name.rlike(r"^\.[^.]*\z"), F.lit("")).otherwise(F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)))


def stem(path: Column) -> Column:
    """The base name without its last extension, even where that leaves nothing."""
    return F.regexp_replace(base_name(path), r"\.[^.]*\z", "")


def slug(value: Column, empty: str = "item") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(trim(value)), "[^a-z0-9]+", "-"), r"^-|-\z", "")
    return F.when(out == "", F.lit(empty)).otherwise(out) if empty else out


def trim(value: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")


def safe_path_key(value: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9._-]", "-"), r"^-+|-+\z", "")
    return F.concat(F.when(kept == "", F.lit("item")).otherwise(kept), F.lit("--"), F.substring(F.sha2(value, 256), 1, 12))


def is_image(ext: Column) -> Column:
    return ext.isin(IMAGES)


def grid_kind(kind: Column, path: Column) -> Column:
    return kind.isin("steam-grid", "decky-catalog") | F.lower(path).contains("/grid/")


def role(kind: Column, low: Column, ext: Column, name: Column, parent: Column) -> Column:
    """The artwork role a path stands for, '' if none: its directory, its name, or its numbered file name. All but ``kind`` are of
    the path in lower case: itself, its extension, its name without that, its directory's name."""
    numbered = is_image(ext) & grid_kind(kind, low) & name.rlike(APP_FILE)
    suffix = F.regexp_extract(name, APP_FILE, 2)
    return F.coalesce(
        lookup(ROLE_OF_DIRECTORY, parent),
        F.when(name == "logo", "logo").when(name.isin("videotrailer", "videomicrotrailer"), "video"),
        F.when((kind == "playnite-library") & is_image(ext) & name.rlike(UUID), "cover"),
        F.when(numbered, F.when(suffix == "p", "portrait").when(suffix == "", "grid").otherwise(F.ltrim(suffix, F.lit("_")))),
        F.lit(""),
    )


def system(kind: Column, parts: Column, configured: Column) -> Column:
    return F.when(configured != "", configured).when((kind == "esde-media") & (F.size(parts) >= 3), F.lower(parts[0])).otherwise(F.lit(""))


def guids(parts: Column) -> Column:
    return F.filter(parts, lambda p: p.rlike(UUID))


def identity_hint(kind: Column, low: Column, parts: Column, name: Column, anywhere: Column, system_: Column) -> Column:
    """The identity a path stands for, '' if none. ``low``: the path in lower case; ``name``: its stem; ``anywhere``: its ``guids``."""
    guid = lambda p: p.rlike(UUID)
    folders = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), guid)
    return F.coalesce(
        F.when(grid_kind(kind, low) & F.lower(name).rlike(APP_FILE), F.concat(F.lit("steam:"), F.regexp_extract(F.lower(name), APP_FILE, 1))),
        F.when((kind == "playnite-library") & (F.size(folders) > 0), F.concat(F.lit("playnite:"), F.lower(F.element_at(folders, -1)))),
        F.when((kind == "playnite-library") & (F.size(parts) == 1) & guid(name), F.concat(F.lit("playnite:"), F.lower(name))),
        F.when(F.size(anywhere) > 0, F.concat(F.lit("playnite:"), F.lower(F.element_at(anywhere, 1)))),
        F.when((kind == "esde-media") & (system_ != ""), F.concat(F.lit("retro:"), system_, F.lit(":"), slug(name))),
        F.lit(""),
    )


def dimension_key(width: Column, height: Column) -> Column:
    return F.when((width == 0) | (height == 0), F.lit("")).otherwise(F.concat_ws("x", width.cast("string"), height.cast("string")))


def observation_id(root_id: Column, path: Column) -> Column:
    return F.sha2(F.concat(root_id, F.char(F.lit(0)), path), 256)


def artwork_set(kind: Column, path: Column) -> Column:
    parts = F.split(path, "/")
    fits = (kind == "decky-catalog") & (F.size(parts) >= 3) & (parts[0] == "artwork") & (base_name(path) != MARKER)
    return F.when(fits, parts[1]).otherwise(F.lit(""))


def asset_path(sha: Column, ext: Column, default: str = "bin") -> Column:
    low = F.regexp_replace(F.lower(ext), r"^\.", "")
    return F.concat_ws("/", F.lit("library/assets/sha256"), F.substring(sha, 1, 2), sha, F.concat(F.lit("content."), F.when(low == "", F.lit(default)).otherwise(low)))


def system_name(key: Column) -> Column:
    low = F.lower(trim(key))
    words = trim(F.regexp_replace(low, r"[\s._-]+", " "))
    return F.coalesce(lookup(SYSTEM_NAMES, low), F.when(words == "", F.lit("Other")).otherwise(F.initcap(words)))


def source_name(kind: Column) -> Column:
    return F.coalesce(lookup(SOURCE_NAMES, kind), system_name(kind))


def clean_title(value: Column) -> Column:
    cut = F.regexp_replace(trim(value), r"(?i)(?:\s*[\(\[][^\(\)\[\]]*[\)\]]\s*)+\z", "")
    out = trim(F.regexp_replace(trim(cut), r"[\s._-]+", " "))
    return F.when(out == "", F.lit("Untitled game")).otherwise(out)


def short_id(value: Column) -> Column:
    return F.when(F.octet_length(value) > 8, F.concat(F.substring(value, 1, 8), F.lit("…"))).otherwise(value)


def namespace(identity: Column) -> Column:
    return F.split(identity, ":", 2)[0]


def disambiguated(system_: Column, raw_stem: Column) -> Column:
    return F.concat(F.lit("retro:"), system_, F.lit(":"), slug(raw_stem), F.lit("~"), F.substring(F.sha2(raw_stem, 256), 1, 8))


def platform_of_identity(identity: Column, fallback: Column) -> Column:
    parts = F.split(identity, ":", 3)
    return F.when(identity.startswith("steam:"), F.lit("steam")).when(identity.startswith("playnite:"), F.lit("playnite")).when(identity.startswith("retro:") & (F.size(parts) == 3), F.concat(F.lit("retro:"), parts[1])).otherwise(fallback)


def platform_name(platform: Column) -> Column:
    return (
        F.when(platform == "steam", F.lit("Steam")).when(platform == "playnite", F.lit("Playnite"))
        .when(platform.startswith("retro:") | platform.startswith("system:"), system_name(F.split(platform, ":", 2)[1])).otherwise(F.lit("Other"))
    )


def platform_of_observation(hint: Column, kind: Column, system_: Column) -> Column:
    own = F.when(system_ != "", system_).otherwise(F.split(hint, ":")[1])
    return (
        F.when(hint.startswith("retro:"), F.concat(F.lit("retro:"), own))
        .when(hint.startswith("steam:") | kind.isin("steam-grid", "decky-catalog"), F.lit("steam"))
        .when(hint.startswith("playnite:"), F.lit("playnite"))
        .when(system_ != "", F.concat(F.lit("system:"), system_)).otherwise(F.lit("other"))
    )


def folded_platform(platform: Column) -> Column:
    return F.when(platform.startswith("retro:"), F.lit("retro")).otherwise(platform)


def profile_key(platform: Column, name: Column) -> Column:
    return F.concat(platform, F.lit("/"), slug(name, ""))


def title_priority(source: Column) -> Column:
    return F.when(source.isin("steam-appinfo", "esde-gamelist"), 10).when(source == "steam-manifest", 20).when(source == "steam-shortcut", 30).when(source == "playnite", 40).otherwise(100)


def store_name(plugin: Column, steam_plugin: str) -> Column:
    low = F.lower(trim(plugin))
    return F.when(low == steam_plugin, F.lit("Steam")).when(low.isin("", "00000000-0000-0000-0000-000000000000"), F.lit("Manually added")).otherwise(F.lit("Other library"))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, cut off; null of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole)).cast("long")


def scaled(width: Column, height: Column, most: int = 320) -> tuple[Column, Column]:
    """Width and height that fit into a square of ``most``, never larger, at least 1."""
    big = F.greatest(width, height)
    fit = lambda side: F.when(big <= most, side).otherwise(F.greatest(F.lit(1), F.floor(side * most / big)))
    return fit(width).cast("long"), fit(height).cast("long")


def human_bytes(n: Column) -> Column:
    """Bytes by powers of 1024 with one decimal, plain below 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.round(n / 1024**k, 1).cast("decimal(20,1)").cast("string"), F.lit(" " + unit))).otherwise(out)
    return out


def human_age(seconds: Column) -> Column:
    whole = lambda per, unit: F.concat(F.floor(seconds / per).cast("string"), F.lit(unit))
    return F.when(seconds < 60, whole(1, "s ago")).when(seconds < 3600, whole(60, "m ago")).when(seconds < 86400, whole(3600, "h ago")).otherwise(whole(86400, "d ago"))


def age_seconds(now: Column, then: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(then)), F.lit(0)).cast("long")


def parse_rfc3339(text: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text), fallback)


def plain_id(value: Column) -> Column:
    """Ids of small letters, digits, dots, dashes and underscores that begin with a letter or digit."""
    return value.rlike(r"^[a-z0-9][a-z0-9._-]*\z")


def safe_id(value: Column) -> Column:
    """Path-safe ids: plain ones that aren't a device name of old file systems, with or without a dot at the end."""
    return plain_id(value) & ~F.regexp_replace(value, r"\.\z", "").rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])\z")


def safe_relative_path(value: Column) -> Column:
    """A relative path with forward slashes that doesn't leave its root: no step goes above where it began."""
    steps = F.filter(F.split(value, "/"), lambda p: ~p.isin("", "."))
    depth = F.aggregate(steps, F.lit(0), lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).otherwise(d + 1))
    return (value != "") & ~value.contains("\\") & ~value.contains("\0") & ~value.startswith("/") & ~value.rlike("^.:") & (depth > 0)


def sha256_text(value: Column) -> Column:
    return value.rlike(r"^[0-9a-f]{64}\z")


def guid_text(raw: Column) -> Column:
    """The text of a 16-byte GUID whose first three fields are little-endian; null for other lengths."""
    h = F.lower(F.hex(raw))
    at = lambda *places: F.concat(*(F.substring(h, 2 * k + 1, 2) for k in places))
    return F.when(F.octet_length(raw) == 16, F.concat_ws("-", at(3, 2, 1, 0), at(5, 4), at(7, 6), F.substring(h, 17, 4), F.substring(h, 21, 12)))
