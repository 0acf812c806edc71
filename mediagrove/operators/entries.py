"""Listings of directory entries: which of a tree's files and folders are systems, manifests, profiles, artwork, artifacts, drafts, themes.

``entries``: (root, path relative to it with forward slashes, type: file, dir or link), a row an entry. All are filters on the path, so they
push no work beyond the listing itself; only counts and existence checks shuffle, by root and id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

# Names that histories never list.
NEVER_LISTED = ("applied.json", "rolled-back.json")


def _is(kind: str) -> Column:
    return F.col("type") == kind


def _direct(folder: str) -> Column:
    """The name of an entry that stands directly in ``folder``; null for others."""
    name = F.regexp_extract("path", "^" + ("" if not folder else folder.replace(".", r"\.") + "/") + r"([^/]+)\z", 1)
    return F.when(name != "", name)


def app_manifests(entries: DataFrame) -> DataFrame:
    """(root, path): application manifests in a library's folder; their names in any case, folders don't count."""
    low = F.lower(_direct("steamapps"))
    return entries.where(~_is("dir") & low.startswith("appmanifest_") & low.endswith(".acf")).select("root", "path")


def systems(entries: DataFrame) -> DataFrame:
    """(root, system, path of its game list): folders with names of letters, digits, dash and underscore."""
    name = _direct("")
    safe = entries.where(_is("dir") & name.rlike(r"^[A-Za-z0-9_-]+\z"))
    return safe.select("root", F.lower(name).alias("system"), F.concat("path", F.lit("/gamelist.xml")).alias("gamelist"))


def profile_documents(entries: DataFrame, folder: str = "profiles") -> DataFrame:
    """(root, id, path): JSON files of the profile folder that aren't links; their extension in any case."""
    name = _direct(folder)
    return entries.where(_is("file") & S.folded(name).endswith(".json")).select("root", F.regexp_replace(name, r"\.[^.]*\z", "").alias("id"), "path")


def artwork_counts(entries: DataFrame, profiles: DataFrame) -> DataFrame:
    """(root, id, n): files below the artwork folder of each profile (root, id, artwork); the empty-profile marker isn't artwork."""
    parts = F.split("path", "/")
    inside = entries.where(~_is("dir") & (parts[0] == "artwork") & (F.size(parts) >= 3) & (S.base_name(F.col("path")) != S.MARKER))
    n = inside.groupBy("root", parts[1].alias("artwork")).agg(F.count(F.lit(1)).alias("n"))
    return profiles.join(n, ["root", "artwork"], "left").select("root", "id", F.coalesce("n", F.lit(0)).alias("n"))


def artifacts(entries: DataFrame) -> DataFrame:
    """(root, type, path): plans and reviews of the three gates at any depth; only JSON, and no reserved names."""
    name = S.base_name(F.col("path"))
    gate = F.regexp_extract("path", "^gate-reviews/([abc])/", 1)
    kind = F.when(F.col("path").startswith("plans/"), "plan").when(gate != "", F.concat(F.lit("gate-"), gate))
    # a name that is its extension alone still has that extension
    return entries.where(~_is("dir") & kind.isNotNull() & name.endswith(".json") & ~name.isin(*NEVER_LISTED)).select("root", kind.alias("type"), "path")


def draft_ids(entries: DataFrame) -> DataFrame:
    """(root, id): drafts by their file names, safe ids only."""
    found = F.regexp_extract(_direct("drafts"), r"^profile-(.*)\.json\z", 1)
    return entries.where(~_is("dir") & S.safe_id(found)).select("root", found.alias("id"))


def theme_ids(entries: DataFrame) -> DataFrame:
    """(root, id): theme folders of safe names that hold a theme file."""
    parts = F.split("path", "/")
    theme = (parts[0] == "library") & (parts[1] == "themes")
    folders = entries.where(_is("dir") & theme & (F.size(parts) == 3) & S.safe_id(parts[2])).select("root", parts[2].alias("id"))
    files = entries.where(~_is("dir") & theme & (F.size(parts) == 4) & (parts[3] == "theme.json")).select("root", parts[2].alias("id"))
    return folders.join(files.distinct(), ["root", "id"], "left_semi")
