"""Titles, aliases and stores of identities from several sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.cuts import cut, release

STEAM_PLUGIN = "cb91dfc9-b977-43bf-8e70-55f46e410fab"


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(identity, canonical, ambiguous) of (identity, canonical): canonical only where all statements agree."""
    clean = aliases.select(S.trim(F.col("identity")).alias("identity"), S.trim(F.col("canonical")).alias("canonical")).where("identity != '' AND canonical != '' AND identity != canonical")
    per = clean.groupBy("identity").agg(F.min("canonical").alias("lo"), F.max("canonical").alias("hi"))
    return per.select("identity", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("canonical"), (F.col("lo") != F.col("hi")).alias("ambiguous"))


def resolve_titles(titles: DataFrame) -> DataFrame:
    """(identity, title, source) of (seq, identity, title, source): the best source, then the first statement."""
    clean = titles.select("seq", S.trim(F.col("identity")).alias("identity"), S.trim(F.col("title")).alias("title"), "source").where("identity != '' AND title != ''")
    best = clean.groupBy("identity").agg(F.min_by(F.struct("title", "source"), F.struct(S.title_priority(F.col("source")), F.col("seq"))).alias("t"))
    return best.select("identity", "t.title", "t.source")


def resolve_stores(stores: DataFrame) -> DataFrame:
    """(identity, store) of (seq, identity, store): the first statement."""
    clean = stores.select("seq", S.trim(F.col("identity")).alias("identity"), S.trim(F.col("store")).alias("store")).where("identity != '' AND store != ''")
    return clean.groupBy("identity").agg(F.min_by("store", "seq").alias("store"))


def closure(aliases: DataFrame) -> DataFrame:
    """(identity, canonical) for the identities that have an alias: the end of their chain, however long; a chain that runs into a
    circle leaves them where they are. ``aliases`` is what ``resolve_aliases`` gives.

    Only the alias edges meet themselves, by pointer doubling: after round k each identity has followed 2^k links or come to its
    chain's end. Of the chains that do end, the identity 2^k + 1 links from the end comes to it in the next round; so once a round
    brings no identity to an end, those still under way reach some identity again, and their chains are circles.
    """
    edge = aliases.where("canonical is not null").select("identity", "canonical")
    heads = edge.select(F.col("identity").alias("canonical"), F.lit(True).alias("open"))
    out = cut(edge.join(heads, "canonical", "left").select("identity", "canonical", F.coalesce("open", F.lit(False)).alias("open")))
    left, before = out.where("open").count(), None
    while left and left != before:
        hop = out.select(F.col("identity").alias("canonical"), F.col("canonical").alias("next"), F.col("open").alias("more"))
        moved = out.where("open").select("identity", "canonical").join(hop, "canonical").select("identity", F.col("next").alias("canonical"), F.col("more").alias("open"))
        last, out = out, cut(out.where("not open").unionByName(moved))
        release(last)
        left, before = out.where("open").count(), left
    return out.select("identity", F.when(F.col("open"), F.col("identity")).otherwise(F.col("canonical")).alias("canonical"))


def with_titles(rows: DataFrame, column: str, ends: DataFrame, titles: DataFrame) -> DataFrame:
    """``rows`` with canonical (the end of ``column``'s chain, by ``closure``) and known_title: the canonical's title, else its own, else null."""
    ends = ends.select(F.col("identity").alias(column), F.col("canonical").alias("__end"))
    out = rows.join(ends, column, "left").withColumn("canonical", F.coalesce("__end", F.col(column))).drop("__end")
    own = titles.select(F.col("identity").alias(column), F.col("title").alias("__own"))
    theirs = titles.select(F.col("identity").alias("canonical"), F.col("title").alias("__theirs"))
    return out.join(theirs, "canonical", "left").join(own, column, "left").withColumn("known_title", F.coalesce("__theirs", "__own")).drop("__theirs", "__own")


def display_titles(identities: DataFrame, aliases: DataFrame, titles: DataFrame) -> DataFrame:
    """(identity, canonical, title) of each identity."""
    return with_titles(identities.select("identity").distinct(), "identity", closure(aliases), titles).select("identity", "canonical", F.col("known_title").alias("title"))


def first_titles(entries: DataFrame) -> DataFrame:
    """(app_id, title) of (app_id, title, source_rank, seq): the first source that names an app."""
    return entries.where("title != ''").groupBy("app_id").agg(F.min_by("title", F.struct("source_rank", "seq")).alias("title"))


def gamelist_titles(entries: DataFrame) -> DataFrame:
    """(identity, title) of (seq, system, raw_stem, name): stems with several names are left out, stems of one slug told apart."""
    per = entries.groupBy("system", "raw_stem").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    base = F.concat(F.lit("retro:"), F.col("system"), F.lit(":"), S.slug(F.col("raw_stem")))
    stems = per.withColumn("base", base)
    many = stems.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    identity = F.when(F.col("n") > 1, S.disambiguated(F.col("system"), F.col("raw_stem"))).otherwise(F.col("base"))
    return stems.join(many, "base").where("name = other").select(identity.alias("identity"), F.col("name").alias("title"))


def library_aliases(games: DataFrame, steam_plugin: str) -> DataFrame:
    """(identity, canonical) of (guid, plugin, game_id): a game of the store's plugin whose id is an unsigned 32-bit number is that app."""
    app = F.expr("try_cast(game_id AS BIGINT)")
    fits = (F.lower("plugin") == steam_plugin) & F.col("game_id").rlike(r"^[0-9]+\z") & (app > 0) & (app <= 4294967295)
    return games.where(fits).select(F.concat(F.lit("playnite:"), F.lower("guid")).alias("identity"), F.concat(F.lit("steam:"), app.cast("string")).alias("canonical"))


def merge(*parts: DataFrame) -> DataFrame:
    """The statements of several readings in one table, later ones after earlier ones: their sequence numbers become (part, seq)."""
    numbered = [p.withColumn("seq", F.struct(F.lit(k).alias("part"), F.col("seq"))) for k, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Resolved:
    titles: DataFrame
    aliases: DataFrame
    stores: DataFrame
    diagnostics: DataFrame


def resolve_all(said: DataFrame, steam_plugin: str = STEAM_PLUGIN) -> Resolved:
    """Titles, aliases (with the ambiguous ones), stores and ordered diagnostics of ``said``, the statements of metadata files.

    An app's title is that of the first source that names it: application info, manifests, shortcuts; files by seq, then by place. Game lists and
    the library follow; of titles of one identity the best source's counts, then the first.
    """
    at = F.struct("seq", "place")
    rank = F.when(F.col("source") == "steam-appinfo", 0).when(F.col("source") == "steam-manifest", 1).otherwise(2)
    apps = said.where("what = 'app' and trim(text) != ''").groupBy("id").agg(F.min_by(F.struct("text", "source"), F.struct(rank, at)).alias("t"))
    apps = apps.select(F.lit(None).cast(said.select(at.alias("s")).schema["s"].dataType).alias("seq"), F.concat(F.lit("steam:"), "id").alias("identity"), F.col("t.text").alias("title"), F.col("t.source").alias("source"))
    games = said.where("what = 'game'").withColumn("identity", F.concat(F.lit("playnite:"), F.lower("id")))
    named = games.select(at.alias("seq"), "identity", F.col("text").alias("title"), "source")
    roms = said.where("what = 'rom'").select(at.alias("seq"), F.regexp_replace("source", "^esde:", "").alias("system"), F.col("id").alias("raw_stem"), F.col("text").alias("name"))
    listed = gamelist_titles(roms).select(F.lit(None).cast(apps.schema["seq"].dataType).alias("seq"), "identity", "title", F.lit("esde-gamelist").alias("source"))
    titles = resolve_titles(merge(apps, named, listed))
    stores = resolve_stores(games.select(at.alias("seq"), "identity", S.store_name(F.col("plugin"), steam_plugin).alias("store")))
    own = library_aliases(games.select(F.col("id").alias("guid"), F.trim("plugin").alias("plugin"), F.trim("game_id").alias("game_id")), steam_plugin)
    aliases = resolve_aliases(own)

    def say(rows: DataFrame, source, status: str, message: str) -> DataFrame:
        return rows.select(source.alias("source"), F.lit(status).alias("status"), F.lit(message).alias("message"))

    system = F.concat(F.lit("esde:"), "system")
    first = roms.groupBy("system", "raw_stem").agg(F.min_by("name", "seq").alias("first"))
    conflicts = roms.join(first, ["system", "raw_stem"]).where("name != first")
    alike = first.groupBy("system", S.slug(F.col("raw_stem")).alias("base")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    notes = [
        said.where("what = 'diagnostic'").select("source", F.col("id").alias("status"), F.col("text").alias("message")),
        say(conflicts, system, "needs-attention", "Conflicting ES-DE names were kept separate."),
        say(alike, system, "needs-attention", "Similar ROM file names were kept as separate games."),
        say(aliases.where("ambiguous"), F.lit("identity"), "needs-attention", "Conflicting exact identities were kept separate."),
    ]
    diagnostics = notes[0]
    for n in notes[1:]:
        diagnostics = diagnostics.unionByName(n)
    return Resolved(titles, aliases, stores, diagnostics)
