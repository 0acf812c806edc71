"""Files as typed observations; summaries, histograms, duplicates, validation issues, identity proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.cuts import spread

GENERATED = ("steam-grid", "esde-media", "decky-catalog")


def observations(raw: DataFrame) -> DataFrame:
    """Raw file facts (seq, root_id, root_kind, configured_system, path, size, sha256, mime, width, height) with all that paths tell."""
    kind, path = F.col("root_kind"), F.col("path")
    out = spread(raw).withColumns({"__low": F.lower(path), "__parts": F.split(path, "/")})  # each step once: later ones refer to it
    out = out.withColumns({"extension": S.extension(path), "__stem": S.stem(path), "__parent": S.parent_name(F.col("__low")), "__guids": S.guids(F.col("__parts"))})
    name = F.when(F.col("extension") == "", S.base_name(F.col("__low"))).otherwise(F.lower("__stem"))
    out = out.withColumns({"__name": name, "system": S.system(kind, F.col("__parts"), F.col("configured_system"))})
    out = out.withColumns({
        "role": S.role(kind, F.col("__low"), F.col("extension"), F.col("__name"), F.col("__parent")),
        "identity_hint": S.identity_hint(kind, F.col("__low"), F.col("__parts"), F.col("__stem"), F.col("__guids"), F.col("system")),
        "dimensions": S.dimension_key(F.col("width"), F.col("height")),
        "observation_id": S.observation_id(F.col("root_id"), path),
    })
    return out.drop("__low", "__parts", "__stem", "__parent", "__guids", "__name")


def issues(obs: DataFrame) -> DataFrame:
    """(seq, root_id, path, code, message): roles and extensions that content contradicts."""
    mime, role, ext = F.col("mime"), F.col("role"), F.col("extension")
    wrong_role = (
        F.when(role == "", None)
        .when((role == "manual") & (mime != "application/pdf"), F.concat(F.lit("manual must be PDF, got "), mime))
        .when((role == "video") & ~mime.startswith("video/"), F.concat(F.lit("video role has non-video MIME "), mime))
        .when(~role.isin("manual", "video") & ~mime.startswith("image/"), F.concat(role, F.lit(" role has non-image MIME "), mime))
    )
    want = S.lookup(S.MIME_OF_EXTENSION, ext)
    sized = want.startswith("image/") & ~want.isin("image/webp", "image/x-icon")
    wrong_type = (
        F.when(want.isNull(), None)
        .when(mime != want, F.concat(F.lit("."), ext, F.lit(" content has MIME "), mime, F.lit(", expected "), want))
        .when(sized & ((F.col("width") < 1) | (F.col("height") < 1)), F.concat(F.lit("."), ext, F.lit(" image dimensions could not be decoded")))
    )
    found = F.array(F.struct(F.lit("role-media-mismatch").alias("code"), wrong_role.alias("message")), F.struct(F.lit("media-type-mismatch").alias("code"), wrong_type.alias("message")))
    return obs.select("seq", "root_id", "path", F.explode(F.filter(found, lambda x: x["message"].isNotNull())).alias("i")).select("seq", "root_id", "path", "i.code", "i.message")


def root_summary(obs: DataFrame) -> DataFrame:
    image, mime = F.col("mime").startswith("image/"), F.col("mime")
    return obs.groupBy("root_id").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("total_bytes"),
        F.count_if(image | mime.startswith("video/") | (mime == "application/pdf")).alias("media_count"), F.count_if(image).alias("image_count"),
    )


def histogram(obs: DataFrame, column: str) -> DataFrame:
    """(root_id, key, n), empty keys left out; nested as a sorted map by ``histograms``."""
    return obs.where(F.col(column) != "").groupBy("root_id", F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def histograms(obs: DataFrame, column: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("key", "n")))
    return histogram(obs, column).groupBy("root_id").agg(pairs.alias("pairs")).select("root_id", F.map_from_entries("pairs").alias(column))


def duplicate_groups(obs: DataFrame) -> DataFrame:
    """(sha256, size, copies, roots) of each repeated content."""
    return obs.groupBy("sha256").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.count_distinct("root_id").alias("roots")).where("copies > 1")


def duplicate_occurrences(obs: DataFrame) -> DataFrame:
    """A row an occurrence of a repeated content, with the content's figures: however many copies there are, no row holds them all."""
    return obs.select("sha256", "root_id", "path").join(duplicate_groups(obs), "sha256")


def duplicate_summary(obs: DataFrame) -> DataFrame:
    """One row; contents are counted before anything is gathered, so no list of a content's copies is made."""
    per = obs.groupBy("sha256").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("root_id").alias("lo"), F.max("root_id").alias("hi"))
    many = F.col("n") > 1
    return per.agg(
        F.count_if(many).alias("groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("copies"),
        F.coalesce(F.sum(F.when(many, (F.col("n") - 1) * F.col("size"))), F.lit(0)).alias("excess_bytes"),
        F.count_if(many & (F.col("lo") != F.col("hi"))).alias("cross_root_groups"), F.count(F.lit(1)).alias("unique_hashes"),
    )


def duplicate_view(obs: DataFrame, generated: tuple[str, ...] = GENERATED) -> DataFrame:
    """Repeated contents with their class: whether generated output is among the copies."""
    is_generated = F.col("root_kind").isin(*generated)
    per = obs.groupBy("sha256").agg(F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.bool_or(is_generated).alias("some"), F.bool_and(is_generated).alias("every")).where("copies > 1")
    label = F.when(F.col("some") & ~F.col("every"), "expected-copy").when(F.col("every"), "review").otherwise("canonical-opportunity")
    return per.select("sha256", "size", "copies", label.alias("classification"))


def proposals(obs: DataFrame) -> DataFrame:
    hint = F.col("identity_hint")
    retro = hint.startswith("retro:")
    return obs.where(hint != "").select(
        "root_id", "path", hint.alias("canonical_id"),
        F.when(hint.startswith("steam:"), "steam-appid").when(hint.startswith("playnite:"), "playnite-adapter").when(retro, "retro-filename-alias").otherwise("").alias("mapping_type"),
        F.when(retro, "proposal").otherwise("high").alias("confidence"),
        F.when(retro, "ROM stem is a mutable alias; content hash is required for release identity").otherwise("deterministic source convention").alias("reason"),
    )


def unmapped(obs: DataFrame) -> DataFrame:
    return obs.where("identity_hint = ''").select("root_id", "path", F.lit("no deterministic identity in source path").alias("reason"))


def overview(obs: DataFrame, found: DataFrame) -> DataFrame:
    """Root summaries with their numbers of issues, by root."""
    counts = found.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))
    return root_summary(obs).join(counts, "root_id", "left").withColumn("issue_count", F.coalesce("n", F.lit(0))).drop("n").orderBy("root_id")


def sanitized_issues(found: DataFrame) -> DataFrame:
    """Issues without paths, counted by root and code; observations are left out altogether."""
    return found.withColumn("path", F.lit("")).groupBy("root_id", "path", "code").agg(F.count(F.lit(1)).alias("n"))


def point_lookup(obs: DataFrame, observation_id: str | Column) -> DataFrame:
    return obs.where(F.col("observation_id") == observation_id).limit(1)


def identity_view(obs: DataFrame) -> DataFrame:
    """(id, mapped, identity_hint): every observation by its id, as a proposal or as unmapped."""
    return obs.select(F.col("observation_id").alias("id"), (F.col("identity_hint") != "").alias("mapped"), "identity_hint")


def rows_digest(rows: DataFrame) -> DataFrame:
    """(n, digest) of a whole table: rows are digested by their columns in order of name, then by the first three digits of these
    digests, then all together. The order of the rows doesn't matter, and no task holds more than a 4096th of them."""
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(rows.columns))), 256)
    per = rows.select(row.alias("r")).groupBy(F.substring("r", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("r")), ""), 256).alias("d"))
    return per.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
