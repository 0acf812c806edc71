"""Documents' constraints as issue rows, source detection, ledgers of reviews and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

KINDS = ("steam-grid", "playnite-library", "playnite-extra", "decky-catalog", "esde-media", "romm")
ROLES = (*S.EXPECTED_ROLES, "titlescreen", "custom", "other")


def invalid_roots(roots: DataFrame) -> DataFrame:
    """(id, problem) of roots (id, kind, path): unsafe, repeated or case-colliding ids, and unknown kinds."""
    say = lambda where, text: roots.where(where).select("id", F.lit(text).alias("problem"))
    many = roots.groupBy(F.lower("id").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("spellings")).where("n > 1")
    again = roots.join(many, F.lower("id") == F.col("key")).select("id", F.when(F.col("spellings") > 1, "ids differ only in case").otherwise("duplicate id").alias("problem"))
    return say(~S.safe_id(F.col("id")), "unsafe id").unionByName(say(~F.col("kind").isin(*KINDS), "unknown kind")).unionByName(again).distinct()


def invalid_selections(selected: DataFrame) -> DataFrame:
    """(profile, game_id, role, problem) of selections that a profile may not hold."""
    problem = F.when(~S.sha256_text(F.col("sha256")), "invalid SHA-256").when(~F.col("role").isin(*ROLES), "unknown role").when(~F.lower("extension").rlike(r"^\.?[a-z0-9]{1,16}\z"), "unsafe extension")
    return selected.select("profile", "game_id", "role", problem.alias("problem")).where("problem is not null")


def invalid_topology(profiles: DataFrame, platforms: DataFrame, devices: DataFrame) -> DataFrame:
    """(what, key, problem): profiles and devices of unknown platforms, profile keys and bound sets that repeat."""
    known = platforms.select(F.col("id").alias("platform"))
    keyed = profiles.withColumn("key", S.profile_key(F.col("platform"), F.col("name")))
    orphans = keyed.join(known, "platform", "left_anti").select(F.lit("profile").alias("what"), "key", F.lit("unknown platform").alias("problem"))
    repeats = keyed.groupBy("key").count().where("count > 1").select(F.lit("profile").alias("what"), "key", F.lit("duplicate key").alias("problem"))
    bound = keyed.where("artwork != ''").groupBy("artwork").count().where("count > 1").select(F.lit("profile").alias("what"), F.col("artwork").alias("key"), F.lit("artwork set is bound twice").alias("problem"))
    stray = devices.select("id", F.explode("platforms").alias("platform")).join(known, "platform", "left_anti").select(F.lit("device").alias("what"), F.col("id").alias("key"), F.lit("unknown platform").alias("problem"))
    return orphans.unionByName(repeats).unionByName(bound).unionByName(stray)


def detected_ids(candidates: DataFrame) -> DataFrame:
    """Candidates (base, path) with unique ids: base, base-2, base-3 by path; paths that repeat but for case are one."""
    once = candidates.withColumn("key", F.lower("path")).groupBy("key").agg(F.min(F.struct("path", "base")).alias("c")).select("c.*")
    n = F.row_number().over(Window.partitionBy("base").orderBy("path"))
    return once.withColumn("n", n).select(F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))).alias("id"), "path")


def configured_flags(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.select(F.lower("path").alias("key")).distinct().withColumn("configured", F.lit(True))
    out = candidates.withColumn("key", F.lower("path")).join(known, "key", "left").drop("key")
    return out.withColumn("configured", F.coalesce("configured", F.lit(False))).withColumn("status", F.when(F.col("configured"), "configured").otherwise("available"))


def missing_kinds(present: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Supported kinds that neither detection nor configuration has; an extra-metadata folder stands for its library too."""
    spark = present.sparkSession
    implied = present.where("kind = 'playnite-extra'").select(F.lit("playnite-library").alias("kind"))
    return spark.createDataFrame([(k,) for k in kinds], "kind string").join(present.select("kind").union(implied).distinct(), "kind", "left_anti")


def drafts_over_live(drafts: DataFrame, live: DataFrame) -> DataFrame:
    """Profiles by id: a draft hides the live profile of its id."""
    return drafts.withColumn("state", F.lit("draft")).unionByName(live.join(drafts.select("id"), "id", "left_anti").withColumn("state", F.lit("live")))


def bounded_count(rows: DataFrame, most: int = 10_000) -> DataFrame:
    return rows.limit(most).agg(F.count(F.lit(1)).alias("n"))


def chain(records: DataFrame) -> DataFrame:
    """Records (chain, step, digest, previous) with whether each names its predecessor's digest; the first names none."""
    w = Window.partitionBy("chain").orderBy("step")
    before = F.lag("digest").over(w)
    return records.withColumn("verified", F.coalesce(before, F.lit("")) == F.coalesce("previous", F.lit("")))


def history(records: DataFrame) -> DataFrame:
    """Records (type, id, content, stated) with whether the stated digest is the content's."""
    return records.withColumn("verified", F.lower(F.sha2("content", 256)) == F.lower("stated")).select("type", "id", "verified")


def fingerprint(files: DataFrame) -> DataFrame:
    """(root_id, fingerprint): a digest of the paths, sizes and times of a root's files, whatever their order.

    Digests of single files are sorted and digested by their first three digits, then these digests: no task holds all files of a root.
    """
    one = F.sha2(F.concat_ws("\u0000", "path", F.col("size").cast("string"), F.col("mtime").cast("string")), 256)
    part = files.select("root_id", one.alias("h")).groupBy("root_id", F.substring("h", 1, 3).alias("b")).agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("d"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"])
    return part.groupBy("root_id").agg(F.sha2(F.concat_ws("", parts), 256).alias("fingerprint"))


def progress(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("state").isin("complete", "error")).alias("completed"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"))
