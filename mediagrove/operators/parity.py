"""Plans against what is there: effects of actions, parity of file trees, collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("matching", "missing", "different", "unknown")


def analyze(actions: DataFrame, roots: DataFrame, present: DataFrame) -> DataFrame:
    """``actions`` (destination_root, destination_path, action, source_sha256, source_size) with effect, conflict and bytes.

    ``roots``: (root); ``present``: (root, path, sha256, size, type: file, link or other) of the destinations.
    """
    # roots are a configuration, a row each: shuffled by root, all actions of a root would meet in one task
    known = F.broadcast(roots.select(F.col("root").alias("destination_root"), F.lit(True).alias("known")))
    there = present.select(F.col("root").alias("destination_root"), F.col("path").alias("destination_path"), F.col("sha256").alias("now_sha256"), F.col("size").alias("now_size"), F.col("type").alias("now_type"))
    rows = actions.join(known, "destination_root", "left")
    # nothing is there without a path: these actions have one key a root, and stay out of the join
    out = rows.where("destination_path != ''").join(there, ["destination_root", "destination_path"], "left")
    out = out.unionByName(rows.where("destination_path is null or destination_path = ''"), allowMissingColumns=True)
    exists, same = F.col("now_type").isNotNull(), (F.col("now_type") == "file") & (F.col("source_sha256") != "") & (F.col("now_sha256") == F.col("source_sha256"))
    effect = (
        F.when(F.col("destination_path") == "", "no-filesystem-change").when(F.col("known").isNull(), "root-unavailable")
        .when((F.col("action") == "remove") & ~exists, "no-filesystem-change").when(F.col("action") == "remove", "would-remove")
        .when(~exists, "create").when(same, "replace-same-hash").otherwise("conflict")
    )
    file_size = F.when(F.col("now_type") == "file", F.col("now_size")).otherwise(0)
    out = out.withColumn("effect", effect)
    is_ = lambda *names: F.col("effect").isin(*names)
    return out.withColumns({
        "conflict": is_("conflict", "root-unavailable"),
        "conflict_reason": F.when(is_("root-unavailable"), F.concat(F.lit('destination root "'), "destination_root", F.lit('" is not configured')))
        .when(is_("conflict") & (F.col("now_type") == "link"), "destination is a symlink").when(is_("conflict") & (F.col("now_type") != "file"), "destination exists and is not a regular file")
        .when(is_("conflict"), "destination exists with content that differs from the plan").otherwise(""),
        "new_bytes": F.when(is_("create", "conflict"), F.col("source_size")).otherwise(0), "backup_bytes": F.when(is_("conflict"), file_size).otherwise(0),
        "freed_bytes": F.when(is_("would-remove"), file_size).otherwise(0),
    }).drop("known", "now_sha256", "now_size", "now_type")


def analysis_totals(analyzed: DataFrame) -> DataFrame:
    return analyzed.agg(F.count_if("conflict").alias("conflicts"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("new_bytes", "backup_bytes", "freed_bytes")))


def destination_space(analyzed: DataFrame, free: DataFrame) -> DataFrame:
    """(root, needed, available, sufficient) of the known destinations; ``free``: (root, available), null where unknown."""
    need = analyzed.where("destination_path != '' AND effect != 'root-unavailable'").groupBy(F.col("destination_root").alias("root")).agg(F.sum("new_bytes").alias("needed"))
    return need.join(free, "root", "left").select("root", "needed", "available", F.coalesce(F.col("available") >= F.col("needed"), F.lit(False)).alias("sufficient")).orderBy("root")


def compare(files: DataFrame, target: DataFrame | None) -> DataFrame:
    """``files`` (path, sha256, blocked) with previous and status against ``target`` (path, sha256); unknown if there is no target."""
    if target is None:
        return files.withColumns({"previous": F.lit(""), "status": F.lit("unknown")})
    out = files.join(target.select("path", F.col("sha256").alias("previous")), "path", "left").withColumn("previous", F.coalesce("previous", F.lit("")))
    return out.withColumn("status", F.when(F.col("previous") == "", "missing").when(F.col("previous") == F.col("sha256"), "matching").otherwise("different"))


def counts(compared: DataFrame) -> DataFrame:
    """Counts by status of all files and of those that aren't blocked, in one pass."""
    free = ~F.col("blocked")
    every = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    publishable = [F.count_if(free & (F.col("status") == s)).alias(f"publishable_{s}") for s in STATUSES]
    return compared.agg(F.count(F.lit(1)).alias("files"), *every, F.count_if(free).alias("publishable"), *publishable, F.count_if("blocked").alias("blocked"))


def all_published(compared: DataFrame) -> DataFrame:
    return compared.agg(F.coalesce(F.bool_and(F.col("blocked") | (F.col("status") == "matching")), F.lit(True)).alias("all_match"))


def block_variants(actions: DataFrame, roles: tuple[str, ...] = ("grid", "portrait", "hero", "logo", "icon")) -> DataFrame:
    """Actions with every variant of one role's file blocked: equal destinations but for case and extension."""
    key = F.when(F.col("role").isin(*roles), F.lower(F.regexp_replace("destination_path", r"\.[^./]*\z", "")))
    own = actions.withColumn("key", key)
    # rows without a key are counted by nothing, and stay out of the join
    many = own.where("key is not null").groupBy("profile", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("profile", "key", F.lit(True).alias("many"))
    keyed = own.where("key is not null").join(many, ["profile", "key"], "left").withColumn("many", F.coalesce("many", F.lit(False)))
    out = keyed.unionByName(own.where("key is null").withColumn("many", F.lit(False)))
    reason = "multiple filename variants for one Steam artwork role; choose an explicit asset before publishing"
    return out.withColumns({"action": F.when(F.col("many"), "blocked").otherwise(F.col("action")), "reason": F.when(F.col("many"), reason).otherwise("")}).drop("key", "many")


def artwork_actions(obs: DataFrame, issues: DataFrame) -> DataFrame:
    """Copy or blocked actions for the files of an artwork set (profile = set): unsupported files, files with issues and variants are blocked."""
    fits = F.col("identity_hint").startswith("steam:") & F.col("role").isin("grid", "portrait", "hero", "logo", "icon")
    typed = F.col("extension").isin("png", "jpg", "jpeg") | ((F.col("role") == "icon") & (F.col("extension") == "ico"))
    bad = issues.groupBy("root_id", "path").agg(F.max("message").alias("issue"))
    rows = obs.where("artwork_set != ''").join(bad, ["root_id", "path"], "left")
    name = F.element_at(F.split("path", "/"), -1)
    problem = (
        F.when(~fits, "unsupported or unidentified file; the artwork adapter does not copy layout metadata").when(F.col("issue").isNotNull(), F.col("issue"))
        .when(~typed, F.concat(F.lit("steam adapter does not support ."), "extension", F.lit(" for role "), "role", F.lit("; create a derived canonical asset first"))).otherwise("")
    )
    out = rows.select(F.col("artwork_set").alias("profile"), F.when(problem == "", "copy").otherwise("blocked").alias("action"), "sha256", "size", name.alias("destination_path"), "role", problem.alias("problem"))
    out = block_variants(out)
    return out.withColumn("reason", F.when(F.col("reason") != "", F.col("reason")).otherwise(F.col("problem"))).drop("problem")


def name_collisions(files: DataFrame) -> DataFrame:
    """Destinations that differ in case or extension only: (key, n)."""
    return files.groupBy(F.lower(F.regexp_replace("path", r"\.[^./]*\z", "")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def case_collisions(ids: DataFrame) -> DataFrame:
    """(key, ids) of ids that are equal but for case."""
    per = ids.select("id").distinct().groupBy(F.lower("id").alias("key")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return per.where(F.size("ids") > 1).orderBy("key")


STATES = {
    "unsupported": "No local publishing adapter is enabled for this frontend.", "unobserved": "No actual frontend folder has been configured on this host.",
    "offline": "Configured frontend folder is unavailable on this host.", "unknown": "Some target files cannot be safely observed; publishing is disabled.",
}


def plan_files(files: DataFrame, targets: DataFrame, observed: DataFrame) -> DataFrame:
    """A row a file and target of the profile's platform: profile, target, state (of the target), path, sha256, blocked, previous, status.

    ``files``: (profile: "platform/name", path, sha256, blocked); ``targets``: (target, platform, adapter, root: '' if none is configured, available);
    ``observed``: (root, path, sha256, readable). Of targets of other adapters no file is compared; where the target isn't observed, or a file in it can't be read, the status is unknown.
    """
    state = (
        F.when((F.col("adapter") != "steam") | (F.col("platform") != "steam"), "unsupported").when(F.coalesce("root", F.lit("")) == "", "unobserved")
        .when(~F.coalesce("available", F.lit(False)), "offline").otherwise("observed")
    )
    named = targets.withColumn("state", state)
    rows = files.withColumn("platform", F.substring_index("profile", "/", 1)).join(named.where("adapter = 'steam'"), "platform")
    there = observed.select("root", "path", F.col("sha256").alias("now"), "readable")
    out = rows.join(there, ["root", "path"], "left")
    seen = F.col("state") == "observed"
    hidden = ~F.coalesce("readable", F.lit(True))
    out = out.withColumn("previous", F.when(seen & ~hidden, F.coalesce("now", F.lit(""))).otherwise(""))
    status = F.when(~seen | hidden, "unknown").when(F.col("previous") == "", "missing").when(F.col("previous") == F.col("sha256"), "matching").otherwise("different")
    return out.withColumn("status", status).select("profile", "target", "state", "path", "sha256", "blocked", "previous", "status")


def plans(files: DataFrame, targets: DataFrame, observed: DataFrame) -> DataFrame:
    """A row a profile and target of its platform: state, message, counts of files by status, of those that aren't blocked, and of blocked ones. An observed target of which a file is unknown is itself unknown."""
    free, status = ~F.col("blocked"), F.col("status")
    compared = plan_files(files, targets, observed).groupBy("profile", "target", "state").agg(
        F.count(F.lit(1)).alias("files"), *(F.count_if(status == s).alias(s) for s in STATUSES), F.count_if(free).alias("publishable"), *(F.count_if(free & (status == s)).alias(f"publishable_{s}") for s in STATUSES), F.count_if("blocked").alias("blocked"),
    )
    compared = compared.withColumn("state", F.when((F.col("state") == "observed") & (F.col("unknown") > 0), "unknown").otherwise(F.col("state")))
    profiles = files.select("profile", F.substring_index("profile", "/", 1).alias("platform")).distinct()
    others = profiles.join(targets.where("adapter != 'steam'"), "platform").select("profile", "target", F.lit("unsupported").alias("state"), *(F.lit(0).cast("long").alias(c) for c in compared.columns[3:]))
    message = F.lit("")
    for name, text in STATES.items():
        message = F.when(F.col("state") == name, text).otherwise(message)
    return compared.unionByName(others).withColumn("message", message)
