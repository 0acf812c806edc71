"""Retention rules: the most specific matching rule wins; import plans that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

SELECTORS = (("source", "root_id", 1), ("system", "system", 2), ("role", "role", 4), ("sha256", "sha256", 8))
MODES = ("managed", "tracked-external", "promote-on-approval", "quarantined")
MOST_RULES = 200


def resolve(obs: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """``obs`` with mode and matched_rule (-1: the default). '' in a selector matches anything; of equally specific rules the first wins.

    Up to ``MOST_RULES`` rules (counted first) compile to one expression over each row, most specific rule first. More are
    joined selector set by selector set: rules of one set of selectors are an equi-join on these, so nothing is nested.
    """
    head = rules.orderBy("rule").limit(MOST_RULES + 1).collect()
    if len(head) <= MOST_RULES:
        score = lambda r: sum(w for own, _, w in SELECTORS if r[own])
        mode = index = None
        for r in sorted(head, key=lambda r: (-score(r), r["rule"])):
            cond = F.lit(True)
            for own, theirs, _ in SELECTORS:
                if r[own]:
                    cond = cond & (F.col(theirs) == r[own])
            mode = F.when(cond, r["mode"]) if mode is None else mode.when(cond, r["mode"])
            index = F.when(cond, r["rule"]) if index is None else index.when(cond, r["rule"])
        mode = F.lit(default) if mode is None else mode.otherwise(default)
        index = F.lit(-1) if index is None else index.otherwise(-1)
        return obs.withColumns({"mode": mode, "matched_rule": index.cast("int")})
    # sets of selectors that rules use, most specific first: at most sixteen
    asked = sum((F.when(F.col(own) != "", w).otherwise(0) for own, _, w in SELECTORS), F.lit(0))
    best = []
    out = obs
    for mask in sorted((r["m"] for r in rules.select(asked.alias("m")).distinct().collect()), reverse=True):
        used = [(own, theirs) for own, theirs, w in SELECTORS if mask & w]
        shape = F.lit(True)
        for own, _, w in SELECTORS:
            shape = shape & ((F.col(own) != "") if mask & w else (F.col(own) == ""))
        keys = [F.col(own).alias(f"__{mask}_{own}") for own, _ in used]
        part = rules.where(shape).groupBy(*keys).agg(F.min(F.struct("rule", "mode")).alias(f"__{mask}"))
        cond = [out[theirs] == part[f"__{mask}_{own}"] for own, theirs in used]
        if cond:
            out = out.join(part, cond, "left")
            best.append(F.col(f"__{mask}"))
        else:  # a rule without selectors: the first of them matches all that is left
            first = rules.where(shape).orderBy("rule").limit(1).collect()
            best += [F.struct(F.lit(r["rule"]).cast(rules.schema["rule"].dataType).alias("rule"), F.lit(r["mode"]).alias("mode")) for r in first]
    won = F.coalesce(*best)
    drop = [c for c in out.columns if c.startswith("__")]
    return out.withColumns({"mode": F.coalesce(won["mode"], F.lit(default)), "matched_rule": F.coalesce(won["rule"], F.lit(-1)).cast("int")}).drop(*drop)


def impact(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def import_plan(resolved: DataFrame) -> DataFrame:
    """One planned action a file (``orders``: "import plan"). ``unsafe`` says why a row would make the whole plan fail."""
    mode, ext = F.col("mode"), F.col("extension")
    to_catalog = mode.isin("managed", "quarantined")
    unsafe = (
        F.when(~S.safe_id(F.col("root_id")), "root id is not path-safe").when(~S.safe_relative_path(F.col("path")), "unsafe relative path")
        .when(~S.sha256_text(F.col("sha256")), "invalid SHA-256").when((ext != "") & ~F.lower(ext).rlike(r"^[a-z0-9]{1,16}\z"), "unsafe extension").otherwise("")
    )
    return resolved.select(
        F.when(mode == "managed", "copy").when(mode == "quarantined", "quarantine").otherwise("skip").alias("action"),
        F.col("root_id").alias("source_root"), F.col("path").alias("source_path"), F.col("sha256").alias("source_sha256"), F.col("size").alias("source_size"),
        F.when(to_catalog, "catalog").otherwise("").alias("destination_root"),
        F.when(mode == "managed", S.asset_path(F.col("sha256"), ext)).when(mode == "quarantined", F.concat(F.lit("state/quarantine/policy/"), "sha256")).otherwise("").alias("destination_path"),
        F.when(to_catalog, "absent-or-same-hash").otherwise("").alias("expected_destination"),
        F.when(mode == "managed", "policy resolves asset to managed canonical storage").when(mode == "tracked-external", "asset remains tracked at its external source")
        .when(mode == "promote-on-approval", "asset promotion requires separate explicit approval").when(mode == "quarantined", "policy requires quarantine").alias("reason"),
        "identity_hint", "role", "system", unsafe.alias("unsafe"),
    )
