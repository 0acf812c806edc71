"""Listings of observations: combinable filters, themes, issues, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import policy


def theme_index(selected: DataFrame) -> DataFrame:
    """(sha256, themes): the themes whose profiles hold a content."""
    return selected.where("theme != ''").groupBy("sha256").agg(F.array_sort(F.collect_set("theme")).alias("themes"))


def listing(obs: DataFrame, selected: DataFrame, issues: DataFrame, rules: DataFrame | None = None, default: str = "", *, source: str = "", system: str = "", identity: str = "",
            role: str = "", dimensions: str = "", outcome: str = "", theme: str = "", validation: str = "") -> DataFrame:
    """Observations that pass all given filters, with policy, themes and issue codes.

    Filters on plain columns come before any join. ``identity`` ending in a colon is a prefix. ``validation``: issues or clean. An
    ``outcome`` without rules matches nothing.
    """
    out = obs
    for column, value in (("root_id", source), ("system", system), ("role", role), ("dimensions", dimensions)):
        if value:
            out = out.where(F.col(column) == value)
    if identity:
        out = out.where(F.col("identity_hint").startswith(identity) if identity.endswith(":") else F.col("identity_hint") == identity)
    if rules is not None:
        out = policy.resolve(out, rules, default)
        if outcome:
            out = out.where(F.col("mode") == outcome)
    else:
        out = out.withColumns({"mode": F.lit(""), "matched_rule": F.lit(-1)})
        if outcome:
            out = out.where(F.lit(False))
    out = out.join(theme_index(selected), "sha256", "left").withColumn("themes", F.coalesce("themes", F.array().cast("array<string>")))
    if theme:
        out = out.where(F.array_contains("themes", theme))
    codes = issues.groupBy("root_id", "path").agg(F.array_sort(F.collect_list("code")).alias("issue_codes"))
    out = out.join(codes, ["root_id", "path"], "left").withColumn("issue_codes", F.coalesce("issue_codes", F.array().cast("array<string>")))
    if validation:
        out = out.where((F.size("issue_codes") > 0) if validation == "issues" else (F.size("issue_codes") == 0))
    return out.select("root_id", "path", "size", "sha256", "role", "system", "identity_hint", "dimensions", "mode", "matched_rule", "themes", "issue_codes")


def clamped(number: int, size: int) -> tuple[int, int]:
    """Page number and size as they count: below 1 they become 1 and 50."""
    return max(1, number), size if size >= 1 else 50


def page(rows: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """A page of a listing by root and path (rows of equal paths by content); pages and sizes below 1 become 1 and 50."""
    number, size = clamped(number, size)
    return rows.orderBy("root_id", "path", "sha256").offset((number - 1) * size).limit(size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))
