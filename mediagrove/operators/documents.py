"""JSON documents checked against tables of fields and rules, as issue rows.

Each document is parsed once, to a VARIANT, and walked level by level into its nodes: one chain of generators, no document is read twice. Nodes meet the field table (unknown fields, other types) and,
as objects, the rule table, both small and fixed. A document that isn't JSON, or no object, is an issue itself, and has no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .policy import MODES

DEPTH = 4
# The fields of each kind of document, by path, with their types ([]: an element), and what must hold for them.
_RULES_OF_POLICY = {"rules": "ARRAY", "rules[]": "OBJECT", "rules[].source": "STRING", "rules[].system": "STRING", "rules[].role": "STRING", "rules[].assetSha256": "STRING", "rules[].mode": "STRING"}
FIELDS = {
    "config": {"version": "BIGINT", "roots": "ARRAY", "roots[]": "OBJECT", "roots[].id": "STRING", "roots[].kind": "STRING", "roots[].path": "STRING", "roots[].system": "STRING", "policy": "OBJECT", "policy.version": "BIGINT", "policy.default": "STRING", **{f"policy.{k}": v for k, v in _RULES_OF_POLICY.items()}},
    "policy": {"version": "BIGINT", "default": "STRING", **_RULES_OF_POLICY},
    "targets": {"version": "BIGINT", "targets": "ARRAY", "targets[]": "OBJECT", **{f"targets[].{k}": "STRING" for k in ("id", "name", "device", "platform", "adapter", "root")}},
    "profile": {"version": "BIGINT", "id": "STRING", "name": "STRING", "description": "STRING", "artwork": "STRING", "mods": "ARRAY", "mods[]": "OBJECT", "mods[].game": "STRING", "mods[].set": "STRING"},
}
#: (kind, path of the object, its fields, operation, argument, what is wrong)
RULES = [
    ("config", "", "version", "equals", "1", "config version must be 1"), ("config", "", "roots", "filled", "", "config must define at least one root"), ("config", "roots[]", "id", "safe-id", "", "root id is not path-safe"),
    ("config", "roots[]", "kind", "given", "", "root kind is required"), ("config", "roots[]", "path", "given", "", "root path is required"), ("config", "roots[]", "id", "unique", "", "duplicate root id"),
    ("config", "policy", "version", "equals", "1", "policy version must be 1"), ("config", "", "policy", "filled", "", "policy version must be 1"),
    ("policy", "", "version", "equals", "1", "policy version must be 1"), ("policy", "", "default", "one-of", ",".join(MODES), "invalid default policy mode"), ("policy", "rules[]", "mode", "one-of", ",".join(MODES), "rule has invalid mode"),
    ("policy", "rules[]", "source,system,role,assetSha256", "unique", "", "duplicate policy selector"),
    ("targets", "", "version", "equals", "1", "targets version must be 1"), ("targets", "targets[]", "id", "safe-name", "", "targets need unique path-safe IDs and names"), ("targets", "targets[]", "name", "given", "", "targets need unique path-safe IDs and names"),
    ("targets", "targets[]", "id", "unique", "", "targets need unique path-safe IDs and names"), ("targets", "targets[]", "adapter,platform", "both-or-neither", "steam", "steam adapter requires the Steam platform"), ("targets", "targets[]", "root", "absolute", "", "target root must be a host-local absolute directory"),
    ("profile", "", "version", "equals", "1", "decky profile version must be 1"), ("profile", "", "id", "safe-name", "", "decky profile id is not path-safe"), ("profile", "", "id", "stem", "", "decky profile filename stem does not match id"),
    ("profile", "", "name", "not-blank", "", "decky profile name is required"), ("profile", "", "artwork", "safe-name-if-given", "", "decky artwork id is not path-safe"),
    ("profile", "mods[]", "game", "safe-name", "", "decky mod game/set ids must be path-safe"), ("profile", "mods[]", "set", "safe-name", "", "decky mod game/set ids must be path-safe"), ("profile", "mods[]", "game", "unique", "", "decky profile contains more than one mod set for a game"),
]
#: Kinds whose unknown fields are an error.
STRICT = ("targets", "profile")


def parsed(documents: DataFrame) -> DataFrame:
    """(id, kind, stem, doc) of documents (id, kind, stem, text); doc is null where the text isn't one JSON value, or is null. Parsers stop after a value: the text is parsed as the first of two."""
    pair = documents.select("id", "kind", "stem", F.try_parse_json(F.concat(F.lit("["), "text", F.lit(", 0]"))).alias("pair"))
    return pair.select("id", "kind", "stem", F.expr("CASE WHEN size(try_cast(pair AS ARRAY<VARIANT>)) = 2 THEN try_variant_get(pair, '$[0]', 'variant') END").alias("doc"))


def nodes(docs: DataFrame) -> DataFrame:
    """(id, kind, stem, path, at: the number of the element it lies in, type, v) of every value in the documents, the documents themselves at path ''. """
    start = F.array(F.struct(F.lit("").alias("path"), F.lit(0).alias("at"), F.lit(0).alias("depth"), F.col("doc").alias("v")))
    out = docs.where("doc is not null").select("id", "kind", "stem", F.explode(start).alias("n"))
    for k in range(1, DEPTH + 1):
        inner = f"""transform(map_entries(coalesce(try_cast(n.v AS MAP<STRING, VARIANT>), map())), e -> struct(concat_ws('.', nullif(n.path, ''), e.key) AS path, n.at AS at, {k} AS depth, e.value AS v))"""
        items = f"""transform(coalesce(try_cast(n.v AS ARRAY<VARIANT>), array()), (x, i) -> struct(concat(n.path, '[]') AS path, i AS at, {k} AS depth, x AS v))"""
        out = out.select("id", "kind", "stem", F.explode(F.expr(f"CASE WHEN n.depth = {k - 1} THEN concat(array(n), {inner}, {items}) ELSE array(n) END")).alias("n"))
    kind = F.regexp_extract(F.schema_of_variant("n.v"), "^[A-Z]+", 0)
    return out.select("id", "kind", "stem", "n.path", "n.at", kind.alias("type"), "n.v")


def _wrong_field(found: DataFrame) -> DataFrame:
    spark = found.sparkSession
    table = spark.createDataFrame([(k, p, t) for k, fields in FIELDS.items() for p, t in fields.items()], "kind string, path string, want string")
    rows = found.where("path != ''").select("id", "kind", "path", "at", "type").join(F.broadcast(table), ["kind", "path"], "left")
    problem = F.when(F.col("want").isNull() & F.col("kind").isin(*STRICT), "unknown field").when(F.col("want").isNotNull() & (F.col("type") != F.col("want")) & (F.col("type") != "VOID"), "field has another type")
    return rows.select("id", "kind", "path", F.col("at").cast("long").alias("at"), problem.alias("problem")).where("problem is not null")


def _fails(op: Column, arg: Column, one: Column, two: Column, kind: Column, stem: Column) -> Column:
    """Whether a value (``one``; null if it is missing) breaks a rule."""
    text = F.coalesce(one, F.lit(""))
    safe = S.safe_id(text)
    return (
        F.when(op == "equals", text != arg).when(op == "filled", F.coalesce(kind, F.lit("")).isin("", "VOID") | text.isin("[]", "{}")).when(op == "given", text == "").when(op == "not-blank", F.trim(text) == "")
        .when(op == "safe-id", ~S.plain_id(text)).when(op == "safe-name", ~safe).when(op == "safe-name-if-given", one.isNotNull() & ~safe)
        .when(op == "one-of", ~F.array_contains(F.split(arg, ","), text)).when(op == "stem", text != stem).when(op == "both-or-neither", (text == arg) & (F.coalesce(two, F.lit("")) != arg))
        .when(op == "absolute", (text != "") & ~text.startswith("/")).otherwise(False)
    )


def _broken_rules(found: DataFrame) -> DataFrame:
    spark = found.sparkSession
    table = F.broadcast(spark.createDataFrame([(*r[:2], r[2].split(","), *r[3:]) for r in RULES], "kind string, path string, fields array<string>, op string, arg string, problem string"))
    objects = found.where("type = 'OBJECT'").withColumn("m", F.expr("try_cast(v AS MAP<STRING, VARIANT>)")).select("id", "kind", "stem", "path", F.col("at").cast("long").alias("at"), "m")
    met = objects.join(table, ["kind", "path"])
    value = lambda k: F.expr(f"try_cast(try_element_at(m, try_element_at(fields, {k})) AS STRING)")
    type_ = F.regexp_extract(F.schema_of_variant(F.expr("try_element_at(m, fields[0])")), "^[A-Z]+", 0)
    raw = F.coalesce(value(1), F.to_json(F.expr("try_element_at(m, fields[0])")))
    met = met.select("id", "kind", "stem", "path", "at", "fields", "op", "arg", "problem", raw.alias("one"), value(2).alias("two"), type_.alias("type"), F.expr("concat_ws('\\u0000', transform(fields, f -> coalesce(try_cast(try_element_at(m, f) AS STRING), '')))").alias("all"))
    where = F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("fields")[0])
    single = met.where(_fails(F.col("op"), F.col("arg"), F.col("one"), F.col("two"), F.col("type"), F.col("stem"))).select("id", "kind", where.alias("path"), "at", "problem")
    again = met.where("op = 'unique'").groupBy("id", "kind", "path", "fields", "problem", "all").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at")).where("n > 1").select("id", "kind", where.alias("path"), "at", "problem")
    return single.unionByName(again)


def invalid(documents: DataFrame) -> DataFrame:
    """(id, kind, path, at, problem) of documents (id, kind, stem, text), distinct. ``at``: the element of the list that the path lies in, of repeated keys the last."""
    docs = parsed(documents)
    found = nodes(docs)
    top = F.regexp_extract(F.coalesce(F.schema_of_variant("doc"), F.lit("")), "^[A-Z]*", 0)
    broken = docs.where(F.col("doc").isNull() | (top != "OBJECT")).select("id", "kind", F.lit("").alias("path"), F.lit(0).cast("long").alias("at"), F.lit("document can't be decoded").alias("problem"))
    return broken.unionByName(_wrong_field(found)).unionByName(_broken_rules(found)).distinct()


def targets_of(documents: DataFrame) -> DataFrame:
    """(id, at, target, device, platform, adapter, root) of documents of targets."""
    get = lambda f: F.expr(f"try_variant_get(v, '$.{f}', 'string')")
    rows = nodes(parsed(documents.where("kind = 'targets'"))).where("path = 'targets[]' and type = 'OBJECT'")
    return rows.select("id", F.col("at").cast("long").alias("at"), get("id").alias("target"), *(F.coalesce(get(f), F.lit("")).alias(f) for f in ("device", "platform", "adapter", "root")))


def undeclared_targets(documents: DataFrame, devices: DataFrame) -> DataFrame:
    """(id, at, target, problem) of targets whose device isn't declared for their platform; ``devices``: (id, platforms)."""
    declared = devices.select(F.col("id").alias("device"), F.explode("platforms").alias("platform")).distinct()
    return targets_of(documents).join(declared, ["device", "platform"], "left_anti").select("id", "at", "target", F.lit("target does not match a declared device/platform").alias("problem"))


def invalid_catalog(documents: DataFrame, trees: DataFrame) -> DataFrame:
    """(id, payload, problem) of profiles whose artwork or mods aren't there, or hold nothing; ``trees``: (payload: artwork/set/grid or mods/game/set, files, marker: the empty marker is among them, links).

    An artwork set may hold the marker alone; mods need a file. A tree of links is refused.
    """
    found = nodes(parsed(documents.where("kind = 'profile'")))
    art = found.where("path = 'artwork' and type = 'STRING'").select("id", F.concat(F.lit("artwork/"), F.expr("try_cast(v AS STRING)"), F.lit("/grid")).alias("payload"))
    get = lambda f: F.expr(f"try_variant_get(v, '$.{f}', 'string')")
    mods = found.where("path = 'mods[]' and type = 'OBJECT'").select("id", F.concat_ws("/", F.lit("mods"), get("game"), get("set")).alias("payload"))
    rows = art.unionByName(mods).join(trees, "payload", "left")
    problem = (
        F.when(F.col("files").isNull(), "payload is missing").when(F.coalesce("links", F.lit(0)) > 0, "symlink is not allowed").when(F.col("files") == 0, "payload tree is empty")
        .when(F.col("marker") & (~F.col("payload").startswith("artwork/") | (F.col("files") > 1)), "empty marker stands beside other files or for mods")
    )
    return rows.select("id", "payload", problem.alias("problem")).where("problem is not null")
