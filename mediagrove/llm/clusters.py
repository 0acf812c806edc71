"""Centroid clustering by exponion search: exact k-means over integer vectors.

Each vector carries its cluster and two bounds: its distance to its centroid is at most ``upper``, that to any other centroid at least ``lower``. After the
centroids have moved, bounds move with them, and a vector whose upper bound is below its lower one, or below half the way to the next centroid, keeps its
cluster unseen. The others take their exact distance u, and scan only centroids in the ball of radius 2u + s around their own centroid (s: its way to the nearest other
one): the nearest and the second nearest lie in it. Each centroid has a list of the others sorted by distance, so a ball is a prefix of a list. Comparisons are
inclusive: a tie is never pruned, and goes to the smaller number.

Vectors are written once, many to a row and compressed, with their bounds; a round reads and writes these blocks and gives sums by cluster, which Spark adds up.
The driver sees centroids, counts and sums: clusters x dimensions numbers. A lost executor's blocks are computed again from the round before.

Exactness: components are integers of at most ``LIMIT`` (2^26) in size. Squared distances are computed in doubles where every number stays below 2^53, else in 64-bit integers. Bounds are roots, widened
by more than their rounding.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, release, spread
from .blocks import pack, unpack

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, LIMIT = 64, 16, 3, 64, 1 << 26
_WIDE = 1 + 2.0**-40


def kept(df: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: float) -> DataFrame:
    """(id, v: array<double> of whole numbers) of the rows whose vector has ``dimensions`` components, all finite."""
    v = F.transform(df[vector_col], lambda x: x.cast("double"))
    good = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(df[id_col].alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("v"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``c`` (integers), exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


class Ball:
    """The search structure of a set of centroids (int64, a row each)."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        apart = np.sqrt(squares(centroids, centroids).astype(np.float64))
        self.list = np.argsort(apart, axis=1, kind="stable")  # its own number first, or one that is the same point
        self.reach = np.take_along_axis(apart, self.list, 1) / _WIDE
        self.nearest = np.where(np.eye(k, dtype=bool), np.inf, apart).min(1) if k > 1 else np.full(k, np.inf)

    def search(self, x: np.ndarray, own: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Nearest centroid, its squared distance and the squared distance of the second nearest of each row, whose squared distance to centroid ``own`` is known; and
        the number of distances computed. Without a second centroid that is the greatest integer."""
        best, first, second, done = own.copy(), square.copy(), np.full(len(x), np.iinfo(np.int64).max), 0
        radius = (2 * np.sqrt(square.astype(np.float64)) + self.nearest[own]) * _WIDE
        for a in np.unique(own):
            rows = np.flatnonzero(own == a)
            size = np.searchsorted(self.reach[a], radius[rows], "right")  # inclusive: ties stay
            for step in 2 ** np.arange(len(self.c).bit_length() + 1):  # rows of like prefixes together: at most twice what each needs
                part = np.flatnonzero((size > step // 2) & (size <= step)) if step > 1 else np.flatnonzero(size <= 1)
                if len(part):
                    near = np.sort(self.list[a][: min(step, len(self.c))])  # by number, so that the first of equals is the smaller one
                    r, d = rows[part], squares(x[rows[part]], self.c[near])
                    done += d.size
                    pick = d.argmin(1)
                    best[r], first[r] = near[pick], d[np.arange(len(r)), pick]
                    if len(near) > 1:
                        d[np.arange(len(r)), pick] = np.iinfo(np.int64).max
                        second[r] = d.min(1)
        return best, first, second, done


def assign(ball: Ball, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds of vectors whose clusters and bounds hold for the centroids of ``ball``; and the number of distances computed."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    floor = np.maximum(lower, ball.nearest[own] / 2 / _WIDE)
    look = np.flatnonzero(upper >= floor)
    done = len(look)
    if len(look):
        exact = ((x[look] - ball.c[own[look]]) ** 2).sum(1)
        upper[look] = np.sqrt(exact.astype(np.float64)) * _WIDE
        still = upper[look] >= floor[look]
        look, exact = look[still], exact[still]
    if len(look):
        own[look], first, second, more = ball.search(x[look], own[look], exact)
        upper[look] = np.sqrt(first.astype(np.float64)) * _WIDE
        lower[look] = np.sqrt(second.astype(np.float64)) / _WIDE
        done += more
    return own, upper, lower, done


def moved(old: np.ndarray, new: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids went from ``old`` to ``new``."""
    way = np.sqrt(((old - new) ** 2).sum(1).astype(np.float64)) * _WIDE
    far = np.argsort(-way, kind="stable")
    most = np.full(len(way), way[far[0]] if len(way) else 0.0)
    if len(way):
        most[far[0]] = way[far[1]] if len(way) > 1 else 0.0  # the greatest way of the others
    return (upper + way[own]) * _WIDE, np.maximum((lower - most[own]) / _WIDE - 1e-9, 0.0)


class Totals:
    """What a task adds up: vectors, components and squared distances by cluster."""

    KIND = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("total", pa.list_(pa.int64()))]))

    def __init__(self, k: int, dimensions: int):
        self.n, self.inertia, self.total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)

    def add(self, x: np.ndarray, own: np.ndarray, c: np.ndarray) -> np.ndarray:
        square = ((x - c[own]) ** 2).sum(1)
        self.n += np.bincount(own, minlength=len(self.n))
        np.add.at(self.inertia, own, square)
        np.add.at(self.total, own, x)
        return square

    def row(self, done: int) -> pa.RecordBatch:
        have = np.flatnonzero(self.n).tolist()
        sums = [{"cluster": k, "n": int(self.n[k]), "inertia": int(self.inertia[k]), "total": self.total[k].tolist()} for k in have]
        return pa.RecordBatch.from_arrays([pa.array([sums], self.KIND), pa.array([done])], ["sums", "done"])


_STATE = "v binary, own binary, upper binary, lower binary, sums array<struct<cluster: int, n: long, inertia: long, total: array<long>>>, done long"


def _block(ids: pa.Array, v: bytes, own, upper, lower) -> pa.RecordBatch:
    one = lambda x: pa.array([x], pa.binary())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), one(v), one(pack(own.astype(np.int32))), one(pack(upper)), one(pack(lower))], ["ids", "v", "own", "upper", "lower"])


def _fill(part: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """``part`` with null columns for those it lacks."""
    return pa.RecordBatch.from_arrays([part.column(f.name).cast(f.type) if f.name in part.schema.names else pa.nulls(part.num_rows, f.type) for f in schema], schema=schema)


def _first(rows: DataFrame, c: np.ndarray, limit: int) -> DataFrame:
    """Blocks of vectors, each vector compared with every centroid; and a row a task with its sums."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        totals, done, schema = Totals(*c.shape), 0, None
        for batch in batches:
            schema = _schema(batch.schema.field("id").type)
            x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, c.shape[1])
            if np.abs(x).max(initial=0) > limit:
                raise ValueError(f"components beyond {limit} in size: their squared distances aren't exact in 64 bits")
            x = x.astype(np.int64)
            d = squares(x, c)
            own = d.argmin(1)
            upper = np.sqrt(d[np.arange(len(x)), own].astype(np.float64)) * _WIDE
            d[np.arange(len(x)), own] = np.iinfo(np.int64).max
            lower = np.sqrt(d.min(1).astype(np.float64)) / _WIDE
            totals.add(x, own, c)
            done += d.size
            yield _fill(_block(batch.column("id"), pack(x.astype(np.int32).ravel()), own, upper, lower), schema)
        if schema is not None:
            yield _fill(totals.row(done), schema)

    return rows.mapInArrow(run, f"ids array<{kind}>, {_STATE}")


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind)), *((x, pa.binary()) for x in ("v", "own", "upper", "lower")), ("sums", Totals.KIND), ("done", pa.int64())])


def _opened(row: dict, dimensions: int):
    return unpack(row["v"], np.int32).astype(np.int64).reshape(-1, dimensions), unpack(row["own"], np.int32).astype(np.int64), unpack(row["upper"], np.float64), unpack(row["lower"], np.float64)


def _again(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The blocks with clusters and bounds for the centroids ``new``; they hold for ``old``."""
    kind = state.schema["ids"].dataType.simpleString()

    def run(batches):
        ball, totals, done, schema = Ball(new), Totals(*new.shape), 0, None
        for batch in batches:
            schema = _schema(batch.schema.field("ids").type.value_type)
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("v", "own", "upper", "lower")}
                x, own, upper, lower = _opened(row, new.shape[1])
                own, upper, lower, n = assign(ball, x, own, *moved(old, new, own, upper, lower))
                totals.add(x, own, new)
                done += n
                yield _fill(_block(batch.column("ids")[k].values, row["v"], own, upper, lower), schema)
        if schema is not None:
            yield _fill(totals.row(done), schema)

    return state.where("v is not null").mapInArrow(run, f"ids {kind}, {_STATE}")


def _means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after ``state``: floors of means; of clusters without vectors as they were."""
    each = state.where("v is null").select(F.inline("sums")).select("cluster", "n", F.posexplode("total").alias("at", "x"))
    rows = each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"), F.sum("n").alias("n")).collect()  # clusters x dimensions
    out = c.copy()
    for r in rows:
        out[r["cluster"], r["at"]] = int(r["x"]) // r["n"]
    return out


def centroids_of(rows: DataFrame, clusters: int) -> np.ndarray:
    """The first ``clusters`` vectors in the order of the SHA-256 of "1:id"; rows without an id come last, equal ids by their vectors."""
    first = rows.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256)).orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in first], np.float64)


def cluster(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: float = SCALE, limit: int = LIMIT) -> DataFrame:
    """One row a kept vector: ``id_col``, cluster, distance (squared), cluster_inertia, inertia (sums of it over the cluster and over all), centroid_sha256.

    Kept are vectors of exactly ``dimensions`` components, none null or not finite, as floor(``scale`` * x). Each of ``rounds`` rounds assigns all vectors and moves
    the centroids to the floors of their means; then all are assigned once more. Ids may be null or repeat: every row is a vector. Of fewer than ``clusters`` kept rows
    each is a centroid; without any the result is empty. Components beyond ``limit`` after scaling are an error. Other columns aren't read, whatever their
    names. Runs a job a round, when called.
    """
    rows = kept(spread(df.select(id_col, vector_col)), id_col, vector_col, dimensions, scale)
    c = centroids_of(rows, clusters)
    kind = rows.schema["id"].dataType.simpleString()
    if np.abs(c).max(initial=0) > limit:
        raise ValueError(f"components beyond {limit} in size: their squared distances aren't exact in 64 bits")
    c = c.astype(np.int64).reshape(-1, dimensions)
    if not len(c):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(x) for x in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    state = cut(_first(rows, c, limit))
    for _ in range(rounds):
        new = _means(state, c)
        state, last, c = cut(_again(state, c, new)), state, new
        release(last)
    by = {r["cluster"]: r["inertia"] for r in state.where("v is null").select(F.inline("sums")).groupBy("cluster").agg(F.sum("inertia").alias("inertia")).collect()}
    total = sum(by.values())
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    inertia = np.array([by.get(k, 0) for k in range(len(c))], np.int64)

    def out(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, own, _, _ = _opened({n: batch.column(n)[k].as_py() for n in ("v", "own", "upper", "lower")}, dimensions)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[k].values, pa.array(own.astype(np.int32)), pa.array(((x - c[own]) ** 2).sum(1)), pa.array(inertia[own]), pa.array(np.full(len(x), total)), pa.array(names).take(pa.array(own))],
                    ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    kind = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return state.where("v is not null").select("ids", "v", "own", "upper", "lower").mapInArrow(out, kind).withColumnRenamed("id", id_col)


def sql(rounds: int = ROUNDS, clusters: int = CLUSTERS) -> str:
    """The same for DuckDB, every vector compared with every centroid."""
    step = """
a{k} AS MATERIALIZED (SELECT r, min({{'d': d, 'k': k}}) AS b FROM (SELECT r, k, list_sum(list_transform(list_zip(e.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{k} c) GROUP BY r),"""
    move = """
s{k} AS (SELECT k, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT b.k AS k, generate_subscripts(v, 1) AS i, unnest(v)::BIGINT AS x FROM a{k} JOIN e USING (r)) GROUP BY k, i),
m{k} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM s{k} GROUP BY k),
c{n} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.k = c.k),"""
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                        WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM e ORDER BY h NULLS LAST, v LIMIT {clusters})),""" + "".join(
        step.format(k=k) + (move.format(k=k, n=k + 1) if k < rounds else "") for k in range(rounds + 1)
    ) + f"""
o AS (SELECT e.vec_id, b.k AS cluster, b.d AS distance FROM a{rounds} JOIN e USING (r))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM o JOIN c{rounds} c ON c.k = o.cluster
"""


SQL = sql()
