"""Near-duplicate documents: banded one-permutation MinHash, star-shaped candidates, links confirmed on full sets.

1. Each document's set of distinct word shingles gives a digest, a signature and the keys of 32 bands of 4 bins. A pair of similarity 0.75
   shares no band with probability 0.684^32 = 5e-6; more similar pairs with less.
2. Documents of equal sets are one node, their least id, found and given back by digest and salt. Bands are counted by key with map-side combination;
   keys of one node end here.
3. Stars: in each bucket every node is compared with one centre (the node of the least hash of the round), so a bucket of n gives n - 1
   pairs. Pairs are confirmed on full sets and merged to components. Two rounds, with new centres for buckets that still mix components.
4. What stars can't see: a link between two nodes of a mixed bucket neither of which was its centre. The nodes outside the centre's
   component ask, and are compared with the whole bucket, a block of ``BLOCK`` asking nodes with a block of ``BLOCK`` living ones at a time, and a pair leaves these only in the first
   band it shares. Sets of up to ``SMALL`` shingles travel with their nodes: pairs of such sets are compared exactly there, and only links leave. Other pairs leave if the estimate
   from 1024-bin signatures is 0.08 (six standard deviations) below the threshold or better. All pairs that leave are confirmed on full sets. No cap: every
   pair that shares a bucket is in one component, was compared by a star, or is compared here.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import SLICE_BYTES, cut, release, spread
from .components import components
from .kernel import U, flat, slices
from .minhash import BANDS, ROWS, SHINGLE, band_keys, shingle_sets, signatures
from .suffix_groups import ranges

THRESHOLD, BLOCK, BINS, SLACK, SMALL, SALTS = 75, 1024, 1024, 0.08, 320, 64


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, n: size of the set, digest, keys) of each row."""

    def run(batches):
        for batch in batches:
            data, ends = flat(batch.column(1))
            size, digest, keys = [], [], [pa.array([], pa.list_(pa.int64()))]
            for a, b in slices(ends, SLICE_BYTES):
                value, at = shingle_sets(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle)
                size.append(np.diff(at))
                digest += [hashlib.blake2b(value[x:y].tobytes(), digest_size=16).digest() if y > x else None for x, y in zip(at[:-1], at[1:], strict=True)]
                keys.append(_lists(value, at))
            n = np.concatenate([np.zeros(0, np.int64), *size])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.concat_arrays(keys)], ["id", "n", "digest", "keys"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, digest binary, keys array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles: 64-bit hashes in ascending order, sketch: 1024 bins of 8 bits, keys of the bands) of each row."""

    def run(batches):
        for batch in batches:
            data, ends = flat(batch.column(1))
            for a, b in slices(ends, SLICE_BYTES):
                value, at = shingle_sets(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a], shingle)
                sketch = (signatures(value, at, BINS) & U(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([value[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary()), _lists(value, at)],
                    ["id", "shingles", "sketch", "keys"],
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, shingles binary, sketch binary, keys array<long>")


def _lists(value: np.ndarray, at: np.ndarray) -> pa.Array:
    every = band_keys(signatures(value, at, BANDS * ROWS), ROWS).view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(every) + 1, BANDS, dtype=np.int32)), pa.array(every))


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """100 * intersection >= threshold * union, of two ascending arrays without repeats."""
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= threshold * (len(both) - same)


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    one, two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))

    def run(batches):
        for batch in batches:
            good = [similar(np.frombuffer(x, U), np.frombuffer(y, U), threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(one, "b").join(two, "a").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def _compare(group: pa.Table, least: float, threshold: int, kind: pa.DataType) -> pa.Table:
    """Pairs of some blocks, those that ask against those that live there: sets that travel are compared by their sets alone; others
    if their sketches agree in a share of ``least`` or more."""
    key, one, two, label = (group[c].to_numpy() for c in ("key", "i", "j", "label"))
    asks, lives = (group[c].to_numpy() for c in ("asks", "lives"))
    ids = group["id"].combine_chunks()
    none = bytes(BINS)
    sketched = np.array([x is not None for x in group["sketch"].to_pylist()], bool)
    sketch = np.frombuffer(b"".join(x or none for x in group["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
    keys = group["keys"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    small = [np.frombuffer(x or b"", U) for x in group["small"].to_pylist()]
    size = np.array([len(x) for x in small])
    order = np.lexsort((two, one, key))
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0), [True]]))
    left, right = [], []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        own = order[a:b]
        if not asks[own].any():
            continue
        living = own[lives[own]]
        band = int(np.flatnonzero(keys[own[0]] == key[own[0]])[0])
        value, owner = np.concatenate([np.zeros(0, U), *(small[k] for k in living.tolist())]), np.repeat(np.arange(len(living)), size[living])
        by = np.argsort(value, kind="stable")
        value, owner = value[by], owner[by]
        for q in own[asks[own]].tolist():
            by_sketch = sketched[living] & sketched[q] & ((size[living] == 0) | (size[q] == 0))
            good = np.zeros(len(living), bool)
            if size[q]:
                first = np.searchsorted(value, small[q])
                same = np.bincount(owner[ranges(first, np.searchsorted(value, small[q], "right") - first)], minlength=len(living))
                good = 100 * same >= threshold * (size[living] + size[q] - same)
                good &= size[living] > 0
            good[by_sketch] = (sketch[living[by_sketch]] == sketch[q]).sum(1) >= least * BINS
            x = living[good & (label[living] != label[q])]
            x = x[~(keys[x, :band] == keys[q, :band]).any(1)]
            left.append(np.full(len(x), q))
            right.append(x)
    pick = [ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *p]).astype(np.int64))) for p in (left, right)]
    return pa.table({"a": pick[0].cast(kind), "b": pick[1].cast(kind)})


def _placed(mixed: DataFrame, block: int) -> DataFrame:
    """(key, id, label, i, j, asks, lives): the groups (ask block i, living block j) of each node (key, node, label, asks) of a bucket.

    Nodes that ask are dealt to blocks of their own, and meet every block of living nodes; all nodes live in one block, and meet every block that asks. Of n nodes of which a ask
    that is n * ceil(a / ``block``) + a * ceil(n / ``block``) rows at most, in groups of two blocks.
    """
    blocks = lambda n: F.ceil(n / block).cast("int")
    size = mixed.groupBy("key").agg(blocks(F.count(F.lit(1))).alias("living"), blocks(F.count_if("asks")).alias("asking"))
    home, ask_home, asks, yes, no = F.col("home"), F.col("ask_home"), F.col("asks"), F.lit(True), F.lit(False)
    place = lambda i, j, asks, lives: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), lives.alias("lives"))
    lives = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda i: place(i, home, asks & (i == ask_home), yes))
    elsewhere = F.transform(F.filter(F.sequence(F.lit(0), F.col("living") - 1), lambda j: j != home), lambda j: place(ask_home, j, yes, no))
    out = mixed.join(size, "key").withColumns({"home": F.pmod(F.xxhash64("node", "key"), F.col("living")).cast("int"), "ask_home": F.pmod(F.xxhash64("key", "node"), F.col("asking")).cast("int")})
    out = out.select("key", F.col("node").alias("id"), F.xxhash64("label").alias("label"), F.explode(F.when(asks, F.concat(lives, elsewhere)).otherwise(lives)).alias("p"))
    return out.select("key", "id", "label", "p.*")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, rounds: int = 2) -> DataFrame:
    """One row an input row: ``id_col``, n_shingles, component_id (least id reachable over links), kept (id = component_id).

    Links: 100 * intersection >= ``threshold`` * union of the sets of distinct shingles. Texts of fewer words than a shingle have one
    shingle, all of them; null, empty and wordless texts have none and are linked with nothing. Rows that share an id
    share a component and keep their own n_shingles. A row without an id is linked with nothing, has a null component
    and is kept. Other columns aren't read; an empty table gives an empty result. Ids must be of an ordered type.
    """
    spark = df.sparkSession
    rows = spread(df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")))
    from pyspark.sql.pandas.types import to_arrow_type

    kind, arrow = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    signed = cut(_signed(rows, shingle).withColumn("digest", F.when(F.col("id").isNotNull(), F.col("digest"))).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    real = signed.where("digest is not null")
    # a digest may hold a third of all rows: its least id is found, and given back, by digest and salt
    equal = real.groupBy("digest", "salt").agg(F.min("id").alias("node"))
    equal = cut(equal.withColumn("node", F.min("node").over(Window.partitionBy("digest"))))
    bands = real.join(equal.select("digest", F.col("node").alias("id")), ["digest", "id"], "left_semi").select(F.col("id").alias("node"), F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    buckets = cut(bands.join(shared, "key").distinct())
    nodes = buckets.select(F.col("node").alias("id")).distinct()
    sets = cut(_sets(rows.join(nodes, "id", "left_semi"), shingle).where("length(shingles) > 0"))
    again = real.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi").select("id")  # ids of several texts link them
    again = real.select("id", "digest", "salt").join(again, "id").join(equal, ["digest", "salt"]).select("id", "node").distinct()
    again = cut(again.join(again.groupBy("id").agg(F.min("node").alias("to")), "id").select(F.col("node").alias("a"), F.col("to").alias("b")).where("a != b"))
    found, tested, labels = again, None, None

    def labelled():
        if labels is None:
            return buckets.withColumn("label", F.col("node"))
        return buckets.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))

    def centres(now, k):
        pick = now.groupBy("key").agg(F.min_by(F.struct("node", "label"), F.struct(F.xxhash64("node", F.lit(k)), "node")).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        return pick.where("lo != hi").select("key", F.col("c.node").alias("centre"), F.col("c.label").alias("to"))

    for k in range(rounds):
        now = labelled()
        pairs = now.join(centres(now, k), "key").where("label != to").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = found.unionByName(cut(_confirm(pairs, sets, threshold)))
        labels, last = cut(components(found)), labels
        release(last)
    now = labelled()
    mixed = now.join(centres(now, rounds), "key").select("key", "node", "label", (F.col("label") != F.col("to")).alias("asks"))
    placed = cut(_placed(mixed, BLOCK))
    wide = F.length("shingles") > 8 * SMALL
    alone = F.length("shingles") * 100 < 8 * SMALL * threshold  # too small to be similar to a set that doesn't travel
    known = sets.select("id", F.when(~alone, F.col("sketch")).alias("sketch"), F.when(~wide, F.col("shingles")).alias("small"), "keys")
    ready = placed.join(known, "id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, placed.count() // (2 * BLOCK))
    kept_least = threshold / 100 - SLACK
    pairs = (
        ready.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)))
        .applyInArrow(lambda group: _compare(group, kept_least, threshold, arrow), f"a {kind}, b {kind}")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a != b")
        .distinct()
    )
    pairs = cut(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs)
    found = found.unionByName(cut(_confirm(pairs, sets, threshold)))
    label = equal.join(components(found).withColumnRenamed("id", "node"), "node", "left").select("digest", "salt", F.coalesce("label", "node").alias("label"))
    return (
        signed.select("id", "n", "digest", "salt")
        .join(label, ["digest", "salt"], "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
