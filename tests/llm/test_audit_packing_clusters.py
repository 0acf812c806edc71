"""Operators 11 to 13 against plain Python on awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from mediagrove.llm import clusters, filter_audit, packing  # noqa: E402

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
LONG = " ".join(f"word{i % 977} Gap" for i in range(120_000))  # over a megabyte
ROWS = [
    (1, "few words", "a"), (2, "few words", "a"), (2, "few words", "b"), (3, None, "a"), (4, "", None), (5, " \t\n", ""), (6, "w " * 60, "a"), (7, " ".join(f"w{i}" for i in range(60)), "a"),
    (8, " ".join(f"w{i}" for i in range(60)), "b"), (9, "ABC " + " ".join(f"v{i}" for i in range(60)), "c"), (10, " ".join(f"AB{i}" for i in range(60)), "c"), (11, "$ " + " ".join(f"z{i}" for i in range(60)), "c"),
    (None, "few words", "a"), (None, None, None), (12, "Ünï ÄÖ\u0085x 漢字 \U0001f600", "c"), (13, LONG, "c"), (14, "x" * 3000, "b"), (15, "<|endoftext|> a <|endoftext|>", "b"), (7, " ".join(f"w{i}" for i in range(60)), "a"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (6, None, 1), (7, 1, 1), (10, 0, 1), (11, 5, -1), (99, 1, 1), (None, 1, 1)]
SCHEMA = "doc_id long, text string, source string"
CLASHES = ("id", "part", "key", "bits", "digest", "step", "g", "bin", "fill", "length", "n", "least", "hot")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(c) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumns({"id": F.lit(1), "part": F.lit("x")})


# ---- 11 --------------------------------------------------------------------------------------------------------------
def replayed(rows, labels):
    def fails(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        return out + "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))

    marks = {k: tuple(int(any(x[c] == 1 for x in labels if x[0] == k)) for c in (1, 2)) for k in {x[0] for x in labels} - {None}}
    judged = [(p or "", fails(i, t or ""), *marks.get(i, (0, 0))) for i, t, p in rows]
    out = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {j[0] for j in judged}:
            for step in range(1, 6):
                out[part, order, step] = [0] * 6
        for part, bad, good, toxic in judged:
            first = next((k for k, x in enumerate(order, 1) if x in bad), 6)
            for step, x in enumerate(order, 1):
                c = out[part, order, step]
                for k, yes in enumerate((first > step, first == step, x in bad and first < step, bad == x, first == step and good, first == step and toxic)):
                    c[k] += bool(yes)
    value = collections.Counter()
    for (part, order, step), c in out.items():
        value[part, order[step - 1]] += c[1]
    return {(*k, *c, value[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


@pytest.mark.parametrize("hot", [1000, 2])
def test_filter_audit(docs, labels, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)  # with 2, texts of more than half of the rows go the broadcast way
    got = filter_audit.audit(docs, labels).collect()
    assert {tuple(r) for r in got} == replayed(ROWS, LABELS) and len(got) == 4 * 600


def test_filter_audit_of_one_text_and_of_nothing(spark, docs, labels, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT", 2)
    rows = [(k % 7, "one text", "a") for k in range(40)]
    assert {tuple(r) for r in filter_audit.audit(spark.createDataFrame(rows, SCHEMA), labels).collect()} == replayed(rows, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert {tuple(r) for r in filter_audit.audit(docs, labels.limit(0)).collect()} == replayed(ROWS, [])


# ---- 12 --------------------------------------------------------------------------------------------------------------
def packed_right(got, rows, sequence=1024):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, _ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        begin = [0, *range(len(ids) % sequence or sequence, len(ids), sequence)] if len(ids) > sequence else [0]
        want.update((i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(begin, [*begin[1:], len(ids)], strict=True)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= sequence
    return len(bins)


def test_packing(docs):
    n = packed_right(packing.pack(docs).collect(), ROWS)
    total = packing.pieces(docs).agg(F.sum("length")).first()[0]
    assert math.ceil(total / 1024) <= n <= math.ceil(total / 1024) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_in_small_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(np.array(["alpha", "beta", "gamma", "delta"])[rng.integers(0, 4, int(n))]), "x") for k, n in enumerate(rng.integers(0, 400, 600))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    n = packed_right(packing.pack(df, group=50).collect(), rows)
    total = packing.pieces(df).agg(F.sum("length")).first()[0]
    alone = packed_right(packing.pack(df, group=50, rounds=1).collect(), rows)
    assert math.ceil(total / 1024) <= n <= math.ceil(total / 1024) * 1.01 + 1 and n < alone  # bins left by groups meet again


def test_encoder_forgets_and_still_knows(monkeypatch):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "REMEMBER", 3)
    encoder = packing.Encoder(tok)
    for k in range(4):
        texts = [f"a b c{k} <|endoftext|> b a", "", "漢字  x\n y", " lead"]
        data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
        ids, count = encoder.encode(data, ends)
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 99), min_size=1, max_size=40))
def test_search_gains_and_keeps_pieces(lengths):
    length = np.array(lengths)
    start = packing.best_fit(length, 100)
    fill = np.bincount(start, length)
    assert fill.max() <= 100 and (np.sort(fill)[:2].sum() > 100 or len(fill) == 1)  # no two bins fit in one
    search = packing.Search(length, start, 100)
    after = np.bincount(search.run(), length)
    assert after.max() <= 100 and after.sum() == length.sum() and (after**2).sum() >= (fill**2).sum() + 2 * search.moves


def test_search_empties_bins_that_best_fit_leaves():
    rng = np.random.default_rng(1)
    length = rng.integers(200, 450, 300)
    start = packing.best_fit(length, 1024)
    after = packing.improve(length, start, 1024, 0)
    assert len(np.unique(after)) < len(np.unique(start))
    one = packing.Search(np.array([60, 30, 40, 50]), np.array([0, 0, 1, 1]), 100)  # one for one: 50 against 40 fills a bin
    assert one.run().tolist().count(0) and sorted(np.bincount(one.run(), one.length))[-1] == 100


# ---- 13 --------------------------------------------------------------------------------------------------------------
def lloyd(vectors, k, rounds):
    """(cluster, distance) of each vector and the centroids, with Python's integers."""
    first = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vectors]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(vectors, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [near(v)[::-1] for _, v in vectors], c


def expected(rows, dims, k=16, rounds=3):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    got, c = lloyd(good, k, rounds)
    by = collections.Counter()
    for j, d in got:
        by[j] += d
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return collections.Counter((i, j, d, by[j], sum(by.values()), names[j]) for (i, _), (j, d) in zip(good, got, strict=True))


def vectors(n, dims, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 4, (6, dims))
    return [(int(i), (middle[i % 6] + rng.normal(0, spread, dims)).astype(np.float32).astype(float).tolist()) for i in range(n)]


def test_clusters(spark):
    rows = [*vectors(300, 8, 1, 0.2), *vectors(100, 8, 2, 3.0), (7, [0.0] * 8), (7, [0.0] * 8), (None, [1.0] * 8), (None, [-1.0] * 8), (1, None), (2, []), (3, [1.0] * 7), (4, [1.0] * 9), (5, [float("nan")] + [0.0] * 7), (6, [float("inf")] + [0.0] * 7), (8, [None] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "own", "cluster", "ids")}).repartition(3)
    for k, rounds in ((16, 3), (5, 6), (1, 2), (500, 1)):
        assert collections.Counter(map(tuple, clusters.cluster(df, dimensions=8, clusters=k, rounds=rounds).collect())) == expected(rows, 8, k, rounds)
    assert clusters.cluster(df.limit(0), dimensions=8).count() == 0


def test_clusters_of_ties_and_few_vectors(spark):
    same = [(i, [0.5, 0.25]) for i in range(30)]
    grid = [(i, [i % 5 / 64, i // 5 % 5 / 64]) for i in range(200)]  # most distances are equal to others
    for rows in (same, grid, grid[:3]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert collections.Counter(map(tuple, clusters.cluster(df, dimensions=2).collect())) == expected(rows, 2)


def test_clusters_of_large_components(spark):
    rows = [(i, [(i * 7919 % 1000) * 1000.0, -1e6 + i]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collections.Counter(map(tuple, clusters.cluster(df, dimensions=2).collect())) == expected(rows, 2)
    with pytest.raises(Exception, match="components beyond"):
        clusters.cluster(spark.createDataFrame([(1, [1e200, 0.0])], "vec_id long, embedding array<double>"), dimensions=2).collect()


def test_bounds_save_distances_and_stay_exact():
    rows = np.array([v for _, v in vectors(3000, 8, 4, 0.3)])
    x = np.floor(64 * rows).astype(np.int64)
    c = x[:12].copy()
    full = clusters.squares(x, c)
    own, upper = full.argmin(1), np.sqrt(full.min(1))
    lower = np.sqrt(np.sort(full, 1)[:, 1])
    computed = 0
    for _ in range(5):
        new = np.array([x[own == k].sum(0) // max((own == k).sum(), 1) if (own == k).any() else c[k] for k in range(12)])
        own, upper, lower, n = clusters.assign(clusters.Ball(new), x, own, *clusters.moved(c, new, own, upper, lower))
        c, computed = new, computed + n
        want = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (own == want.argmin(1)).all()
        d = np.sqrt(want)
        assert (upper >= d[np.arange(len(x)), own]).all()
        d[np.arange(len(x)), own] = np.inf
        assert (lower <= d.min(1)).all()
    assert computed < 5 * len(x) * 12 / 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abTs'dll ve1.,!?-(\"<|endoftext|>\n\r\t\x0b\x1c\x7f  \u0085　é漢\U0001f600"), max_size=60), min_size=1, max_size=4))
def test_stretches_are_split_positions(texts):
    tok = TOKENIZER
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, count = packing.Encoder(tok).encode(data, ends)
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
