"""Each operator against plain Python on awkward rows: nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from mediagrove.llm import anchors, base, components, decontaminate, language_id, language_model, line_dedup, minhash, near_dedup, quality, substring_dedup, suffix_groups, telephony, token_counts, word_table  # noqa: E402
from mediagrove.llm.base import fold  # noqa: E402

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(np.array(WORDS)[rng.integers(0, len(WORDS), n)])


BASE = sentence(1, 60)
PASSAGE = sentence(2, 30)
TEXTS = {
    1: BASE, 2: BASE, 3: BASE.replace("alpha", "ALPHA", 1), 4: " ".join(BASE.split()[:-1]), 5: None, 6: "", 7: " \t\n\x0b", 8: "one", 9: "ONE", 10: "one two three four",
    11: sentence(3, 40) + " " + PASSAGE + " " + sentence(4, 40), 12: sentence(5, 50) + "\n" + PASSAGE, 13: "Ünï códé ß 漢字 \U0001f600  x y é \u0085z",
    14: "<|endoftext|> a<|startoftext|>b <|endoftext|>", 15: sentence(6, 3000), 16: "a" * 3000, 17: "x y " * 700, 18: "!!!", 19: "  lead  and   trail  ", 20: "it's we'll\r\n\r\n  123 4567", 21: "\x00\x01 \x7f",
}
ROWS = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}", 0, "clash", 7) for i, t in TEXTS.items()] + [(2, BASE, "en", "src0", 0, "clash", 7), (None, BASE, None, None, None, None, None), (None, None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, node int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text(row) -> str:
    return row[1] or ""


def same(got, want):
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


# ---- 1 ---------------------------------------------------------------------------------------------------------------
def test_token_counts(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r[0], len(text(r).encode()), len(tok.encode(text(r), add_special_tokens=False).ids)) for r in ROWS]
    same(token_counts.count_tokens(docs).drop("n_chunked").collect(), want)
    small = token_counts.count_tokens(docs, chunk=100, overlap=3)
    assert small.agg(F.sum("n_chunked")).first()[0] > 3000
    same(small.drop("n_chunked").collect(), want)
    assert token_counts.count_tokens(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 's!<|endoftext|>\né 1"), max_size=300), st.integers(1, 90), st.integers(1, 40))
def test_splicing(value, chunk, overlap):
    tok = token_counts.tokenizer("byte_bpe_50k.json")
    assert token_counts.Splicer(tok, chunk, overlap).count(value) == len(tok.encode(value, add_special_tokens=False).ids)


def test_widening():
    tok = token_counts.tokenizer("byte_bpe_50k.json")
    s = token_counts.Splicer(tok, 50, 2)
    assert s.count("a" * 1000) == len(tok.encode("a" * 1000, add_special_tokens=False).ids)
    assert s.widened > 0


# ---- 2 ---------------------------------------------------------------------------------------------------------------
def test_language_model(docs, empty):
    learns = lambda r: zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 10 != 0
    tokens = [[*WHITE.findall(low(text(r))), "</s>"] for r in ROWS]
    own = [t for t, r in zip(tokens, ROWS, strict=True) if learns(r)]
    one = collections.Counter(w for t in own for w in t)
    two = collections.Counter(p for t in own for p in itertools.pairwise(["<s>", *t]))
    total, kinds, mass = sum(one.values()), len(one), language_model.MASS
    got = sorted(language_model.score(docs, fold("doc_id", 10) != 0).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    for g, (t, r) in zip(got, sorted(zip(tokens, ROWS, strict=True), key=lambda p: (str(p[1][0]), len(p[0]))), strict=True):
        base = [(one[w] + 0.1) / (total + 0.1 * (kinds + 1)) for w in t]
        before = ["<s>", *t]
        chain = [(two[h, w] + mass * b) / ((len(own) if h == "<s>" else one[h]) + mass) for h, w, b in zip(before, t, base, strict=False)]
        assert (g.doc_id, g.train, g.n_tokens, g.n_known, g.train_tokens) == (r[0], learns(r), len(t), sum(one[w] > 0 for w in t), total)
        assert g.base_score == pytest.approx(sum(map(math.log10, base)), rel=1e-9)
        assert g.score == pytest.approx(sum(map(math.log10, chain)), rel=1e-9)
    assert language_model.score(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize(("order", "segment"), [(1, 512), (3, 512), (4, 512), (3, 4), (2, 7)])
def test_language_model_order(docs, order, segment, monkeypatch):
    automaton = language_model.Automaton
    monkeypatch.setattr(language_model, "Automaton", lambda *a: automaton(*a, segment=segment))
    learns = lambda r: zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 10 != 0
    tokens = [["<s>", *WHITE.findall(low(text(r))), "</s>"] for r in ROWS]
    seen = collections.Counter(tuple(t[k - n : k]) for t, r in zip(tokens, ROWS, strict=True) if learns(r) for n in range(1, order + 1) for k in range(n, len(t) + 1))
    total, kinds = sum(c for g, c in seen.items() if len(g) == 1 and g != ("<s>",)), sum(len(g) == 1 and g != ("<s>",) for g in seen)

    def p(h, w):
        if not h:
            return (seen[w,] + 0.1) / (total + 0.1 * (kinds + 1))
        return (seen[*h, w] + language_model.MASS * p(h[1:], w)) / (seen[h] + language_model.MASS)

    want = [(r[0], len(t) - 1, sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), t[k])) for k in range(1, len(t)))) for t, r in zip(tokens, ROWS, strict=True)]
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in language_model.score(docs, fold("doc_id", 10) != 0, order=order, block_bytes=5000).collect()), key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and g[2] == pytest.approx(w[2], rel=1e-9)


# ---- 3 ---------------------------------------------------------------------------------------------------------------
def test_word_table(docs, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in ROWS:
        ids = tok.encode(text(r), add_special_tokens=False).ids
        shown = tok.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), list(ids), shown))
    same(word_table.encode_decode(docs, block_bytes=5000).collect(), want)
    assert word_table.encode_decode(empty, full=False).count() == 0


# ---- 4 ---------------------------------------------------------------------------------------------------------------
def plain_adpcm(payload):
    out = []
    for at in range(0, len(payload), 64):
        block = payload[at : at + 64]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(value)
        for b in block[4:]:
            for nib in (b & 15, b >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + step * (nib >> 2 & 1) + (step >> 1) * (nib >> 1 & 1) + (step >> 2) * (nib & 1)
                value = max(-32768, min(32767, value - change if nib & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nib & 7]))
                out.append(value)
    return out


def plain_g711(codec, payload):
    out = []
    for b in payload:
        if codec == "mulaw":
            b = ~b & 255
            size = (((b & 15) * 2 + 33) << (b >> 4 & 7)) * 4 - 132
            out.append(-size if b & 128 else size)
        else:
            b ^= 0x55
            part, low = b >> 4 & 7, b & 15
            size = (low * 2 + 1) * 8 if part == 0 else (low * 2 + 33) * 8 << (part - 1)
            out.append(size if b & 128 else -size)
    return out


def test_telephony(docs, empty):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = sorted(telephony.store_audio(docs).collect(), key=lambda r: (str(r.doc_id), r.payload_sha256))
    want = [(r[0], text(r).encode()) for r in ROWS]
    want = [(i, raw, raw + bytes(64 * max(1, math.ceil(len(raw) / 64)) - len(raw))) for i, raw in want]
    for g, (i, raw, payload) in zip(got, sorted(want, key=lambda w: (str(w[0]), sha(w[2]))), strict=True):
        assert (g.doc_id, g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (i, len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(g.media), sha(g.media)) and telephony.read_wav(g.media)[3] == payload
        codec = telephony.NAMES[zlib.crc32(payload) % 3]
        pcm = plain_adpcm(payload) if codec == "adpcm" else plain_g711(codec, payload)
        twice = [v for a, b in zip(pcm, [*pcm[1:], pcm[-1]], strict=True) for v in (a, (a + b) >> 1)]
        stored = np.array(twice, "<i2").tobytes()
        assert telephony.read_wav(g.pcm) == ("pcm", 16000, 2, stored)
        peak, power, turns = max(map(abs, pcm)), sum(v * v for v in pcm), sum((a >= 0) != (b >= 0) for a, b in itertools.pairwise(pcm))
        assert g.feature == f"{codec};n={len(pcm)};peak={peak};rms={int(1000 * (power / len(pcm)) ** 0.5)};zc={turns};pcm={sha(stored)}"
    assert telephony.store_audio(empty).count() == 0


def test_tables_and_adpcm():
    assert telephony.TABLES["mulaw"][[0x00, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.TABLES["alaw"][[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (20, 64), dtype=np.uint8)
    for block, got in zip(blocks, telephony.decode_adpcm(blocks), strict=True):
        value, index = int(block[:2].copy().view("<i2")[0]), min(int(block[2]), 88)
        want = [value]
        for b in block[4:].tolist():
            for nib in (b & 15, b >> 4):
                step = int(telephony.STEPS[index])
                change = (step >> 3) + step * (nib >> 2 & 1) + (step >> 1) * (nib >> 1 & 1) + (step >> 2) * (nib & 1)
                value = max(-32768, min(32767, value - change if nib & 8 else value + change))
                index = max(0, min(88, index + int(telephony.MOVES[nib])))
                want.append(value)
        assert got.tolist() == want
    x = rng.integers(-32768, 32768, 50).astype("<i2")
    assert telephony.resample(x, 8000, 16000).tolist() == [int(v) for k in range(50) for v in (x[k], (int(x[k]) + int(x[min(k + 1, 49)])) >> 1)]
    with pytest.raises(ValueError):
        telephony.read_wav(b"RIFF")


# ---- 5 ---------------------------------------------------------------------------------------------------------------
def plain_lines(rows, ratio, least):
    pages, found = collections.Counter(), collections.Counter()
    for host, t in rows:
        pages[host or ""] += 1
        found.update({(host or "", x.strip(" \t\r")) for x in (t or "").split("\n") if t is not None and x.strip(" \t\r")})
    bad = {k for k, n in found.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (host or "", x.strip(" \t\r")) not in bad) for host, t in rows]


@pytest.mark.parametrize("few", [100_000, 0])
def test_line_dedup(spark, empty, few):
    rows = [("a" if k % 3 else "b", "\n".join([" menu\t", f"line {k}", "foot" if k % 2 else "other", "", "x"])) for k in range(40)] + [(None, None), ("a", ""), ("c", "menu"), (None, "menu"), ("a", "menu\nmenu")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "h string, text string, host string")
    got = line_dedup.drop_boilerplate(df, F.col("h"), F.col("text"), ratio=0.4, min_pages=5, few=few).collect()
    same([(r.h, r.text) for r in got], list(zip([r[0] for r in rows], plain_lines(rows, 0.4, 5), strict=True)))
    alone = line_dedup.drop_boilerplate(df, F.col("h"), F.col("text"), ratio=0.0255, few=few).collect()  # the ratio alone, by its decimals
    same([(r.h, r.text) for r in alone], list(zip([r[0] for r in rows], plain_lines(rows, 0.0255, 1), strict=True)))
    assert line_dedup.drop_boilerplate(empty, F.col("source"), F.col("text")).count() == 0


@pytest.mark.parametrize("few", [100_000, 0])
def test_line_dedup_sql_and_clashing_names(spark, few):
    import duckdb

    pages = [(k % 9, "http://A.b/x" if k % 4 else None, None if k % 8 == 7 else f"<p>menu</p>\n<b>line {k}</b>\n \nfoot{k % 5}", "a", "b") for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, __host string, __kept string")
    out = line_dedup.drop_boilerplate(df, line_dedup.host_of(F.col("url")), line_dedup.page_text(F.col("html")), min_pages=5, few=few)
    assert {"__host", "__kept"} < set(out.columns) and out.where("__host != 'a' or __kept != 'b'").count() == 0
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [p[0] for p in pages], "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string())}))
    same(out.select("page_id", "host", "n_lines", "n_dropped", "text").collect(), con.execute(line_dedup.SQL).fetchall())


# ---- 6 ---------------------------------------------------------------------------------------------------------------
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(rows, items, n=13):
    words = lambda s: ALNUM.findall(s.encode().lower()) if s else []
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    for r in rows:
        w = words(text(r))
        hit, seen = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if got := windows.get(tuple(w[k : k + size])):
                    seen |= got
                    hit |= set(range(k, k + size))
        yield r[0], len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_decontaminate(spark, docs, empty, limit):
    items = [(1, PASSAGE), (2, "One!"), (10, sentence(6, 20)), (3, None), (4, ""), (5, "?!"), (2, "One!"), (7, "漢字"), (8, "alpha beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = list(plain_contamination(ROWS, items))
    got = decontaminate.decontaminate(docs, bench, limit=limit)
    same(got.drop("items", "spans").collect(), want)
    bad = {w[0] for w in want if w[-1]}
    same([(r.doc_id, r.text) for r in decontaminate.keep_clean(docs, bench, limit=limit).collect()], [r[:2] for r in ROWS if r[0] not in bad])
    for r in got.where("doc_id = 8").collect():
        assert (r["items"], r.spans) == (["2"], [[0, 3]])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_keep_clean_judges_rows_not_ids(spark, limit):
    one, other, long = sentence(53, 13), sentence(55, 13), sentence(54, 450)
    items = [(1, PASSAGE), (2, sentence(50, 20)), (3, sentence(51, 20)), (4, one), (6, other)]
    dirty = [(None, sentence(52, 40) + " " + PASSAGE, 1), (5, sentence(50, 20), 2), (5, f"{one} {long} {other}", 3)]  # in the last, no item alone has a twentieth
    clean = [(None, sentence(56, 40), 4), (None, None, 5), (5, sentence(57, 40), 6), (5, f"{one} {long}", 7), (None, f"{long} {other}", 8)]
    docs = spark.createDataFrame(dirty + clean, "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [w[-1] for w in plain_contamination([d[:2] for d in dirty + clean], items)] == [True] * 3 + [False] * 5
    got = decontaminate.keep_clean(docs, bench, limit=limit)
    assert got.schema == docs.schema
    same(got.collect(), clean)


# ---- 7 ---------------------------------------------------------------------------------------------------------------
def plain_bits(trees, texts, lang, data: bytes) -> float:
    counts = collections.defaultdict(collections.Counter)
    for t in texts[lang]:
        for k in range(trees.order + 1):
            for i in range(k, len(t)):
                counts[t[i - k : i]][t[i]] += 1
    out = 0.0
    for i, c in enumerate(data):
        for k in range(min(i, trees.order), -1, -1):
            seen = counts.get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if c in seen:
                out += math.log2((n + d) / seen[c])
                break
            out += math.log2((n + d) / d)
        else:
            out += 8
    return out


def test_language_trees():
    texts = {"en": [b"the cat sat on the mat", b"this is that"], "de": ["die Katze saß auf".encode(), b""]}
    trees = language_id.Trees(texts)
    samples = [b"the mat is", "saß die".encode(), b"", b"zq\xff", b"a"]
    ends = np.cumsum([0, *map(len, samples)])
    got = trees.lengths(np.frombuffer(b"".join(samples), np.uint8), ends)
    for s, row in zip(samples, got, strict=True):
        assert row.tolist() == pytest.approx([plain_bits(trees, texts, x, s) for x in trees.langs], rel=1e-5)


def test_language_id(spark, docs, empty):
    rows = [(k, ("the cat and the hat were that of " if k % 2 else "der hund und die katze sind nicht ") * 3, "en" if k % 2 else "de") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn(df, fold("doc_id", 3) != 1)
    got = {r.doc_id: r for r in language_id.identify(df, trees).collect()}
    assert all(got[k].lang_pred == x and 0 <= got[k].score <= 1 for k, _, x in rows)
    odd = language_id.identify(docs, trees).collect()
    assert len(odd) == len(ROWS)
    assert {r.lang_pred for r in odd if r.doc_id in (5, 6, 7, 18, 21)} == {"und"}
    none = language_id.learn(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}
    assert language_id.identify(empty, trees).count() == 0


def test_languages_of_many_scripts():
    """Trees of 40 languages, each in letters of its own, take what they take one by one, and no more than is allowed."""
    rng = np.random.default_rng(3)
    letters = {f"l{k:02}": [chr(0x4E00 + 300 * k + j) for j in range(30)] + [" "] for k in range(40)}
    text = lambda x, n: "".join(np.array(letters[x])[rng.integers(0, 31, n)])
    texts = {x: [text(x, 3000).encode()] for x in letters}
    few, many = language_id.Trees({x: texts[x] for x in list(texts)[:4]}), language_id.Trees(texts)
    assert many.nbytes < 12 * few.nbytes and many.nbytes == sum(language_id.Trees({x: t}).nbytes for x, t in texts.items())
    samples = [text(x, 60).encode() for x in letters]
    best, share = many.predict(np.frombuffer(b"".join(samples), np.uint8), np.cumsum([0, *map(len, samples)]))
    assert [many.langs[k] for k in best] == sorted(letters) and (share > 0.99).all()
    with pytest.raises(ValueError, match="languages take"):
        language_id.Trees(texts, most_bytes=few.nbytes)


@pytest.mark.parametrize("spare", [8, 2])
def test_language_sample_and_score(spark, spare, monkeypatch):
    monkeypatch.setattr(language_id, "SPARE", spare)
    langs = ["en", "de", None]
    rows = [(k % 40 if k % 11 else None, f"{'the cat' if k % 3 else 'der hund'} {k % 50} " + "x" * (k % 7), langs[k % 3 if k % 3 != 1 else 0]) for k in range(200)] + [(3, None, "en"), (4, "the cat 4", "en"), (4, "the cat 4", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    hashed = df.select("doc_id", "text", "lang", F.xxhash64("doc_id"), F.xxhash64("text"), F.octet_length("text")).collect()
    want = {}
    for x in ("en", "de"):
        usable = sorted(((h & (2**64 - 1)) >> 1, i, ht, n, t) for i, t, own, h, ht, n in hashed if own == x and i is not None and t is not None)[:20]
        sums = itertools.accumulate(u[3] for u in usable)
        want[x] = [u[4].encode() for u, total in zip(usable, sums, strict=True) if total <= 150]
    assert 0 < len(want["en"]) < 20  # the bound on bytes is met
    got, plain = language_id.learn(df, F.lit(True), per_lang=20, per_bytes=150), language_id.Trees({x: t for x, t in want.items() if t})
    assert got.langs == plain.langs and all((a.bits == b.bits).all() and (a.rows == b.rows).all() for a, b in zip(got.trees, plain.trees, strict=True))
    texts = {x: sorted(t) for x, t in want.items()}
    same_id = spark.createDataFrame([(7, f"text {k}", "en") for k in range(50)], "doc_id long, text string, lang string")
    assert language_id.learn(same_id, F.lit(True), per_lang=2).langs == ["en"]
    one = spark.createDataFrame([(1, "the hund 5")], "doc_id long, text string")
    bits = {x: plain_bits(got, texts, x, b"the hund 5") for x in got.langs}
    best = min(bits, key=bits.get)
    (r,) = language_id.identify(one, got).collect()
    assert r.lang_pred == best and r.score == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel=1e-4)
    with pytest.raises(ValueError):
        language_id.Trees({"x": [bytes(range(256))]}, order=4)


# ---- 8 ---------------------------------------------------------------------------------------------------------------
def test_quality(spark, docs, empty):
    rows = [(k, sentence(k, 60) if k % 2 else "!! | $$$ " * 20 + str(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality.classify(df, labels, lambda c: fold(c, 3) != 1).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in got) >= 198
    odd = quality.classify(docs, labels, lambda c: F.lit(True)).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert {r.score for r in quality.classify(docs, labels.limit(0), lambda c: F.lit(True)).collect()} == {0.5}
    assert quality.classify(empty, labels, lambda c: F.lit(True)).count() == 0


def test_statistics_by_hand():
    value = "The cat  sat.\nOn | a mat\t!! cat cat"
    (got,) = quality.statistics(np.frombuffer(value.encode(), np.uint8), np.array([0, len(value)]))
    words, n = value.split(), len(value)
    row = dict(zip(quality.NAMES, got, strict=True))
    shares = collections.Counter(value)
    assert row["class0"] == shares[" "] / n and row["class1"] == 1 / n and row["class3"] == sum(c.islower() for c in value) / n and row["class4"] == 2 / n
    assert row["entropy"] == pytest.approx(-sum(c / n * math.log2(c / n) for c in shares.values()))
    assert row["log_bytes"] == math.log1p(n) and row["log_words"] == math.log1p(len(words)) and row["word_len"] == pytest.approx(sum(map(len, words)) / len(words))
    assert row["distinct"] == len(set(words)) / len(words) and row["top_word"] == 3 / len(words) and row["repeat"] == 1 / len(words) and row["long_words"] == 0
    assert row["capital"] == 2 / len(words) and row["ends_in_mark"] == 3 / len(words) and row["one_letter"] == 2 / len(words) and row["line_len"] == math.log1p(n / 2)


def test_features_approximate_a_kernel():
    model = quality.Model(np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)), 20_000)
    x = np.random.default_rng(4).normal(size=(6, len(quality.NAMES)))
    z = model.lift(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * len(quality.NAMES)))
    assert np.abs(z @ z.T - kernel).max() < 0.03


@pytest.mark.parametrize("fan_in", [16, 2])
def test_fit_by_normal_equations(spark, fan_in, monkeypatch):
    added = quality._added
    monkeypatch.setattr(quality, "_added", lambda parts: added(parts, fan_in))
    rows = [(k, (sentence(k, 5 + k % 60) if k % 2 else "!! | $$$ " * (k % 20)) or None) for k in range(120)] + [(None, "x"), (7, "again"), (7, "again")]
    labels = [(k, k % 2 if k % 10 else 1 - k % 2) for k in range(100)] + [(8, 1), (None, 1), (9, None), (110, 2), (111, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    table = spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1)
    model = quality.fit(quality.describe(df), table, fold("id", 3) != 1)
    known = {}
    for i, y in labels:
        if i is not None and y in (0, 1):
            known[i] = min(y, known.get(i, 1))
    used = [(t or "", known[i]) for i, t in rows if i in known and zlib.crc32(str(i).encode()) % 3 != 1]
    data = [t.encode() for t, _ in used]
    x = quality.statistics(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])).astype(np.float32).astype(float)
    y = np.array([v for _, v in used], float)
    assert model.mean == pytest.approx(x.mean(0)) and model.sd == pytest.approx(np.where(x.std(0) > 1e-9, x.std(0), 1))
    z = model.lift(x)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) / quality.FEATURES * np.eye(z.shape[1]), z.T @ y)
    assert z @ model.weights == pytest.approx(z @ weights, abs=1e-6)
    k = np.clip(np.floor((z @ model.weights + 0.5) * quality.BINS / 2), 0, quality.BINS - 1)
    bins = np.unique(k)
    level = quality.isotonic(np.array([(k == b).sum() for b in bins], float), np.array([y[k == b].mean() for b in bins]))
    assert model.level == pytest.approx(level) and (np.diff(model.level) >= 0).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, labels, lambda c: fold(c, 3) != 1).join(labels, "doc_id").where(fold("doc_id", 3) == 1)
    right, n = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count(F.lit(1))).first()
    trees = language_id.learn(docs, fold("doc_id", 3) != 1)
    lang = language_id.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 3) == 1).where("lang is not null and lang_pred != 'und'")
    right_lang, n_lang = lang.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count(F.lit(1))).first()
    print(f"held out: quality {right:.3f} of {n}, language {right_lang:.3f} of {n_lang}")
    assert n > 50 and right > 0.85 and n_lang > 100 and right_lang > 0.95


def test_isotonic():
    assert quality.isotonic(np.ones(5), np.array([0.1, 0.5, 0.3, 0.2, 0.9])).tolist() == pytest.approx([0.1, 1 / 3, 1 / 3, 1 / 3, 0.9])


# ---- 9 ---------------------------------------------------------------------------------------------------------------
def plain_near(rows):
    sets = []
    for r in rows:
        w = WHITE.findall(low(text(r)))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in itertools.combinations([(r[0], s) for r, s in zip(rows, sets, strict=True) if r[0] is not None and s], 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    return [(r[0], len(s), top(r[0]) if r[0] is not None else None, r[0] is None or top(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)]


def test_near_duplicates(docs, empty):
    same(near_dedup.near_duplicates(docs).collect(), plain_near(ROWS))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicate_chains(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        words = sentence(100 + g, 80).split()
        for k in range(12):  # each copy drifts from the one before, so the ends of a group are linked only through others
            rows.append((g * 12 + k, " ".join(words)))
            words[int(rng.integers(0, len(words)))] = f"w{rng.integers(0, 10**6)}"
    rows = [(1000 - i, t) for i, t in rows]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.collect(), plain_near(rows))


def planted_pairs(size: int, similarity: float, n: int, seed: int):
    """``n`` pairs of sets: a of ``size`` values, b of the same size or without some of them, of at least this similarity."""
    rng = np.random.default_rng(seed)
    for _ in range(n):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        lost = int(len(a) * (1 - similarity) / 2 / ((1 + similarity) / 2))  # of each side, if both are of one size
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - lost]], rng.integers(0, 2**63, lost).astype(np.uint64)])) if lost else a[rng.permutation(len(a))[: math.ceil(similarity * len(a))]]
        yield a, np.sort(b)


@pytest.mark.parametrize("size", [4, 8, 20, 60, 200, 1000])
@pytest.mark.parametrize("similarity", [0.75, 0.8])
def test_recall_of_bands_and_estimates(size, similarity):
    """Of planted pairs: those that share a band, and, for sets that aren't compared exactly, pass the estimate."""
    sets = [x for p in planted_pairs(size, similarity, 2000 if size < 1000 else 500, size) for x in p]
    at = np.cumsum([0, *map(len, sets)])
    value = np.concatenate(sets)
    keys = minhash.band_keys(minhash.signatures(value, at, minhash.BANDS * minhash.ROWS))
    found = (keys[::2] == keys[1::2]).any(1)
    if size > near_dedup.SMALL:
        sketch = minhash.signatures(value, at, near_dedup.BINS).astype(np.uint8)
        found &= (sketch[::2] == sketch[1::2]).mean(1) >= near_dedup.THRESHOLD / 100 - near_dedup.SLACK
    real = np.array([100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)])
    print(f"recall at {size} shingles, similarity {similarity}: {found[real].mean():.5f} of {real.sum()}")
    assert real.all() and found[real].mean() >= 0.999


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Buckets of many blocks, sets that travel and sets that don't: all links that share a band are found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SMALL", 20)
    rng = np.random.default_rng(6)
    common = sentence(60, 25).split()  # a run that most documents share: similar enough to meet, not to be linked
    rows = []
    for k in range(90):
        own = [f"w{rng.integers(0, 10**6)}" for _ in range(22 if k % 2 else 14)]
        rows.append((2 * k, " ".join(common + own)))
        own[int(rng.integers(0, 3))] = "changed"
        rows.append((2 * k + 1, " ".join(common + own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0)
    same(got.collect(), plain_near(rows))


def test_ids_of_several_texts(spark):
    rows = [(1, BASE), (2, BASE), (2, sentence(70, 30)), (3, sentence(70, 30)), (4, sentence(70, 30)), (None, BASE), (5, None), (5, sentence(71, 9))]
    same(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_near(rows))


def test_small_sets_are_compared_exactly():
    least, links = near_dedup.THRESHOLD / 100 - near_dedup.SLACK, 0
    for seed in range(200):  # 3 of 4 shingles: exactly 0.75, whatever the sketch says
        a = np.unique(np.random.default_rng(seed).integers(0, 2**63, 4).astype(np.uint64))
        sets = [a, a[:3], a[:2]]
        sketch = minhash.signatures(np.concatenate(sets), np.array([0, 4, 7, 9]), near_dedup.BINS).astype(np.uint8)
        keys = [[7, *range(k, k + near_dedup.BANDS - 1)] for k in (100, 200, 300)]
        links += (sketch[0] == sketch[1]).mean() < least
        group = pa.table({
            "key": [7] * 3, "i": [0] * 3, "j": [0] * 3, "label": [1, 2, 3], "asks": [True, False, False], "lives": [True] * 3, "id": [1, 2, 3], "sketch": [x.tobytes() for x in sketch],
            "small": [x.tobytes() for x in sets], "keys": pa.array(keys, pa.list_(pa.int64())),
        })
        assert near_dedup._compare(group, least, near_dedup.THRESHOLD, pa.int64()).to_pylist() == [{"a": 1, "b": 2}]
    assert links > 0  # of these, the sketch alone would have lost some


def test_signature_estimates():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]))
    both = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 2048)
    assert (both[0] == both[1]).mean() == pytest.approx(300 / 500, abs=0.08)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 50), (70, 60), (60, 80)], "a long, b long")
    same(components.components(links).collect(), [(k, 0) for k in range(31)] + [(50, 50), (60, 60), (70, 60), (80, 60)])


# ---- 10 --------------------------------------------------------------------------------------------------------------
def plain_repeats(rows, n=50):
    order = sorted(rows, key=lambda r: math.inf if r[0] is None else r[0])
    first = {}
    for r in order:
        data = text(r).encode()
        for k in range(len(data) - n + 1):
            first.setdefault(data[k : k + n], math.inf if r[0] is None else r[0])
    for r in rows:
        data, gone = text(r).encode(), np.zeros(len(text(r).encode()), bool)
        for k in range(len(data) - n + 1):
            if first[data[k : k + n]] < (math.inf if r[0] is None else r[0]):
                gone[k : k + n] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        yield r[0], len(data), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0, hashlib.sha256(kept).hexdigest(), kept


@pytest.mark.parametrize("hot", [256, 2])
def test_repeats(docs, empty, hot):
    got = substring_dedup.remove_repeats(docs, hot=hot, block_bytes=4000).drop("spans").collect()
    same([(*r[:5], bytes(r.kept)) for r in got], plain_repeats(ROWS))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeats_ids(spark):
    rows = [(-7, BASE), (5, BASE + " more"), (-9, sentence(9, 30) + BASE), (None, BASE), (0, ""), (5, BASE)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    same([(*r[:5], bytes(r.kept)) for r in substring_dedup.remove_repeats(df).drop("spans").collect()], plain_repeats(rows))
    with pytest.raises(TypeError):
        substring_dedup.remove_repeats(df.withColumn("doc_id", F.lit("a")))


_AROUND = st.text("ab", max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), _AROUND, _AROUND, st.integers(-9, 9)), min_size=1, max_size=60), st.sampled_from([0, 40, 10_000]))
def test_lanes_split_to_any_size(contexts, limit):
    length, gram = 8, 3
    found = {}
    for lane, left, right, i in contexts:  # each window of 8 bytes holds the gram, which stands once in a context
        if len(left) + len(right) >= length - gram:
            found[lane, left + "xyz" + right] = min(i, found.get((lane, left + "xyz" + right), 9))
    if not found:
        return
    keys = sorted(found)
    size = np.array([len(t) for _, t in keys])
    data = np.frombuffer("".join(t for _, t in keys).encode(), np.uint8)
    got = substring_dedup.least_ids(np.array([k for k, _ in keys]), data, np.cumsum(size) - size, size, np.array([t.index("x") for _, t in keys]), np.array([found[k] for k in keys]), length, gram, limit)
    least = collections.defaultdict(lambda: 10)
    shown = [(k, t[w : w + length], found[k, t]) for k, t in keys for w in range(len(t) - length + 1)]
    for k, w, i in shown:
        least[k, w] = min(least[k, w], i)
    assert got.tolist() == [least[k, w] for k, w, _ in shown]


def test_anchors_do_not_depend_on_runs():
    data = np.frombuffer("".join(TEXTS[k] or "" for k in TEXTS).encode(), np.uint8)
    ends = np.cumsum([0, *(len((t or "").encode()) for t in TEXTS.values())])
    one, two = (anchors.Anchors(data, ends, chunk=c) for c in (1 << 20, 333))
    for name in ("place", "first", "last", "key", "doc"):
        assert getattr(one, name).tolist() == getattr(two, name).tolist()
    assert int((one.last - one.first + 1).sum()) == int(np.maximum(np.diff(ends) - 49, 0).sum())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=30), min_size=1, max_size=5))
def test_suffix_arrays(lanes):
    texts = [[*x, 0] for x in lanes]
    length = np.array([len(x) for x in texts])
    base = np.cumsum(length) - length
    want = [b + k for b, x in zip(base, texts, strict=True) for k in sorted(range(len(x)), key=lambda k: x[k:])]
    assert suffix_groups.suffix_arrays(np.concatenate(texts), length).tolist() == want


# ---- all -------------------------------------------------------------------------------------------------------------
def test_very_long_texts(spark):
    """Texts of more than a slice (1 MiB), one of them without any space, among short ones."""
    rng = np.random.default_rng(12)
    words = np.array([f"w{k}" for k in range(5000)])[rng.integers(0, 5000, 230_000)]
    long = " ".join(words)
    assert len(long) > base.SLICE_BYTES
    near = " ".join([*words[:-9], "another", "end"])
    rows = [(1, long), (2, BASE), (3, near), (4, "x" * 40_000), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    same(token_counts.count_tokens(df).select("doc_id", "n_tokens").collect(), [(r[0], len(one.encode(text(r), add_special_tokens=False).ids)) for r in rows])
    ids = [np.array(two.encode(text(r), add_special_tokens=False).ids, "<u4") for r in rows]
    same(word_table.encode_decode(df).select("doc_id", "n_tokens", "ids_sha256").collect(), [(r[0], len(i), hashlib.sha256(i.tobytes()).hexdigest()) for r, i in zip(rows, ids, strict=True)])
    same(near_dedup.near_duplicates(df).collect(), plain_near(rows))
    same([(*r[:5], bytes(r.kept)) for r in substring_dedup.remove_repeats(df).drop("spans").collect()], plain_repeats(rows))
    items = [(1, " ".join(words[100_000:100_040])), (2, "no such words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.decontaminate(df, bench).drop("items", "spans").collect(), list(plain_contamination(rows, items)))
    got = {r.doc_id: r for r in telephony.store_audio(df, codec="adpcm").collect()}
    assert telephony.read_wav(got[1].media)[3].rstrip(b"\0") == long.encode() and got[1].n_bytes == len(long)
    scored = {r.doc_id: r for r in language_model.score(df, F.lit(True), order=3).collect()}
    assert scored[1].n_tokens == 230_001 and scored[5].n_tokens == 1 and scored[1].score > scored[1].base_score
    assert quality.describe(df).count() == 5


@pytest.mark.parametrize(("nodes", "askers"), [(5000, 3), (2000, 1500), (10, 1)])
def test_blocks_hold_what_asks(spark, nodes, askers):
    mixed = spark.range(nodes).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.when(F.col("id") < askers, F.col("id")).otherwise(-1).alias("label"), (F.col("id") < askers).alias("asks"))
    got = near_dedup._placed(mixed, 1024).toPandas()
    blocks = lambda n: -(-n // 1024)
    assert len(got) <= nodes * blocks(askers) + askers * blocks(nodes)
    assert got.groupby(["i", "j"]).size().max() <= 2 * 1024 * 1.2
    met = got[got.asks].merge(got[got.lives], on=["i", "j"])[["id_x", "id_y"]]
    assert len(met) == askers * nodes and not met.duplicated().any()  # who asks meets every living node once


def test_near_duplicates_over_small_blocks(spark, monkeypatch):
    """Buckets of many blocks, after two rounds of stars and without any, give the links that brute force gives."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base_words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(base_words[: 40 - k % 3] + [f"x{k % 3}"] * (k % 2)), None, None, 0, "c", 1) for k in range(120)]
    rows += [(200 + k, " ".join(f"y{k // 4}z{j}" for j in range(30)) + (" end" if k % 4 else ""), None, None, 0, "c", 1) for k in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t, *_ in rows for w in [t.split()]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    for rounds in (0, 2):
        got = near_dedup.near_duplicates(df, rounds=rounds).select("doc_id", "component_id").collect()
        assert {tuple(r) for r in got} == {(i, find(i)) for i in sets}
