"""The pipeline's stages against plain Python, on a small corpus written as Parquet."""

import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from mediagrove.llm.base import cut  # noqa: E402

from .test_operators import PASSAGE, plain_contamination, plain_lines, plain_near, same, sentence, text  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    out = []
    for k in range(120):
        body = "!! | $$$ " * 15 + str(k) if k % 6 == 5 else sentence(k, 80)
        out.append((k, ("common menu line\n" if k % 2 else "") + body, "en", f"s{k % 3}", 0))
    out += [(200 + k, out[k][1] + " more", "en", "s0", 0) for k in range(0, 20, 4)]  # near copies
    out += [(300, sentence(900, 30) + " " + PASSAGE, "en", "s1", 0), (301, None, None, None, None), (302, "", "en", "s1", 0), (None, sentence(901, 70), None, None, None)]
    return [(*r[:4], len(r[1]) if r[1] is not None else None) for r in [*out, out[0]]]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows(), DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 != 5), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    quality, lines, near, clean, encode = (f for _, f in corpus_pipeline.STAGES)
    columns = docs.columns

    one = cut(quality(spark, docs, corpus))
    left = {r.doc_id for r in one.collect()}
    assert one.columns == columns and not left & {k for k in range(120) if k % 6 == 5}
    assert left >= {k for k in range(120) if k % 6 != 5}

    before = [tuple(r) for r in one.collect()]
    two = cut(lines(spark, one, corpus))
    kept = plain_lines([(r[3], r[1]) for r in before], 0.1, 5)
    same(two.collect(), [(r[0], t, r[2], r[3], r[4] if t == r[1] else len(t)) for r, t in zip(before, kept, strict=True)])
    assert "common menu line" not in {t.split("\n")[0] for t in kept if t}

    before = [tuple(r) for r in two.collect()]
    three = cut(near(spark, two, corpus))
    stays = {(d[0], *d[1:]) for d in before if d[0] is None} | {min(x for x in before if x[0] == i) for i, _, _, keep in plain_near(before) if keep and i is not None}
    same(three.collect(), stays)

    before = [tuple(r) for r in three.collect()]
    four = cut(clean(spark, three, corpus))
    bad = {w[0] for w in plain_contamination(before, [(1, PASSAGE), (2, "")]) if w[-1]}
    assert 300 in bad
    same(four.collect(), [r for r in before if r[0] not in bad])

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in four.collect():
        ids = tok.encode(text(r), add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same(encode(spark, four, corpus).collect(), want)


def test_run_on_nothing(spark, tmp_path):
    for name, ddl in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
