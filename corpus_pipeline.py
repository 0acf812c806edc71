"""The corpus pipeline: from ``documents`` to token ids, in five stages that each apply one operator to all that is left.

In every stage a null text is treated as an empty one (and stays null in the rows that are kept), very long texts are taken whole, an empty table gives
an empty result, and further columns go along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagrove.llm import decontaminate, line_dedup, near_dedup, quality, word_table
from mediagrove.llm.base import cut, fold, release, spread, table, tune


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels of documents of two folds of three.

    A row is judged by its text alone: null and empty texts by the statistics of the empty text, repeated rows alike, rows without an id too. Without
    labels every score is 0.5, and all rows stay.
    """
    tune(spark)
    described = cut(quality.describe(docs))
    model = quality.fit(described, table(spark, sf_dir, "labels"), fold("id", 3) != 1)
    release(described)
    return quality.keep_good(spread(docs), model)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go, if they stand on five of them at least; every document stays, ``n_chars`` follows its text.

    Each row counts as a document, repeated or not; rows without a source are those of the source ''; a text may become empty.
    """
    tune(spark)
    out = line_dedup.drop_boilerplate(docs, F.col("source"), F.col("text"), min_pages=5)
    changed = F.col("n_dropped") > 0
    return out.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays; of rows of one id, the least row.

    Texts without words are linked with nothing, and so are rows without an id: all of these stay.
    """
    tune(spark)
    found = near_dedup.near_duplicates(docs)
    gone = cut(found.where("not kept").select("doc_id").distinct())
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    rest = [F.col(c) for c in docs.columns if c != "doc_id"]
    one = out.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*").select(docs.columns)
    return one.unionByName(out.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go. Each row is judged by its own text: null, empty and clean texts stay, whatever their id."""
    return decontaminate.keep_clean(spread(docs), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests: a row a document, null and empty texts with no ids, ids null or repeated as they are."""
    tune(spark)
    return word_table.encode_decode(docs, full=False)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: SQL can't express the classifier, the links or the encoding; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
