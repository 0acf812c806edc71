"""The registered queries: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import clusters, decontaminate, filter_audit, language_id, language_model, line_dedup, near_dedup, packing, quality, substring_dedup, telephony, token_counts, word_table
from .base import fold, table


def op1_token_counts(spark, sf_dir):
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), "n_chunked")


def op2_lm_scoring(spark, sf_dir):
    out = language_model.score(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0, order=3)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_word_table_bpe(spark, sf_dir):
    return word_table.encode_decode(table(spark, sf_dir, "documents"), full=False)


def op4_telephony_audio(spark, sf_dir):
    return telephony.store_audio(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    out = line_dedup.drop_boilerplate(pages, line_dedup.host_of(F.col("url")), line_dedup.page_text(F.col("html")), min_pages=5)
    return out.select("page_id", "host", "n_lines", "n_dropped", "text")


def op6_decontaminate(spark, sf_dir):
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    trees = language_id.learn(docs, fold("doc_id", 3) != 1)
    out = language_id.identify(docs, trees)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_quality_classifier(spark, sf_dir):
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: fold(c, 3) != 1)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), full=False)


def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark, sf_dir):
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lm_scoring, op3_word_table_bpe, op4_telephony_audio, op5_line_dedup, op6_decontaminate, op7_language_id, op8_quality_classifier, op9_minhash_near_dedup, op10_suffix_array_dedup, op11_filter_audit, op12_best_fit_packing, op13_centroid_clustering)}
SQL: dict[str, str] = {"op5_line_dedup": line_dedup.SQL, "op6_decontaminate": decontaminate.SQL, "op11_filter_audit": filter_audit.SQL, "op13_centroid_clustering": clusters.SQL}
