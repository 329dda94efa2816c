"""The queries opN_<name> over the whole of their tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, bpe, divergence, fill_middle, fingerprints, host_rules, id_files, language, mixing, near_join, packing, quality, shared, url_templates
from .oracles import ORACLES  # noqa: F401

END_ID = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def may_learn(doc_id):
    return ~shared.held_out(doc_id)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = shared.documents(spark, sf_dir), shared.table(spark, sf_dir, "labels")
    out = quality.judge(docs, labels, may_learn)
    return out.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(shared.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(shared.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify(shared.documents(spark, sf_dir), may_learn)
    return out.select("doc_id", shared.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(shared.documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.by_section(shared.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(shared.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.components(shared.documents(spark, sf_dir))


def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(shared.documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), END_ID)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(shared.table(spark, sf_dir, "pages"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(shared.documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(shared.documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(shared.documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_quality_rules, op3_mixing, op4_language_id, op5_fingerprints, op6_token_counts, op7_bpe,
        op8_ngram_jaccard_join, op9_id_files, op10_url_filters, op11_best_fit_packing, op12_source_divergence, op13_fill_in_middle,
    )
}
