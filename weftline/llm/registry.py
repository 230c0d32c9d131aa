"""The queries of the corpus operators, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import divergence, exact_dedup, fingerprints, licenses, line_dedup, ngram_join, packing, periodic, pii, preference, quality, quantised, sentencepiece_nbest
from weftline.session import table

Query = Callable[[SparkSession, str], DataFrame]


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), word_tokenizer()))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_nbest.segment_digests(table(spark, sf_dir, "documents"), piece_model())


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.neighbours(table(spark, sf_dir, "conversations"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


_ALL = (
    op1_license_scan,
    op2_ngram_jaccard_join,
    op3_line_dedup,
    op4_best_fit_packing,
    op5_sentencepiece,
    op6_quality_classifier,
    op7_chat_preferences,
    op8_fingerprints,
    op9_pii,
    op10_exact_dedup,
    op11_embedding_near_dedup,
    op12_periodic_runs,
    op13_source_divergence,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_jaccard_join": ngram_join.ORACLE_SQL,
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op7_chat_preferences": preference.ORACLE_SQL,
        "op9_pii": pii.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_embedding_near_dedup": quantised.ORACLE_SQL,
        "op13_source_divergence": divergence.ORACLE_SQL,
    }
