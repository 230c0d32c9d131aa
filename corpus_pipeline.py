"""The corpus pipeline: documents that are rejected or repeated go, personal data is masked, and what stays is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. No rows give no rows; columns that documents may have besides are carried along,
whatever their names, up to the packing, which returns pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact_dedup, ngram_join, packing, pii, quality
from weftline.llm.common import checkpoint_dir, remove
from weftline.llm.registry import word_tokenizer
from weftline.session import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as toxic or as not good, go. Null texts count as empty; rows that repeat an id or a text are judged each for itself."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).filter("keep").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays; a null text equals an empty one, a null id is smaller than all others."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share eight tenths of their five-word shingles, directly or through others, the one with the smallest doc_id stays. Texts without words all stay."""
    return ngram_join.without_near_duplicates(docs, width=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, and n_chars is counted anew; all rows stay, and null texts stay null."""
    return pii.mask_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the texts, each with its sequence and place; a null or empty text is a piece of one token."""
    return packing.pack(packing.token_pieces(docs, word_tokenizer()))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    packed = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)  # the pieces are cut from their lineage by now
    return packed
