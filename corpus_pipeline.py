"""A training corpus from raw documents: quality rules, near-duplicates, personal data, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. Its result is written
as Parquet and read again as the next stage's input. All stages but the last return the columns of ``documents``.
Missing texts are empty texts to every stage; extra columns pass through the first four; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import mixing, pieces, pii, quality, similar
from panelyard.llm.common import read, sha256_hex, stored
from panelyard.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Repeated rows get the same verdict."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 and above) stays: the
    one with the smallest id. Candidates come from SimHash fingerprints of 256 bits by a Gray-order index inside bands of
    MinHash values, which stand in for blocks of bits: at this similarity such blocks select nothing. Rows without an id stay when no row of their group has one; of rows that repeat this id,
    one stays."""
    return similar.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, and the text's length is counted anew."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.char_length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn by their weights under a budget of as many tokens as there are; a row drawn twice is there
    twice."""
    return mixing.mix_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every drawn document, and a digest of the decoded text."""
    coded = pieces.encode_documents(docs, tokenizer_path())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("sentencepiece", token_ids),
]

#: No stage but the first can be said in SQL: robust estimates, hashes, trained models, tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"corpus-{name}")
    return stored(STAGES[-1][1](spark, docs, sf_dir), f"corpus-{STAGES[-1][0]}")
