"""A corpus pipeline: from documents to the token ids of those that stay.

A stage takes a table with doc_id and text and keeps all its columns, whatever their names, but for the last one. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontam, neardup, pii, toxicity
from sparkloom.llm.common import few, free, keys_of, scratch, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A null or empty text is scored as one without words; rows that repeat are scored each; null ids count like others."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@scratch
def _near_copies(docs: DataFrame) -> DataFrame:
    return neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id. Texts without words and null ids are linked with nothing and stay; rows that repeat an id stay or go together."""
    gone = _near_copies(docs)
    (key,) = free(docs.columns, "doc_id_")
    return docs.join(few(gone).select(F.col("doc_id").alias(key)), docs["doc_id"].cast("long") == F.col(key), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark. A null text has no words and stays; of rows that share an id each is judged by its text, and so are null ids."""
    found = written(decontam.hits(docs, table(spark, sf_dir, "benchmark")).select("d", "h"))
    d, h = free(docs.columns, "d", "h")
    at_d, at_h = keys_of(docs)
    return docs.join(few(found).select(F.col("d").alias(d), F.col("h").alias(h)), (at_d == F.col(d)) & (at_h == F.col(h)), "left_anti")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; see pii.sanitise() for nulls and repeated rows."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of each document. A null text has no ids; repeated rows and null ids get a row each."""
    ids = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256)).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
