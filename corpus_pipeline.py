"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

quality (5) drops what the classifier rejects; near_duplicates (8) keeps one document of each component;
decontamination (7) drops documents that hold a benchmark window; secrets (2) puts secrets out of the texts and keeps
every document; packing (10) returns the pieces of the packed sequences.

Defined results: all but the last stage return the columns of their input, whatever there are, in their order. A null
text counts as empty: quality scores it by the bias, the others keep it, and it packs as its closing id. Rows with a
null doc_id are judged by their own text and never stand for others. Rows with equal doc_id and text are one document
to near_duplicates_8, rows with equal doc_id and other texts are documents of their own. Empty tables give no pieces.
A stage's table is deleted when the next one's is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import common, decontaminate, jaccard, pack, quality
from folioforge.llm import secrets as secret_scan


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, common.read(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, common.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_5", keep_quality),
    ("near_duplicates_8", keep_one_of_each),
    ("decontamination_7", keep_uncontaminated),
    ("secrets_2", redact_secrets),
    ("packing_10", pack_sequences),
]
#: Training, graph search and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            schema = docs.schema
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.schema(schema).parquet(f"{folder}/{name}")
            if k:
                common.deleted(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
