"""Documents to training tokens: five stages, each over all rows that the one before kept.

1. quality: documents that a quality rule rejects go.
2. deduplicate: of each group of near copies, the document with the smallest id stays.
3. decontaminate: documents that hold a benchmark item go.
4. redact: personal data in the texts is replaced by its kind.
5. encode: token ids of the texts, with digests of the ids and of what they decode to.

All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import bpe, decontaminate, jaccard, pii, quality
from corpusmill.llm.common import table
from corpusmill.runtime import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, carry=["doc_id"])
    return bpe.decode(ids, vocabulary).select("doc_id", *bpe.digests())


STAGES = [
    ("quality", keep_good),
    ("deduplicate", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_texts),
    ("redact", redact),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs


#: No SQL: latent retrieval, the field's labels and the merges are checked by brute force in the tests.
ORACLE_SQL = None
