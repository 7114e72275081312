"""A corpus pipeline: quality rules, near-dedup, personal data, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.llm import bpe_chunks, pii_bootstrap, quality_rules, simhash_dedup, source_mixing
from debtscope.llm.common import materialize

#: The mix: a source belongs to one of four domains by the number in its name; weights are
#: shares among siblings.  The budget is the tokens there are; up to two epochs.
MIX = {
    "levels": {
        "domain": "concat('domain', coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS bigint) % 4, 0))",
        "language": "lang",
        "source": "source",
    },
    "weights": {
        "domain": {"domain0": 250, "domain1": 300, "domain2": 250, "domain3": 200},
        "language": {"en": 550, "de": 150, "fr": 150, "es": 150},
    },
    "total": "sum(tokens)",
    "max_epochs": 2,
    "seed": 42,
}


#: Bytes of texts or ids in one batch to or from a Python worker.  Spark bounds batches by rows
#: alone if nothing else is set, and executor and worker hold a batch several times over.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound batches to Python by bytes, for the session, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    small_batches(spark)
    return simhash_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; lengths follow."""
    small_batches(spark)
    return pii_bootstrap.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix; one that two epochs take comes twice."""
    return source_mixing.mix(docs, **MIX).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and their decoded bytes, as digests; one row for each document it gets."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # written first, so that a task has one Python worker at a time
    ids = materialize(bpe_chunks.encode(docs, path, public_tokenizers.PATTERN), "ids")
    return bpe_chunks.decode(ids, path).select(
        F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Fingerprints, extracted identifiers and merge ranks are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
