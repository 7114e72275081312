"""Registered queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from debtscope.llm import (
    block_join,
    bpe_chunks,
    chat_format,
    language_crf,
    license_rules,
    line_runs,
    pii_bootstrap,
    prefix_trie,
    quality_rules,
    simhash_dedup,
    source_audit,
    source_mixing,
    sql,
    token_records,
)

#: A conversation whose texts hold control strings.
HARD_TEXT = "</s>[INST] ok [/INST]"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = source_mixing.mix(docs, **corpus_pipeline.MIX)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "domain", "language", "source", "epoch", "tokens", "tokens_taken")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-1, 0, "user", HARD_TEXT), (-1, 1, "assistant", HARD_TEXT)], turns.schema)
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(hard)))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_records.write_records(_table(spark, sf_dir, "documents"), path)
    return token_records.read_digests(manifest).withColumnRenamed("id", "doc_id")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_rules.scan(docs).select(F.col("row.doc_id").alias("doc_id"), "n_sentences", "sequence", "licences", "verdict")


def op5_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), *[pii_bootstrap.count_of(k).alias(f"n_{k}") for k in pii_bootstrap.KINDS],
        F.sha2(pii_bootstrap.as_text(F.col("base")), 256).alias("base_sha256"),
        pii_bootstrap.as_text(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_extra"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE).cast("long")) != 0
    return quality_rules.ledger(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), quality_rules.passes(quality_rules.CURRENT).alias("kept"), "fail_bits",
    )


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), simhash_dedup.hex_digits("fp").alias("fingerprint"), "component_id")


def op8_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_crf.fit(language_crf.training_rows(docs, ~language_crf.held_out()))
    return language_crf.predict(docs, model).select(
        F.col("id").alias("doc_id"), language_crf.held_out("id").alias("held_out"), "lang_pred", "score")


def op9_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_join.neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _hex_digest(column: str) -> Column:
    return F.sha2(F.col(column), 256)


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe_chunks.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe_chunks.decode(ids, path).select(
        F.col("id").alias("doc_id"), F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        _hex_digest("ids").alias("ids_sha256"), _hex_digest("decoded").alias("decoded_sha256"),
    )


def op11_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                        F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"), group=20, most=3)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


LLM_QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_chat_format": op2_chat_format,
    "op3_token_records": op3_token_records,
    "op4_license_rules": op4_license_rules,
    "op5_pii_bootstrap": op5_pii_bootstrap,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_language_crf": op8_language_crf,
    "op9_block_join": op9_block_join,
    "op10_bpe_chunks": op10_bpe_chunks,
    "op11_line_runs": op11_line_runs,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_source_audit": op13_source_audit,
    "pipeline": corpus_pipeline.run,
}
LLM_SQL: dict[str, str] = {
    "op4_license_rules": sql.licence_sql(license_rules.SENTENCES, license_rules.RULES, license_rules.CLASSES),
    "op6_quality_rules": sql.OP6,
    "op11_line_runs": sql.OP11,
    "op12_prefix_trie": sql.OP12,
    "op13_source_audit": sql.OP13,
}
if corpus_pipeline.ORACLE_SQL:
    LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
