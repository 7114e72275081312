"""Request checks over tables: every row keeps its verdict and reason (V1-V4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.functions import urls
from debtscope.functions.text import trim_all


def _with_verdict(df: DataFrame, reason) -> DataFrame:
    return df.withColumn("reject_reason", reason).withColumn(
        "is_valid", F.col("reject_reason").isNull()
    )


def validate_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """V1."""
    return _with_verdict(df, urls.url_reject_reason(F.col(url)))


def parse_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """V2: accepted rows with ``owner``, ``repository`` and ``canonical_url``."""
    owner, repository, canonical = urls.url_parts(F.col(url))
    return df.filter(urls.url_reject_reason(F.col(url)).isNull()).withColumns(
        {"owner": owner, "repository": repository, "canonical_url": canonical}
    )


def validate_ids(df: DataFrame, analysis_id: str = "analysis_id") -> DataFrame:
    """V3."""
    return _with_verdict(df, urls.id_reject_reason(F.col(analysis_id)))


def validate_questions(df: DataFrame, question: str = "question") -> DataFrame:
    """V4: also returns the trimmed text."""
    trimmed = df.withColumn("trimmed", trim_all(F.col(question)))
    return _with_verdict(trimmed, urls.question_reject_reason(F.col(question)))
