"""Scaffold files and a README packed per analysis."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope import messages as M
from debtscope.functions import urls
from debtscope.functions.text import bundle_name, fill
from debtscope.operators.lookup import lookup_reports
from debtscope.operators.overlay import SCAFFOLDS
from debtscope.operators.rows import rows_of
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

ZIP_SCHEMA = "analysis_id string, file_name string, n_files int, zip binary"


def last_writer_wins(files: Column) -> Column:
    """Drop every file whose path is written again later in the array."""

    def final(file: Column, index: Column) -> Column:
        later = F.slice(files, index + 2, F.size(files))
        return ~F.exists(later, lambda other: other.path == file.path)

    return F.filter(files, final)


def written_files(scaffolds: Column, url: Column, mode: Column) -> Column:
    """Scaffold files in order, then the README."""
    named = F.transform(
        F.coalesce(scaffolds, F.expr(f"CAST(array() AS {SCAFFOLDS})")),
        lambda f: F.struct(
            F.coalesce(f.path, F.lit("")).alias("path"),
            F.coalesce(f.content, F.lit("")).alias("content"),
        ),
    )
    readme = F.struct(
        F.lit("README.md").alias("path"),
        fill(M.README, url=url, mode=mode).alias("content"),
    )
    return F.concat(named, F.array(readme))


def with_bundle(reports: DataFrame) -> DataFrame:
    """U2 as an array column ``bundle``."""
    files = written_files(F.col("refactor.data.scaffolds"), F.col("url"), F.col("mode"))
    written = reports.withColumn("_written", files)
    return written.withColumn("bundle", last_writer_wins(F.col("_written"))).drop("_written")


def bundle_rows(reports: DataFrame) -> DataFrame:
    """Files of every bundle as rows."""
    rows = rows_of(with_bundle(reports), ["analysis_id"], F.col("bundle"), "file")
    return rows.select("analysis_id", "file.path", "file.content")


def bundle_requests(requests: DataFrame, reports: DataFrame, as_of: datetime, request_id: str) -> DataFrame:
    """Download requests: V3, J6, then U2; requests without a bundle keep a row with their status."""
    reason = urls.id_reject_reason(F.col("analysis_id"))
    checked = requests.select(request_id, "analysis_id", reason.alias("_reason"))
    day = ["created_date"] if "created_date" in reports.columns else []
    packed = with_bundle(reports).select(*day, "analysis_id", "created_at", "bundle")
    found = lookup_reports(checked, packed, as_of, F.col("_reason").isNull())
    status = (
        F.when(F.col("_reason").isNotNull(), F.lit("rejected"))
        .when(F.col("lookup") == "found", F.lit("ready"))
        .otherwise(F.col("lookup"))
    )
    rows = found.select(request_id, "analysis_id", status.alias("status"), F.explode_outer("bundle").alias("file"))
    return rows.select(request_id, "analysis_id", "status", "file.path", "file.content")


def _zip(files) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in files:
            entry = zipfile.ZipInfo(file["path"])
            entry.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(entry, file["content"])
    return buffer.getvalue()


def _zip_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(
            {
                "analysis_id": batch["analysis_id"],
                "file_name": batch["file_name"],
                "n_files": [len(files) for files in batch["bundle"]],
                "zip": [_zip(files) for files in batch["bundle"]],
            }
        )


def zip_bundles(reports: DataFrame, as_of: datetime) -> DataFrame:
    """One ZIP per analysis.

    A bundle is an array inside its report row, so packing it is row-local: no
    grouping, no shuffle, and a task never holds more than one Arrow batch.
    """
    named = with_bundle(reports).select(
        "analysis_id", bundle_name(F.lit(as_of)).alias("file_name"), "bundle"
    )
    return named.mapInPandas(_zip_batches, ZIP_SCHEMA)


def write_bundles(reports: DataFrame, path: str, as_of: datetime) -> None:
    """S6 as a table of ``(analysis_id, file_name, n_files, zip)``."""
    zip_bundles(reports, as_of).write.mode("append").parquet(path)
