"""From listing entries and bodies to measured files.

``content`` is the only wide column.  :func:`measure` turns it into three counts in
the task that read it, and no operator here ships it through a shuffle.  All files and
all of their text count; a limit holds only where one is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.functions import files as X
from debtscope.operators.topk import top_k


def code_files(df: DataFrame, path: str = "path") -> DataFrame:
    """P1."""
    return df.filter(X.is_code_file(F.col(path)))


def eligible_files(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Plain comparisons, so both reach the Parquet scan."""
    blobs = df.filter(F.col("type") == "blob")
    return blobs if max_bytes is None else blobs.filter(F.col("size") <= max_bytes)


def truncate_content(df: DataFrame, max_chars: int) -> DataFrame:
    """P3."""
    return df.withColumn("content", X.truncate(F.col("content"), max_chars))


def nonempty_files(df: DataFrame) -> DataFrame:
    """P4, on bodies or on measured rows."""
    if "content" in df.columns:
        return df.filter(F.col("content") != "")
    return df.filter(F.col("has_content"))


def strip_archive_root(df: DataFrame, name: str = "name") -> DataFrame:
    """P5: ``path`` without the archive's root folder; top-level names are dropped."""
    return df.filter(X.has_root(F.col(name))).withColumn("path", X.strip_root(F.col(name)))


def sample_cap(df: DataFrame, k: int) -> DataFrame:
    """First ``k`` rows of each repository in listing order."""
    return top_k(df, ["repo_id"], [F.col("pos")], k)


def measure(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Replace ``content`` by ``lines``, ``markers``, ``functions``, ``has_content``, ``chars``.

    Whether a body is empty does not depend on its truncation, so that test is on the
    column as read and a filter on it can reach the scan.
    """
    body = F.col("content")
    filled = F.coalesce(F.octet_length(body) > 0, F.lit(False))
    df = df.withColumn("has_content", filled)
    if max_chars is not None:
        df = truncate_content(df, max_chars)
    return df.withColumns(
        {
            "chars": F.length(body),
            "lines": X.line_count(body),
            "markers": X.marker_count(body),
            "functions": X.function_count(body),
        }
    ).drop("content")


def listing_sample(listing: DataFrame, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """P1, P2, T1 on listing entries: which files count, before any body is touched."""
    wanted = code_files(eligible_files(listing, max_bytes))
    return wanted if max_files is None else sample_cap(wanted, max_files)


def listing_sizes(listing: DataFrame) -> DataFrame:
    """Entries of any kind per repository; counted in the map tasks first."""
    return listing.groupBy("repo_id").agg(F.count(F.lit(1)).alias("entries"))


def join_bodies(sample: DataFrame, bodies: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Listing entries with their bodies' measures; failed or empty bodies drop out.

    The join is on (repository, path), so a repository that holds a third of all
    bodies is still spread over all partitions.
    """
    measured = nonempty_files(measure(code_files(bodies), max_chars))
    columns = ["repo_id", "path", "lines", "markers", "functions"]
    return sample.join(measured.select(*columns), ["repo_id", "path"], "inner")


def sample_files(
    repo_files: DataFrame,
    max_files: int | None = None,
    max_bytes: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """Same result as J1 when entry and body are in one table: one scan, no join."""
    measured = measure(code_files(eligible_files(repo_files, max_bytes)), max_chars)
    return nonempty_files(measured if max_files is None else sample_cap(measured, max_files))
