"""Landed JSON documents: listings and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREE = "struct<tree:array<struct<type:string,path:string,size:bigint>>>"
METADATA = "struct<description:string,stargazers_count:bigint,default_branch:string>"


def listing_scan(documents: DataFrame, payload: str = "payload", first_pos: str = "first_pos") -> DataFrame:
    """``(repo_id, pos, type, path, size)`` from listing documents.

    A large listing arrives in several documents; ``first_pos`` is the position of a
    document's first entry.  A document without ``tree`` contributes no entry; the
    repository is kept by ``repos``, which drives every report.  Documents that overlap repeat
    entries: :func:`distinct_entries`; those that leave something out: :func:`page_coverage`.
    """
    tree = F.from_json(F.col(payload), TREE).tree
    return documents.select("repo_id", first_pos, F.posexplode(tree).alias("i", "entry")).select(
        "repo_id",
        (F.col(first_pos) + F.col("i")).cast("bigint").alias("pos"),
        "entry.type",
        "entry.path",
        "entry.size",
    )


def distinct_entries(entries: DataFrame) -> DataFrame:
    """Entries of overlapping or repeated documents once; where they disagree the least one stays.

    Grouped by repository and position, so a large repository spreads over all tasks.
    """
    least = F.min(F.struct("path", "type", "size")).alias("e")
    return entries.groupBy("repo_id", "pos").agg(least).select("repo_id", "pos", "e.type", "e.path", "e.size")


def page_coverage(documents: DataFrame, payload: str = "payload", first_pos: str = "first_pos") -> DataFrame:
    """Per repository, what its listing documents cover: gaps and islands over ``first_pos``.

    ``(repo_id, pages, entries, overlapping, gaps, missing, complete)``: a page begins a new
    island where it starts beyond everything before it; ``missing`` counts the positions
    between islands and ``overlapping`` those that came again.  Only places and lengths of
    the pages are ordered, not their entries.
    """
    n = F.coalesce(F.size(F.from_json(F.col(payload), TREE).tree), F.lit(0)).cast("bigint")
    pages = documents.select("repo_id", F.col(first_pos).alias("start"), n.alias("n")).filter("n > 0")
    order = Window.partitionBy("repo_id").orderBy("start", "n")
    reach = F.coalesce(F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pages.withColumn("reach", reach)
    ahead = F.greatest(F.col("start") - F.col("reach"), F.lit(0))
    again = F.least(F.greatest(F.col("reach") - F.col("start"), F.lit(0)), F.col("n"))
    return placed.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.col("n") - again).alias("entries"),
        F.sum(again).alias("overlapping"),
        F.count(F.when(ahead > 0, 1)).alias("gaps"),
        F.sum(ahead).alias("missing"),
        (F.sum(ahead) == 0).alias("complete"),
    )


def metadata_scan(documents: DataFrame, payload: str = "metadata") -> DataFrame:
    """Repository rows with defaults; the default branch has none."""
    parsed = F.from_json(F.col(payload), METADATA)
    return (
        documents.withColumn("_parsed", parsed)
        .withColumns(
            {
                "description": F.coalesce("_parsed.description", F.lit("")),
                "stars": F.coalesce("_parsed.stargazers_count", F.lit(0).cast("bigint")),
                "default_branch": F.col("_parsed.default_branch"),
            }
        )
        .drop("_parsed", payload)
    )
