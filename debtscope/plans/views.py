"""Flat display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions.text import fill, short_url


def dashboard_view(reports: DataFrame) -> DataFrame:
    """What the result page shows of each report."""
    structure = F.col("architecture.data.structure")
    score = F.col("debt.data.total_debt_score")

    def line(hotspot):
        labels = F.coalesce(hotspot.signals, F.array().cast("array<string>"))
        shown = F.when(F.size(labels) > 0, F.array_join(labels, " / ")).otherwise(M.EMPTY_SIGNALS)
        return fill(
            "{path} {lines} lines {score} ({why})",
            path=F.coalesce(hotspot.path, F.lit("")),
            lines=F.coalesce(hotspot.lines, F.lit(0)),
            score=F.coalesce(hotspot.score, F.lit(0.0)).cast("int"),
            why=shown,
        )

    hotspots = F.array_join(F.transform("debt.data.hotspots", line), "; ")
    roots = F.array_join(structure.root_directories, " / ")
    return reports.select(
        "repo_id",
        short_url(F.col("url")).alias("repository_label"),
        score.alias("debt_score"),
        F.least(F.lit(float(C.MAX_SCORE)), F.coalesce(score, F.lit(0.0))).alias("bar_width"),
        F.concat(F.lit("$"), F.expr("format_number(cost.data.annual_cost, '#,##0.###')")).alias("annual_cost"),
        F.col("cost.data.roi_months").alias("roi_months"),
        F.col("cost.data.priority").alias("priority"),
        F.col("review.data.verdict").alias("verdict"),
        F.col("architecture.data.framework").alias("framework"),
        structure.sampled_file_count.alias("files_sampled"),
        F.coalesce(F.nullif(roots, F.lit("")), F.lit(M.EMPTY_ROOTS)).alias("roots"),
        F.array_join(
            F.transform(structure.languages, lambda p: F.concat_ws(" ", p.language, p.n.cast("string"))),
            ", ",
        ).alias("languages"),
        F.coalesce(F.nullif(hotspots, F.lit("")), F.lit(M.NO_HOTSPOTS)).alias("hotspots"),
        F.array_join("architecture.data.layers", " / ").alias("layers"),
        F.array_join("architecture.data.violations", "; ").alias("violations"),
        F.col("architecture.data.summary").alias("architecture_summary"),
        F.col("debt.data.summary").alias("debt_summary"),
        F.col("cost.data.assumption").alias("assumption"),
        F.col("refactor.data.pull_request_title").alias("pull_request_title"),
        F.array_join("refactor.data.steps", "; ").alias("steps"),
        F.array_join("review.data.checks", "; ").alias("checks"),
        F.col("review.data.caveat").alias("caveat"),
        F.col("is_demo"),
    )
