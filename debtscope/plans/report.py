"""The repository report (B10) and the stages it consists of."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions import rules
from debtscope.functions.text import uuid_of
from debtscope.operators import profile as P
from debtscope.operators.overlay import overlaid, overlay_inputs, pivot_overlays
from debtscope.operators.snapshots import ERROR, resolve_snapshots, snapshot_files


REPORT_COLUMNS = [
    "repo_id",
    "owner",
    "repository",
    "url",
    "description",
    "stars",
    "default_branch",
    "fallback_reason",
    "truncated",
]


def stage_events(run_at: Column) -> Column:
    """Running and complete event of each stage, as an array in order."""
    rows = []
    for number, stage in enumerate(C.STAGES):
        texts = [("running", M.STAGE_STARTED.format(stage=stage)), ("complete", M.STAGE_ENDED.format(stage=stage))]
        for offset, (status, text) in enumerate(texts):
            rows.append(
                F.struct(
                    F.lit(2 * number + offset).alias("seq"),
                    F.lit(stage).alias("agent"),
                    F.lit(status).alias("status"),
                    F.lit(text).alias("rationale"),
                    run_at.alias("at"),
                )
            )
    return F.array(*rows)


def analyse(snapshots: DataFrame, overlays: DataFrame | None, run_at: Column) -> DataFrame:
    """All five stages on resolved snapshots, one nested row per repository.

    Cost follows the refined score, the refactoring target the unrefined hotspots.
    After the overlays are joined nothing leaves its row.
    """
    rows = snapshots.filter(F.col("route") != ERROR) if "route" in snapshots.columns else snapshots
    if overlays is None:
        rows = rows.withColumns(
            {f"{stage}_payload": F.lit(None).cast("string") for stage in C.STAGE_KEYS}
        )
    else:
        rows = rows.join(pivot_overlays(overlays, "repo_id", as_of=run_at), "repo_id", "left")

    files, hot, reason = F.col("profile"), F.col("hot"), F.col("fallback_reason")
    target, cost = F.col("base_target"), F.col("base_cost")
    rows = rows.withColumns({"hot": files["hot"], **overlay_inputs(C.STAGE_KEYS)})
    rows = rows.withColumns(
        {"base_total": P.debt_total(hot), "base_target": P.refactor_target(hot, files)}
    )
    rows = rows.withColumns(
        {
            "architecture": overlaid(
                "architecture",
                {
                    "framework": P.framework(files),
                    "layers": F.array(*[F.lit(layer) for layer in C.LAYERS]),
                    "structure": P.structure(files),
                    "violations": P.violations(files),
                    "summary": rules.architecture_summary(files, reason),
                },
            ),
            "debt": overlaid(
                "debt",
                {
                    "hotspots": hot,
                    "total_debt_score": F.col("base_total").cast("double"),
                    "summary": rules.debt_summary(hot, reason),
                },
            ),
            "plan": overlaid(
                "refactor",
                {
                    "target": target,
                    "steps": rules.plan_steps(target),
                    "scaffolds": rules.scaffolds(target),
                    "pull_request_title": rules.pull_request_title(target),
                },
            ),
            "review": overlaid(
                "review",
                {
                    "verdict": F.lit(C.VERDICT),
                    "checks": rules.review_checks(P.sampled_count(files), hot, F.col("base_total"), rules.scaffolds(target)),
                    "caveat": rules.review_caveat(F.col("truncated")),
                },
            ),
        }
    )
    score = rules.cost_basis(F.col("debt.data.total_debt_score"), F.col("base_total"))
    rows = rows.withColumns({"base_cost": rules.annual_cost(score), "refactor": with_scaffolds()})
    return rows.select(
        *REPORT_COLUMNS,
        "architecture",
        "debt",
        overlaid(
            "cost",
            {
                "annual_cost": cost,
                "priority": rules.cost_priority(cost),
                "roi_months": rules.payback_months(cost),
                "assumption": F.lit(M.ASSUMPTION),
            },
        ).alias("cost"),
        "refactor",
        "review",
        (~is_live()).alias("is_demo"),
        run_mode().alias("mode"),
        stage_events(run_at).alias("events"),
    )


def with_scaffolds() -> Column:
    """The refined plan; B5 when the refinement left it without files."""
    data = F.col("plan.data")
    ensured = rules.ensured_scaffolds(data.scaffolds, data.target)
    return F.struct(
        F.struct(
            data.target.alias("target"),
            data.steps.alias("steps"),
            ensured.alias("scaffolds"),
            data.pull_request_title.alias("pull_request_title"),
        ).alias("data"),
        F.col("plan.source").alias("source"),
    )


def is_live() -> Column:
    """Some stage was refined."""
    refined = [F.col(f"{stage}_source") == C.SOURCE_OVERLAY for stage in C.STAGE_KEYS]
    live = refined[0]
    for other in refined[1:]:
        live = live | other
    return live


def run_mode() -> Column:
    """A9."""
    return F.when(is_live(), F.lit(C.MODE_LIVE)).otherwise(F.lit(C.MODE_DEMO))


def repo_report(
    repos: DataFrame,
    listing: DataFrame,
    bodies: DataFrame,
    archives: DataFrame,
    attempts: DataFrame,
    overlays: DataFrame | None,
    run_at: datetime,
    metrics: str | None = None,
    **limits: int | None,
) -> DataFrame:
    """From landed tables to one report per readable repository.

    ``metrics`` is a folder for the measured files; ``limits`` (max_files, max_bytes,
    max_chars) hold only where given.
    """
    files = snapshot_files(repos, listing, bodies, archives, metrics=metrics, **limits)
    resolved = resolve_snapshots(repos, listing, files, attempts, limits.get("max_files"))
    return analyse(resolved, overlays, F.lit(run_at))


def as_records(reports: DataFrame, created_at: Column, run_id: str) -> DataFrame:
    """Add ``analysis_id`` and ``created_at``.

    The id is derived from run and repository, not drawn at random: a task that is
    repeated after a lost executor must not give the same report a second id.
    """
    return reports.withColumns(
        {
            "run_id": F.lit(run_id),
            "analysis_id": uuid_of(F.lit(run_id), F.col("repo_id").cast("string")),
            "created_at": created_at,
        }
    )
