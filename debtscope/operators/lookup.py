"""Requests against stored reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions import urls
from debtscope.functions.text import fill, trim_all
from debtscope.operators.overlay import latest_overlays, overlaid, overlay_inputs
from debtscope.operators.profile import source_files
from debtscope.operators.rows import rows_of
from debtscope.operators.topk import top_k


def live_reports(reports: DataFrame, as_of: datetime, ttl: str = C.REPORT_TTL) -> DataFrame:
    """Reports not older than ``ttl``; one aged exactly ``ttl`` still counts.

    A table partitioned by ``created_date`` is read from the first day that can count.
    """
    oldest = F.lit(as_of) - F.expr(f"INTERVAL {ttl}")
    if "created_date" in reports.columns:
        first_day = F.to_date(F.to_utc_timestamp(oldest, F.current_timezone()))
        reports = reports.filter(F.col("created_date") >= first_day)
    return reports.filter(F.col("created_at") >= oldest)


def lookup_reports(requests: DataFrame, reports: DataFrame, as_of: datetime, wanted: Column | None = None) -> DataFrame:
    """Each request with its live report; ``lookup`` says found or not found.

    Requests that cannot match, without an id or refused by ``wanted``, do not enter the
    join and come back by union, so they never meet in one partition.  A report that a
    third of all requests ask for is left to the join's own splitting of skewed partitions.
    Pass only the report columns the request needs.
    """
    asks = F.col("analysis_id").isNotNull()
    if wanted is not None:
        asks = asks & F.coalesce(wanted, F.lit(False))
    live = live_reports(reports, as_of).withColumn("_found", F.lit(True))
    joined = requests.filter(asks).join(live, "analysis_id", "left")
    apart = requests.filter(~asks)
    both = joined.unionByName(apart, allowMissingColumns=True)
    status = F.when(F.col("_found"), F.lit("found")).otherwise(F.lit(M.NOT_FOUND))
    return both.withColumn("lookup", status).drop("_found", "created_date")


def answer_basis(reports: DataFrame) -> DataFrame:
    """The few report columns an answer is made of (refined values)."""
    day = ["created_date"] if "created_date" in reports.columns else []
    return reports.select(
        *day,
        "analysis_id",
        "created_at",
        "is_demo",
        F.col("refactor.data.target").alias("target"),
        F.col("debt.data.summary").alias("debt_summary"),
        F.get(F.col("refactor.data.steps"), 0).alias("first_step"),
        source_files(F.col("debt.data.hotspots")).alias("evidence"),
    )


def grounded_answers(
    questions: DataFrame,
    reports: DataFrame,
    as_of: datetime,
    overlays: DataFrame | None = None,
) -> DataFrame:
    """Checked questions (V3, V4) answered from live reports (J6), refined by overlays.

    ``overlays`` has ``(question_id, payload)`` and may have ``at``; the latest one of a question
    counts, so several do not double it.  Refused and unmatched questions stay
    in the result with a ``status`` and without an answer.
    """
    reason = F.coalesce(
        urls.id_reject_reason(F.col("analysis_id")),
        urls.question_reject_reason(F.col("question")),
    )
    checked = questions.select(
        "question_id",
        "analysis_id",
        trim_all(F.col("question")).alias("question"),
        reason.alias("reject_reason"),
    )
    found = lookup_reports(checked, answer_basis(reports), as_of, F.col("reject_reason").isNull())
    status = (
        F.when(F.col("reject_reason").isNotNull(), F.lit("rejected"))
        .when(F.col("lookup") == "found", F.lit("answered"))
        .otherwise(F.lit(M.NOT_FOUND))
    )
    found = found.withColumn("status", status)
    if overlays is None:
        found = found.withColumn("answer_payload", F.lit(None).cast("string"))
    else:
        payloads = latest_overlays(overlays, "question_id", F.lit(as_of)).withColumnRenamed("payload", "answer_payload")
        found = found.join(payloads, "question_id", "left")
    text = fill(
        M.ANSWER,
        target=F.coalesce("target", F.lit("")),
        summary=F.coalesce("debt_summary", F.lit("")),
        step=F.coalesce("first_step", F.lit("")),
    )
    confidence = F.when(F.col("is_demo"), C.CONFIDENCE_DEMO).otherwise(C.CONFIDENCE_LIVE)
    base = {"answer": text, "confidence": confidence, "source_files": F.col("evidence")}
    merged = found.withColumns(overlay_inputs(["answer"])).withColumn(
        "answer", overlaid("answer", base)
    )
    answered = F.col("status") == "answered"

    def given(name: str) -> Column:
        return F.when(answered, F.col(f"answer.data.{name}")).alias(name)

    return merged.select(
        "question_id",
        "analysis_id",
        "question",
        "status",
        "reject_reason",
        given("answer"),
        given("confidence"),
        given("source_files"),
    )


def answer_view(answers: DataFrame) -> DataFrame:
    """P7."""
    return answers.select(
        "question_id",
        "answer",
        F.round(F.col("confidence") * 100).cast("int").alias("confidence_pct"),
        F.array_join("source_files", ", ").alias("sources"),
    )


def stage_timeline(analyses: DataFrame, events: DataFrame) -> DataFrame:
    """For every analysis the five stages, each with its first ``complete`` event.

    The stages are conditional aggregates over one pass of the event log, spread to
    rows afterwards; no stage table is joined.
    """
    firsts = events.groupBy("analysis_id").agg(
        *[
            F.min_by(
                "rationale",
                F.when((F.col("agent") == stage) & (F.col("status") == "complete"), F.col("seq")),
            ).alias(key)
            for stage, key in zip(C.STAGES, C.STAGE_KEYS)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(number).alias("stage_no"),
                F.lit(stage).alias("agent"),
                F.col(key).isNotNull().alias("done"),
                F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(M.STAGE_WAITING)).alias("label"),
            )
            for number, (stage, key) in enumerate(zip(C.STAGES, C.STAGE_KEYS), start=1)
        ]
    )
    joined = analyses.select("analysis_id").join(firsts, "analysis_id", "left")
    return rows_of(joined, ["analysis_id"], rows, "stage").select("analysis_id", "stage.*")


def recent_repos(uses: DataFrame, k: int = C.TOP_RECENT) -> DataFrame:
    """Last distinct URLs each user analysed successfully, newest first.

    A list that moves a re-used URL to the front equals "distinct URLs by last use".
    Grouped by (user, URL) before ranking, so neither a busy user nor a popular URL
    is one task's work.
    """
    last = uses.filter("ok").groupBy("user_id", "url").agg(F.max("ts").alias("last_use"))
    return top_k(last, ["user_id"], [F.col("last_use").desc(), F.col("url")], k)
