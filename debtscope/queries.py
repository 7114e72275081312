"""The registered queries: each runs one operator over whole tables.

Arrays and structs are flattened to text so that a SQL engine can give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import fixtures as X
from debtscope.functions import errors, rules
from debtscope.functions import files as FX
from debtscope.functions.text import bundle_name, redact_tokens, short_url, utc_text
from debtscope.operators import bundles, lookup, sampling, snapshots, validate
from debtscope.operators import overlay as overlay_ops
from debtscope.operators import profile as P
from debtscope.operators.rows import rows_of
from debtscope.plans import report as R
from debtscope.plans.views import dashboard_view
from debtscope.session import qualified, shared_folder
from debtscope.sources import archives as archive_source
from debtscope.sources import landed
from debtscope.sources import reports as report_table
from debtscope.streaming import live_reports as stream_job
from debtscope.streaming import recent_list
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


def _join(array: str | Column, sep: str = "|") -> Column:
    return F.array_join(array, sep)


# --- shared inputs ----------------------------------------------------------
def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    """Every repository with the profile of its files."""
    files = sampling.sample_files(X.repo_files(spark, sf))
    return P.with_profile(X.repo_ids(spark, sf), P.profile(files, ["repo_id"]))


def _landed(spark: SparkSession, sf: str) -> DataFrame:
    """Landed repositories, which are written once: their ids come out of all documents, and what
    is asked of a repository would be asked of each document below the distinct."""
    rows, folder = X.landed_repos(spark, sf), shared_folder(spark, "repos")
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def _parsed(rows: DataFrame) -> DataFrame:
    """Landed repositories with parsed coordinates and metadata."""
    parsed = validate.parse_urls(rows)
    return landed.metadata_scan(parsed.drop("url").withColumnRenamed("canonical_url", "url"))


def _repos(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(_landed(spark, sf))


def _snapshots(spark: SparkSession, sf: str, rows: DataFrame | None = None, **limits: int) -> tuple[DataFrame, DataFrame]:
    """Resolved repositories, and the measured files of all routes, which are written once."""
    repos, listing = _repos(spark, sf) if rows is None else _parsed(rows), X.listing(spark, sf)
    files = snapshots.snapshot_files(
        repos, listing, X.bodies(spark, sf), X.archives(spark, sf), metrics=shared_folder(spark, "metrics"), **limits
    )
    resolved = snapshots.resolve_snapshots(repos, listing, files, X.attempts(repos), limits.get("max_files"))
    return resolved, files


def _resolved(spark: SparkSession, sf: str, **limits: int) -> DataFrame:
    return _snapshots(spark, sf, **limits)[0]


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    rows = _landed(spark, sf)
    resolved, _ = _snapshots(spark, sf, rows)
    report = R.analyse(resolved, X.overlays(rows.select("repo_id")), F.lit(X.AS_OF))
    return R.as_records(report, X.created_at(X.REPORT_AGE_MINUTES), X.RUN_ID)


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The report table, as those who serve requests read it."""
    folder = shared_folder(spark, "reports")
    report_table.write_reports(_reports(spark, sf), folder)
    return report_table.read_reports(spark, folder)


# --- sources and sinks ------------------------------------------------------
@query("listing_scan")
def _listing_scan(spark: SparkSession, sf: str) -> DataFrame:
    return landed.listing_scan(X.listing_documents(spark, sf))


@query("listing_coverage")
def _listing_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What the listing documents of each repository cover, some of them landed twice or shifted."""
    documents = X.listing_documents(spark, sf)
    again = documents.filter("first_pos % 3 = 0").withColumn("first_pos", F.expr("first_pos + first_pos % 5"))
    return landed.page_coverage(documents.unionByName(again))


@query("metadata_scan")
def _metadata_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _repos(spark, sf).select(
        "repo_id", "owner", "repository", "url", "description", "stars", "default_branch"
    )


@query("archive_scan")
def _archive_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One archive per document: a folder entry, a top-level file, the file, a note."""
    files = X.repo_files(spark, sf)
    zipped = files.mapInPandas(_zip_documents, "repo_id bigint, branch string, zip binary")
    rows = archive_source.archive_scan(zipped)
    return rows.select(
        "repo_id", "branch", "pos", "path", "size", F.md5(F.encode("content", "utf-8")).alias("content_md5")
    )


def _zip_documents(batches):
    import io
    import zipfile

    import pandas as pd

    for batch in batches:
        blobs = []
        for row in batch.itertuples(index=False):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as archive:
                archive.writestr("root/", "")
                archive.writestr("top.ts", "outside of the root folder")
                archive.writestr(f"root/{row.path}", row.content)
                archive.writestr("root/NOTES.md", "not code")
                archive.writestr("root/lib/extra.go", f"extra {row.pos}")
            blobs.append(buffer.getvalue())
        branch = [f"b{pos % 5}" for pos in batch["pos"]]
        yield pd.DataFrame({"repo_id": batch["repo_id"], "branch": branch, "zip": blobs})


@query("sample_snapshot")
def _sample_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    resolved, files = _snapshots(spark, sf)
    about = ["repo_id", "description", "stars", "default_branch", "truncated", "fallback_reason"]
    sample = resolved.filter(F.col("route") == snapshots.SAMPLE)
    rows = snapshots.snapshot_rows(sample, files).select("repo_id", "pos", "path", "size", "score")
    return sample.select(*about).join(rows, "repo_id").select(*about, "pos", "path", "size", "score")


@query("report_write")
def _report_write(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).select(
        "analysis_id",
        utc_text(F.col("created_at")).alias("created_at"),
        F.date_format("created_date", "yyyy-MM-dd").alias("created_date"),
        "url",
        "mode",
        F.col("debt.data.total_debt_score").alias("total_debt_score"),
    )


@query("bundle_write")
def _bundle_write(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "bundles")
    bundles.write_bundles(_reports(spark, sf), folder, X.AS_OF)
    return spark.read.parquet(folder).mapInPandas(
        _unzip_bundles, "analysis_id string, file_name string, n_files int, path string, content string"
    )


@query("archive_files")
def _archive_files(spark: SparkSession, sf: str) -> DataFrame:
    """ZIP files on disk, read by byte ranges, up to the preferred branch of each repository."""
    folder = shared_folder(spark, "archives")
    entries = X.archives(spark, sf).withColumn("part", F.expr(f"CAST(floor(pos / {X.PAGE_ENTRIES}) AS BIGINT)"))
    zipped = entries.groupBy("repo_id", "branch", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "content"))).alias("entries"))
    # a folder holds the files of a range of places, so there are few folders to list
    file = F.concat(F.concat_ws("-", "repo_id", "branch", F.col("part") * X.PAGE_ENTRIES), F.lit(".zip"))
    named = zipped.select(F.concat_ws("/", F.expr(f"part div {X.PAGE_ENTRIES}"), file).alias("name"), "entries")
    named.mapInPandas(_zip_files(qualified(spark, folder)), "name string").write.format("noop").mode("overwrite").save()
    rows = archive_source.read_archive_entries(spark, folder, r"/([0-9]+)-([a-z]+)-([0-9]+)[.]zip$", range_bytes=1 << 16)
    measured = archive_source.measured_entries(rows, shared_folder(spark, "entries"))
    kept = snapshots.prefer_branch(snapshots.archive_files(archive_source.readable_archives(measured)))
    return kept.select("repo_id", "branch", "pos", "path", "size", "lines")


def _zip_files(folder: str):
    def write(batches):
        import io
        import re
        import zipfile

        from pyarrow import fs

        for batch in batches:
            for row in batch.itertuples(index=False):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    for entry in row.entries:
                        archive.writestr(entry["name"], entry["content"])
                store, path = fs.FileSystem.from_uri(re.sub("^file:/(?=[^/])", "file:///", f"{folder}/{row.name}"))
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(buffer.getvalue())
            yield batch[["name"]]

    return write


def _unzip_bundles(batches):
    import io
    import zipfile

    import pandas as pd

    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            with zipfile.ZipFile(io.BytesIO(bytes(row.zip))) as archive:
                for name in archive.namelist():
                    text = archive.read(name).decode("utf-8")
                    rows.append((row.analysis_id, row.file_name, row.n_files, name, text))
        yield pd.DataFrame(rows, columns=["analysis_id", "file_name", "n_files", "path", "content"])


# --- validation, projections, filters ---------------------------------------
@query("url_validate")
def _url_validate(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_urls(X.repo_urls(spark, sf))


@query("url_parse")
def _url_parse(spark: SparkSession, sf: str) -> DataFrame:
    return validate.parse_urls(X.repo_urls(spark, sf)).drop("url")


@query("id_validate")
def _id_validate(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_ids(X.questions(spark, sf)).drop("question")


@query("question_validate")
def _question_validate(spark: SparkSession, sf: str) -> DataFrame:
    return validate.validate_questions(X.questions(spark, sf)).select(
        "question_id", "trimmed", "is_valid", "reject_reason"
    )


@query("code_files")
def _code_files(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.code_files(X.listing(spark, sf)).select("repo_id", "pos", "path")


@query("eligible_files")
def _eligible_files(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.eligible_files(X.listing(spark, sf), C.MAX_FILE_BYTES).select("repo_id", "pos", "path", "size")


@query("content_truncate")
def _content_truncate(spark: SparkSession, sf: str) -> DataFrame:
    cut = sampling.truncate_content(X.repo_files(spark, sf), C.MAX_FILE_BYTES)
    return cut.select(
        "repo_id",
        "pos",
        F.length("content").alias("kept_chars"),
        F.md5(F.encode("content", "utf-8")).alias("content_md5"),
    )


@query("nonempty_files")
def _nonempty_files(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.nonempty_files(X.repo_files(spark, sf)).select("repo_id", "pos", "path")


@query("strip_archive_root")
def _strip_archive_root(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.strip_archive_root(X.archives(spark, sf)).select("repo_id", "branch", "pos", "path")


@query("dashboard_view")
def _dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard_view(_stored(spark, sf))


@query("answer_view")
def _answer_view(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.answer_view(_answers(spark, sf))


# --- joins -----------------------------------------------------------------
@query("listing_join_content")
def _listing_join_content(spark: SparkSession, sf: str) -> DataFrame:
    sample = sampling.listing_sample(X.listing(spark, sf))
    return sampling.join_bodies(sample, X.bodies(spark, sf)).select(
        "repo_id", "pos", "path", "size", "lines", "markers", "functions"
    )


@query("snapshot_resolve")
def _snapshot_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf).select(
        "repo_id",
        "url",
        "status",
        "route",
        "description",
        "stars",
        "default_branch",
        "fallback_reason",
        "truncated",
        F.col("profile.n").alias("n_files"),
        F.when(F.col("route") == snapshots.ERROR, errors.user_message(F.col("status"), F.col("message"))).alias("user_message"),
    )


@query("branch_prefer")
def _branch_prefer(spark: SparkSession, sf: str) -> DataFrame:
    kept = snapshots.prefer_branch(snapshots.archive_files(X.archives(spark, sf)))
    return kept.select("repo_id", "branch", "pos", "path", "size", "lines")


@query("missing_snapshots")
def _missing_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    repos = _repos(spark, sf)
    kept = snapshots.archive_files(snapshots.on_route(X.archives(spark, sf), repos, 403))
    return snapshots.missing_snapshots(repos, kept, X.attempts(repos))


@query("overlay_apply")
def _overlay_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Debt figures of every repository, refined."""
    payloads = overlay_ops.pivot_overlays(X.overlays(X.repo_ids(spark, sf)), "repo_id", ["debt"], F.lit(X.AS_OF))
    rows = _profiled(spark, sf).join(payloads, "repo_id", "left")
    base = {
        "hotspots": F.col("hot"),
        "total_debt_score": P.debt_total(F.col("hot")).cast("double"),
        "summary": rules.debt_summary(F.col("hot"), F.lit(None).cast("string")),
    }
    inputs = rows.withColumns(overlay_ops.overlay_inputs(["debt"]))
    merged = inputs.withColumn("debt", overlay_ops.overlaid("debt", base))
    return merged.select(
        "repo_id",
        "debt.source",
        "debt.data.total_debt_score",
        "debt.data.summary",
        _join(F.transform("debt.data.hotspots", lambda h: h.path)).alias("hotspot_paths"),
    )


@query("report_lookup")
def _report_lookup(spark: SparkSession, sf: str) -> DataFrame:
    requests = X.questions(spark, sf).select("question_id", "analysis_id")
    reports = _stored(spark, sf).select("created_date", "analysis_id", "created_at", "url", "mode")
    found = lookup.lookup_reports(requests, reports, X.AS_OF)
    return found.select("question_id", "analysis_id", "lookup", "url", "mode")


@query("report_lookup_keyed")
def _report_lookup_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """The same look-up on the serving copy that is bucketed by report id."""
    requests = X.questions(spark, sf).select("question_id", "analysis_id")
    columns = ["created_date", "analysis_id", "created_at", "url", "mode"]
    keyed = report_table.keyed_reports(_stored(spark, sf).select(*columns), shared_folder(spark, "keyed"))
    return lookup.lookup_reports(requests, keyed, X.AS_OF).select("question_id", "analysis_id", "lookup", "url", "mode")


def _event_log(reports: DataFrame) -> DataFrame:
    rows = rows_of(reports, ["analysis_id", "repo_id"], F.col("events"), "event")
    return rows.select("analysis_id", "repo_id", "event.*")


@query("stage_timeline")
def _stage_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """Some logs stop early."""
    reports = _reports(spark, sf)
    log = _event_log(reports).filter("NOT (repo_id % 7 = 3 AND seq > 4)")
    return lookup.stage_timeline(reports, log)


# --- per-file metrics --------------------------------------------------------
def _per_file(name: str, column: Callable[[], Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return X.repo_files(spark, sf).select("repo_id", "pos", column().alias(name))

    QUERIES[name] = run


_per_file("line_count", lambda: FX.line_count(F.col("content")))
_per_file("marker_count", lambda: FX.marker_count(F.col("content")))
_per_file("function_count", lambda: FX.function_count(F.col("content")))
_per_file("file_language", lambda: FX.file_language(F.col("path")))
_per_file("path_root", lambda: FX.path_root(F.col("path")))
_per_file("is_entry_point", lambda: FX.is_entry_point(F.col("path")))
_per_file("is_layer_violation", lambda: FX.is_layer_violation(F.col("path")))
_per_file("module_name", lambda: FX.module_name(F.col("path")))


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.measure(X.repo_files(spark, sf))


@query("debt_score")
def _debt_score(spark: SparkSession, sf: str) -> DataFrame:
    score = FX.debt_score(F.col("lines"), F.col("markers"), F.col("functions"))
    return _measured(spark, sf).select("repo_id", "pos", "path", score.alias("score"))


@query("signals")
def _signals(spark: SparkSession, sf: str) -> DataFrame:
    labels = FX.signals(F.col("lines"), F.col("markers"), F.col("functions"))
    return _measured(spark, sf).select("repo_id", "pos", _join(labels).alias("signals"))


# --- aggregations -----------------------------------------------------------
@query("sampled_count")
def _sampled_count(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(spark, sf).select("repo_id", P.sampled_count(F.col("profile")).alias("sampled_count"))


@query("language_histogram")
def _language_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ranked(_profiled(spark, sf), F.col("profile.languages"), "l")
    return rows.select("repo_id", "rank", "l.language", "l.n")


def _ranked(rows: DataFrame, array: Column, name: str) -> DataFrame:
    return rows_of(rows, ["repo_id"], array, name, "rank")


@query("root_directories")
def _root_directories(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_profiled(spark, sf), F.col("profile.roots"), "root")


@query("entry_points")
def _entry_points(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_profiled(spark, sf), F.col("profile.entries"), "path")


def _languages_text(languages: Column) -> Column:
    return _join(F.transform(languages, lambda p: F.concat_ws(" ", p.language, p.n.cast("string"))))


@query("structure_summary")
def _structure_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _profiled(spark, sf).select("repo_id", P.structure(F.col("profile")).alias("s"))
    return rows.select(
        "repo_id",
        "s.sampled_file_count",
        _join("s.root_directories").alias("root_directories"),
        _languages_text(F.col("s.languages")).alias("languages"),
        _join("s.entry_points").alias("entry_points"),
    )


@query("framework_classify")
def _framework_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(spark, sf).select("repo_id", P.framework(F.col("profile")).alias("framework"))


@query("truncated_flag")
def _truncated_flag(spark: SparkSession, sf: str) -> DataFrame:
    limits = {"max_files": C.MAX_FILES, "max_bytes": C.MAX_FILE_BYTES, "max_chars": C.MAX_FILE_BYTES}
    return _resolved(spark, sf, **limits).select("repo_id", "route", "truncated")


@query("debt_total")
def _debt_total(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(spark, sf).select("repo_id", P.debt_total(F.col("hot")).alias("debt_total"))


@query("run_mode")
def _run_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select("repo_id", "mode", "is_demo")


@query("violations")
def _violations(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_profiled(spark, sf), P.violations(F.col("profile")), "message")


# --- top-k --------------------------------------------------------------------
@query("sample_cap")
def _sample_cap(spark: SparkSession, sf: str) -> DataFrame:
    sample = sampling.listing_sample(X.listing(spark, sf), C.MAX_FILES, C.MAX_FILE_BYTES)
    return sample.select("repo_id", "pos", "path", "rank")


@query("hotspots")
def _hotspots(spark: SparkSession, sf: str) -> DataFrame:
    rows = _ranked(_profiled(spark, sf), F.col("hot"), "h")
    return rows.select(
        "repo_id",
        "rank",
        "h.path",
        "h.lines",
        "h.score",
        _join("h.signals").alias("signals"),
    )


@query("source_files")
def _source_files(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_profiled(spark, sf), P.source_files(F.col("hot")), "path")


@query("context_paths")
def _context_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(_profiled(spark, sf), F.col("profile.context"), "path")


@query("recent_repos")
def _recent_repos(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.recent_repos(X.repo_uses(spark, sf)).select("user_id", "url", "rank")


# --- business rules -----------------------------------------------------------
@query("repo_debt")
def _repo_debt(spark: SparkSession, sf: str) -> DataFrame:
    """Debt, cost and payback of every repository straight from its files."""
    rows = _profiled(spark, sf).select("repo_id", P.debt_total(F.col("hot")).alias("debt_total"))
    cost = rules.annual_cost(F.col("debt_total"))
    return rows.select(
        "repo_id",
        "debt_total",
        cost.cast("int").alias("annual_cost"),
        rules.cost_priority(cost).alias("priority"),
        rules.payback_months(cost).cast("int").alias("roi_months"),
    )


@query("cost_estimate")
def _cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Cost after refinement."""
    return _reports(spark, sf).select(
        "repo_id",
        F.col("debt.data.total_debt_score").alias("total_debt_score"),
        "cost.source",
        "cost.data.annual_cost",
        "cost.data.priority",
        "cost.data.roi_months",
        "cost.data.assumption",
    )


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return _profiled(spark, sf).select("repo_id", P.refactor_target(F.col("hot"), F.col("profile")).alias("target"))


@query("refactor_target")
def _refactor_target(spark: SparkSession, sf: str) -> DataFrame:
    return _targets(spark, sf)


@query("refactor_plan")
def _refactor_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows = _targets(spark, sf).select(
        "repo_id",
        rules.pull_request_title(F.col("target")).alias("pull_request_title"),
        rules.plan_steps(F.col("target")).alias("steps"),
    )
    return rows_of(rows, ["repo_id", "pull_request_title"], F.col("steps"), "step", "step_no")


@query("scaffold_rows")
def _scaffold_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = rows_of(_targets(spark, sf), ["repo_id"], rules.scaffolds(F.col("target")), "file")
    return rows.select("repo_id", "file.*")


@query("scaffold_fallback")
def _scaffold_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = rows_of(_targets(spark, sf), ["repo_id"], rules.fallback_scaffolds(F.col("target")), "file")
    return rows.select("repo_id", "file.*")


@query("review_checks")
def _review_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select(
        "repo_id",
        "review.source",
        "review.data.verdict",
        _join("review.data.checks").alias("checks"),
        "review.data.caveat",
    )


@query("summaries")
def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _reports(spark, sf).select(
        "repo_id",
        F.col("architecture.data.summary").alias("architecture_summary"),
        F.col("debt.data.summary").alias("debt_summary"),
    )


@query("stage_events")
def _stage_events(spark: SparkSession, sf: str) -> DataFrame:
    return _event_log(_reports(spark, sf)).select(
        "analysis_id", "seq", "agent", "status", "rationale", utc_text(F.col("at")).alias("at")
    )


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.grounded_answers(
        X.questions(spark, sf), _stored(spark, sf), X.AS_OF, X.answer_overlays(spark, sf)
    )


@query("grounded_answer")
def _grounded_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select(
        "question_id",
        "analysis_id",
        "status",
        "reject_reason",
        "answer",
        "confidence",
        _join("source_files").alias("source_files"),
    )


@query("repo_report")
def _repo_report(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: from landed tables to one refined report per repository."""
    structure = F.col("architecture.data.structure")
    return _reports(spark, sf).select(
        "repo_id",
        "analysis_id",
        "owner",
        "repository",
        "url",
        "description",
        "stars",
        "default_branch",
        "fallback_reason",
        "truncated",
        "mode",
        "is_demo",
        F.concat_ws("|", *[f"{stage}.source" for stage in C.STAGE_KEYS]).alias("sources"),
        F.col("architecture.data.framework").alias("framework"),
        _join("architecture.data.layers").alias("layers"),
        structure.sampled_file_count.alias("sampled_file_count"),
        _join(structure.root_directories).alias("root_directories"),
        _languages_text(structure.languages).alias("languages"),
        _join(structure.entry_points).alias("entry_points"),
        _join("architecture.data.violations").alias("violations"),
        F.col("architecture.data.summary").alias("architecture_summary"),
        _join(
            F.transform(
                "debt.data.hotspots",
                lambda h: F.concat_ws(
                    ":", h.path, h.lines.cast("string"), h.score.cast("int").cast("string"), _join(h.signals, ",")
                ),
            )
        ).alias("hotspots"),
        F.col("debt.data.total_debt_score").alias("total_debt_score"),
        F.col("debt.data.summary").alias("debt_summary"),
        F.col("cost.data.annual_cost").alias("annual_cost"),
        F.col("cost.data.priority").alias("priority"),
        F.col("cost.data.roi_months").alias("roi_months"),
        F.col("refactor.data.target").alias("target"),
        _join("refactor.data.steps").alias("steps"),
        F.col("refactor.data.pull_request_title").alias("pull_request_title"),
        _join(F.transform("refactor.data.scaffolds", lambda f: f.path)).alias("scaffold_paths"),
        F.col("review.data.verdict").alias("verdict"),
        _join("review.data.checks").alias("checks"),
        F.col("review.data.caveat").alias("caveat"),
        F.size("events").alias("n_events"),
    )


# --- set operations -----------------------------------------------------------
@query("snapshot_union")
def _snapshot_union(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_rows(*_snapshots(spark, sf)).select(
        "repo_id", "route", "pos", "path", "size", "lines", "score"
    )


@query("bundle_rows")
def _bundle_rows(spark: SparkSession, sf: str) -> DataFrame:
    return bundles.bundle_rows(_stored(spark, sf))


@query("bundle_requests")
def _bundle_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Downloads: the files of the live report that each accepted request asks for."""
    asked = X.questions(spark, sf).select("question_id", "analysis_id")
    return bundles.bundle_requests(asked, _stored(spark, sf), X.AS_OF, "question_id").select(
        "question_id", "analysis_id", "status", "path", F.md5(F.encode("content", "utf-8")).alias("content_md5")
    )


# --- scalar functions ---------------------------------------------------------
@query("redact_tokens")
def _redact_tokens_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.error_rows(spark, sf)
    return rows.select("row_id", redact_tokens(F.col("message")).alias("message"))


@query("classify_errors")
def _classify_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.error_rows(spark, sf)
    status = errors.error_status(F.col("status"), F.col("is_validation"))
    return rows.withColumn("status", status).select(
        "row_id", "status", errors.user_message(F.col("status"), F.col("message")).alias("user_message")
    )


@query("short_url")
def _short_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = validate.parse_urls(X.repo_urls(spark, sf))
    return rows.select("request_id", short_url(F.col("canonical_url")).alias("label"))


@query("bundle_name")
def _bundle_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.stream_reports(spark, sf)
    return rows.select("analysis_id", bundle_name(F.col("created_at")).alias("file_name"))


# --- streaming -----------------------------------------------------------------
@query("live_reports_stream")
def _live_reports_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared_folder(spark, "live-reports")
    arriving = X.stream_reports(spark, sf)
    arriving.write.parquet(f"{folder}/arriving")
    stream = stream_job.report_stream(spark, f"{folder}/arriving", arriving.schema)
    for job in stream_job.register(stream, f"{folder}/table", f"{folder}/checkpoint", X.AS_OF):
        job.awaitTermination()
    live = lookup.live_reports(stream_job.registered(spark, f"{folder}/table", X.AS_OF, arriving.schema, days_only=True), X.AS_OF)
    return live.select("analysis_id", utc_text(F.col("created_at")).alias("created_at"))


@query("recent_repos_stream")
def _recent_repos_stream(spark: SparkSession, sf: str) -> DataFrame:
    """T9 from the event stream, in a few batches."""
    folder = shared_folder(spark, "recent")
    uses = X.repo_uses(spark, sf)
    uses.repartition(3).write.parquet(f"{folder}/arriving")
    stream = stream_job.report_stream(spark, f"{folder}/arriving", uses.schema, files_per_batch=1)
    recent_list.follow(stream, f"{folder}/lists", f"{folder}/checkpoint").awaitTermination()
    return recent_list.recent_lists(spark, f"{folder}/lists").select("user_id", "url", "rank")
