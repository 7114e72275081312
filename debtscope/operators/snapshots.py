"""Which files stand for a repository: its listing, an archive, or the sample.

Files stay rows ``(repo_id, branch_rank, branch, pos, path, size, lines, markers,
functions)``: rank 0 is the listing, then come the branches in order of preference, and the
built-in sample is last.  Each (repository, rank) gets a profile by keyed aggregates, and
choosing a route is choosing a profile, so no step gathers the files of a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions import files as X
from debtscope.functions.text import fill
from debtscope.operators import profile as P
from debtscope.operators import sampling
from debtscope.operators.topk import top_k

LISTING, ARCHIVE, SAMPLE, ERROR = "listing", "archive", "sample", "error"
SAMPLE_RANK = len(C.BRANCHES) + 1
#: Ids of repositories up to this number are broadcast to choose a route before bodies are measured.
ROUTE_IDS = 2_000_000
FILE_COLUMNS = ["repo_id", "branch_rank", "branch", "pos", "path", "size", "lines", "markers", "functions"]


def branch_rank(branch: Column) -> Column:
    """Position of a branch name in the order of preference; null for any other."""
    return F.nullif(F.array_position(F.array(*[F.lit(b) for b in C.BRANCHES]), branch).cast("int"), F.lit(0))


def archive_files(archives: DataFrame, max_files: int | None = None, max_chars: int | None = None) -> DataFrame:
    """P5, P1, P3, P4 and T1 on archive entries of the branches that are tried.

    Archives have no size filter; size is the kept length.  Entries that were measured
    already come without ``content``.
    """
    entries = archives.filter(~F.endswith("name", F.lit("/"))).filter(branch_rank(F.col("branch")).isNotNull())
    coded = sampling.code_files(sampling.strip_archive_root(entries))
    kept = sampling.nonempty_files(sampling.measure(coded, max_chars) if "content" in coded.columns else coded)
    kept = kept.withColumns({"size": F.col("chars").cast("bigint"), "branch_rank": branch_rank(F.col("branch"))})
    return kept if max_files is None else top_k(kept, ["repo_id", "branch"], [F.col("pos")], max_files)


def prefer_branch(kept: DataFrame) -> DataFrame:
    """The files of the first usable branch of each repository.

    The best branch is an aggregate with one row per repository, so the files meet it in a
    join that the optimizer broadcasts or, where keys are skewed, splits.
    """
    best = kept.groupBy("repo_id").agg(F.min("branch_rank").alias("branch_rank"))
    return kept.join(best, ["repo_id", "branch_rank"], "left_semi")


def fallback_reasons(attempts: DataFrame) -> DataFrame:
    """What went wrong at the last branch tried, per repository; a read error comes first."""
    message = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(
            F.col("status") != 200,
            fill(M.ARCHIVE_STATUS, branch=F.col("branch"), status=F.col("status")),
        )
        .otherwise(fill(M.ARCHIVE_EMPTY, branch=F.col("branch")))
    )
    return attempts.groupBy("repo_id").agg(
        F.max_by(message, F.struct(branch_rank(F.col("branch")), F.col("error").isNotNull())).alias("reason")
    )


def truncated_repos(sizes: DataFrame, k: int) -> DataFrame:
    """A7, listing route: repositories with more than ``k`` entries of any kind."""
    return sizes.select("repo_id", (F.col("entries") > k).alias("listing_truncated"))


def sample_rows(repos: DataFrame) -> DataFrame:
    """The built-in files for every rate-limited repository, of which the last resort."""
    texts = F.array(
        *[
            F.struct(F.lit(pos).cast("bigint").alias("pos"), F.lit(path).alias("path"), F.lit(text).alias("content"))
            for pos, (path, text) in enumerate(M.SAMPLE_FILES)
        ]
    )
    rows = repos.filter(F.col("status") == 403).select("repo_id", F.explode(texts).alias("f")).select("repo_id", "f.*")
    return sampling.measure(rows).select(
        "repo_id",
        F.lit(SAMPLE_RANK).alias("branch_rank"),
        F.lit(M.SAMPLE_BRANCH).alias("branch"),
        "pos",
        "path",
        F.col("chars").cast("bigint").alias("size"),
        "lines",
        "markers",
        "functions",
    )


def on_route(df: DataFrame, repos: DataFrame, status: int) -> DataFrame:
    """The rows of repositories with this status, dropped where they are read.

    Only ids travel, and only up to ``ROUTE_IDS`` of them (16 bytes each).  Beyond that the
    rows stay as they are, for an exchange of bodies would cost more than measuring them;
    :func:`resolve_snapshots` then chooses among all profiles, with the same result.
    """
    ids = repos.filter(F.col("status") == status).select("repo_id").distinct()
    return df.join(F.broadcast(ids), "repo_id", "left_semi") if ids.count() <= ROUTE_IDS else df


def snapshot_files(
    repos: DataFrame,
    listing: DataFrame,
    bodies: DataFrame,
    archives: DataFrame,
    max_files: int | None = None,
    max_bytes: int | None = None,
    max_chars: int | None = None,
    metrics: str | None = None,
) -> DataFrame:
    """The measured files of all routes, narrow.

    A repository's status settles which route is read: listing and bodies at 200, archives
    at 403.  Other texts are not measured.
    With ``metrics``, a folder, they are written there once and read back, so that texts
    are read once however often the rows are used.
    """
    wanted = sampling.listing_sample(on_route(listing, repos, 200), max_files, max_bytes)
    listed = sampling.join_bodies(wanted, on_route(bodies, repos, 200), max_chars).withColumns(
        {"branch_rank": F.lit(0), "branch": F.lit(None).cast("string")}
    )
    archived = archive_files(on_route(archives, repos, 403), max_files, max_chars)
    files = (
        listed.select(*FILE_COLUMNS)
        .unionByName(archived.select(*FILE_COLUMNS))
        .unionByName(sample_rows(repos).select(*FILE_COLUMNS))
    )
    if metrics is None:
        return files
    files.write.parquet(metrics)
    return files.sparkSession.read.schema(files.schema).parquet(metrics)


def resolve_snapshots(
    repos: DataFrame,
    listing: DataFrame,
    files: DataFrame,
    attempts: DataFrame,
    max_files: int | None = None,
    coverage: DataFrame | None = None,
) -> DataFrame:
    """One row per repository with its route and the profile of its files.

    ``repos.status`` is 200 when metadata and listing were both read, else the failing
    status.  200 -> listing; 403 -> archive, or the sample when no archive has a usable
    file; anything else -> error (kept as a row with its message, without files).

    ``coverage`` is that of the listing documents; a listing with gaps counts as truncated,
    and the review says so.
    """
    profiles = P.profile(files, ["repo_id", "branch_rank", "branch"]).withColumn("n", F.col("profile.n"))
    is_listing = F.col("branch_rank") == 0
    record = F.struct("branch_rank", "branch", "profile")
    chosen = profiles.groupBy("repo_id").agg(
        F.min_by(record, F.when(is_listing, 0)).alias("listed"),
        F.min_by(record, F.when(~is_listing, F.col("branch_rank"))).alias("other"),
    )
    joined = repos.join(chosen, "repo_id", "left").join(fallback_reasons(attempts), "repo_id", "left")
    if max_files is None:
        joined = joined.withColumn("listing_truncated", F.lit(False))
    else:
        joined = joined.join(truncated_repos(sampling.listing_sizes(listing), max_files), "repo_id", "left")
    if coverage is not None:
        gaps = coverage.select("repo_id", (~F.col("complete")).alias("has_gaps"))
        joined = joined.join(gaps, "repo_id", "left")
        cut = F.coalesce("listing_truncated", F.lit(False)) | F.coalesce("has_gaps", F.lit(False))
        joined = joined.withColumn("listing_truncated", cut).drop("has_gaps")
    return pick_route(joined, max_files)


def pick_route(joined: DataFrame, max_files: int | None = None) -> DataFrame:
    """Route and everything that depends on it, from the profiles of one repository."""
    rank = F.col("other.branch_rank")
    route = (
        F.when(F.col("status") == 200, F.lit(LISTING))
        .when((F.col("status") == 403) & (rank < SAMPLE_RANK), F.lit(ARCHIVE))
        .when(F.col("status") == 403, F.lit(SAMPLE))
        .otherwise(F.lit(ERROR))
    )
    message = F.col("message") if "message" in joined.columns else F.lit(None).cast("string")
    routed = joined.withColumn("route", route)
    on = {name: F.col("route") == name for name in (LISTING, ARCHIVE, SAMPLE, ERROR)}
    full = F.lit(False) if max_files is None else F.col("other.profile.n") >= max_files
    return routed.select(
        "repo_id",
        "owner",
        "repository",
        "url",
        "status",
        "route",
        F.when(on[LISTING], F.col("description"))
        .when(on[SAMPLE], F.lit(M.SAMPLE_DESCRIPTION))
        .otherwise(F.lit(""))
        .alias("description"),
        F.when(on[LISTING], F.col("stars")).otherwise(F.lit(0)).cast("bigint").alias("stars"),
        F.when(on[LISTING], F.col("default_branch"))
        .when(on[ARCHIVE] | on[SAMPLE], F.col("other.branch"))
        .alias("default_branch"),
        F.when(on[SAMPLE], F.coalesce("reason", F.lit(M.ARCHIVE_DEFAULT))).alias("fallback_reason"),
        F.when(on[LISTING], F.coalesce("listing_truncated", F.lit(False)))
        .when(on[ARCHIVE], full)
        .otherwise(F.lit(False))
        .alias("truncated"),
        F.when(on[LISTING], F.lit(0)).when(on[ARCHIVE] | on[SAMPLE], rank).alias("branch_rank"),
        F.coalesce(
            F.when(on[LISTING], F.col("listed.profile")).when(on[ARCHIVE] | on[SAMPLE], F.col("other.profile")),
            P.no_files(),
        ).alias("profile"),
        F.when(on[ERROR], message).alias("message"),
    )


def missing_snapshots(repos: DataFrame, kept: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rate-limited repositories without a usable archive, and why."""
    usable = kept.select("repo_id").distinct()
    return (
        repos.filter(F.col("status") == 403)
        .join(usable, "repo_id", "left_anti")
        .join(fallback_reasons(attempts), "repo_id", "left")
        .select(
            "repo_id",
            "owner",
            "repository",
            "url",
            F.coalesce("reason", F.lit(M.ARCHIVE_DEFAULT)).alias("fallback_reason"),
        )
    )


def snapshot_rows(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """The files of all routes as rows."""
    chosen = resolved.select("repo_id", "branch_rank", "route")
    score = X.debt_score(F.col("lines"), F.col("markers"), F.col("functions"))
    return files.join(chosen, ["repo_id", "branch_rank"]).withColumn("score", score)
