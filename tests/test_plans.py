"""What the physical plans may and may not contain, on landed Parquet tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from debtscope import fixtures as X
from debtscope.operators import profile as P
from debtscope.operators import sampling, snapshots
from debtscope.plans import report as R
from debtscope.queries import QUERIES


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """The inputs as tables, the way a user has them."""
    folder = tmp_path_factory.mktemp("landed")
    repos = QUERIES["metadata_scan"](spark, sf_dir).withColumn("status", F.expr(X.REPO_COLUMNS["status"]))
    tables = {
        "repos": repos,
        "listing": X.listing(spark, sf_dir),
        "bodies": X.bodies(spark, sf_dir),
        "archives": X.archives(spark, sf_dir),
        "attempts": X.attempts(X.landed_repos(spark, sf_dir)),
        "overlays": X.overlays(X.repo_ids(spark, sf_dir)),
        "repo_files": X.repo_files(spark, sf_dir),
    }
    for name, df in tables.items():
        df.write.parquet(str(folder / name))
    return {name: spark.read.parquet(str(folder / name)) for name in tables}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().treeString()


def formatted(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def node_blocks(df, kind: str) -> list[str]:
    return re.findall(rf"^\(\d+\) {kind}\b.*?(?=^\(\d+\) |\Z)", formatted(df), re.S | re.M)


def full_report(landed):
    names = ["repos", "listing", "bodies", "archives", "attempts", "overlays"]
    return R.repo_report(*[landed[n] for n in names], X.AS_OF)


def test_content_is_never_exchanged(spark, landed):
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = full_report(landed)
        exchanges = node_blocks(df, "Exchange")
        assert len(exchanges) >= 8
        assert not [e for e in exchanges if "content" in e]
        plan = plan_of(df)
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)


def test_bodies_join_on_path_too(spark, landed):
    joins = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = sampling.join_bodies(sampling.listing_sample(landed["listing"]), landed["bodies"])
        partitionings = re.findall(r"hashpartitioning\(([^)]*)\)", plan_of(df))
        assert sum("path" in p for p in partitionings) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)


def test_filters_and_columns_reach_the_scan(landed):
    df = sampling.listing_sample(landed["listing"], 75, 45_000)
    (scan,) = node_blocks(df, "Scan parquet")
    assert "EqualTo(type,blob)" in scan and "LessThanOrEqual(size,45000)" in scan
    df = landed["repo_files"].transform(sampling.sample_files).groupBy("repo_id").count()
    (scan,) = node_blocks(df, "Scan parquet")
    assert "EqualTo(type,blob)" in scan
    df = snapshots.truncated_repos(sampling.listing_sizes(landed["listing"]), 75)
    (scan,) = node_blocks(df, "Scan parquet")
    assert re.search(r"ReadSchema: struct<repo_id:bigint>\n", scan)


def test_caps_are_partial_before_the_shuffle(landed):
    for df in (
        sampling.listing_sample(landed["listing"], 75),
        snapshots.archive_files(landed["archives"], 75),
    ):
        plan = plan_of(df)
        assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1


def test_profile_gathers_no_files(landed):
    """Top lists are cut before the shuffle, counts are summed before it."""
    df = P.profile(sampling.sample_files(landed["repo_files"]), ["repo_id"])
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") >= 3 and "partial_count" in plan
    collects = [line for line in plan.splitlines() if "collect_list" in line]
    assert collects and all("kind#" in line for line in collects)


def test_texts_are_read_once_for_all_uses(spark, landed, tmp_path):
    names = ["repos", "listing", "bodies", "archives"]
    files = snapshots.snapshot_files(*[landed[n] for n in names], metrics=str(tmp_path / "metrics"))
    resolved = snapshots.resolve_snapshots(landed["repos"], landed["listing"], files, landed["attempts"])
    scans = node_blocks(resolved, "Scan parquet")
    assert not [s for s in scans if re.search(r"Output \[\d+\]: \[[^\]]*content#", s)]


def test_route_is_chosen_before_texts_are_measured(spark, landed, monkeypatch):
    """Each text scan meets the semi join below the counting of its patterns."""
    names = ["repos", "listing", "bodies", "archives"]
    files = snapshots.snapshot_files(*[landed[n] for n in names])
    lines = plan_of(files).splitlines()
    scans = [k for k, line in enumerate(lines) if "FileScan" in line and "content#" in line]
    assert len(scans) == 2
    for scan in scans:
        semi = max(k for k in range(scan) if "LeftSemi" in lines[k])
        counted = max(k for k in range(scan) if "regexp_count" in lines[k] or "functions#" in lines[k])
        assert counted < semi < scan and "BroadcastHashJoin" in lines[semi]
    # beyond the bound nothing is broadcast, and the routes come out the same
    chosen = [snapshots.resolve_snapshots(landed["repos"], landed["listing"], files, landed["attempts"])]
    monkeypatch.setattr(snapshots, "ROUTE_IDS", 0)
    whole = snapshots.snapshot_files(*[landed[n] for n in names])
    assert "LeftSemi" not in plan_of(whole) and whole.count() > files.count()
    chosen.append(snapshots.resolve_snapshots(landed["repos"], landed["listing"], whole, landed["attempts"]))
    first, second = (sorted(map(str, df.collect())) for df in chosen)
    assert first == second and len(first) == landed["repos"].count()


def test_repositories_are_asked_once(spark, sf_dir):
    """Ids out of all documents, and patterns on URLs, are not evaluated anew for each use of the repositories."""
    from debtscope import queries

    plan = plan_of(queries._reports(spark, sf_dir))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not [line for line in scans if "doc_id" in line]
