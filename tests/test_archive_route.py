from __future__ import annotations

from pyspark.sql import functions as F

from debtscope import fixtures as X
from debtscope.queries import QUERIES


def test_archives_hold_every_document(spark, sf_dir):
    entries = X.archives(spark, sf_dir)
    assert entries.count() == X.table(spark, sf_dir, "documents").count()
    branches = {r.repo_id: r.n for r in entries.groupBy("repo_id").agg(F.countDistinct("branch").alias("n")).collect()}
    assert branches[0] > 1 and branches[1] > 1


def test_hot_repositories_take_the_archive_route(spark, sf_dir):
    hot = F.col("repo_id") < 2
    stripped = QUERIES["strip_archive_root"](spark, sf_dir).filter(hot)
    assert {r.repo_id for r in stripped.select("repo_id").distinct().collect()} == {0, 1}
    kept = QUERIES["branch_prefer"](spark, sf_dir).filter(hot).select("repo_id", "branch").distinct().collect()
    assert sorted(map(tuple, kept)) == [(0, "master"), (1, "master")]
    routes = {r.repo_id: r.route for r in QUERIES["snapshot_resolve"](spark, sf_dir).collect()}
    assert routes[0] == "listing" and routes[1] == "archive" and {"sample", "error"} <= set(routes.values())
    missing = {r.repo_id for r in QUERIES["missing_snapshots"](spark, sf_dir).collect()}
    assert missing == {i for i, route in routes.items() if route == "sample"}
