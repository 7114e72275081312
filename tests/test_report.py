"""Snapshots, profile, report and overlays on small hand-made repositories."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions import rules
from debtscope.operators import overlay as O
from debtscope.operators import profile as P
from debtscope.operators import sampling, snapshots
from debtscope.operators.overlay import is_json
from debtscope.plans import report as R
from debtscope.sources import archives as A
from debtscope.sources import landed

RUN_AT = datetime(2024, 5, 1, tzinfo=timezone.utc)
REPOS = "repo_id bigint, owner string, repository string, url string, status int, description string, stars bigint, default_branch string"
LISTING = "repo_id bigint, pos bigint, type string, path string, size bigint"
BODIES = "repo_id bigint, path string, content string"
ARCHIVES = "repo_id bigint, branch string, pos bigint, name string, content string"
ATTEMPTS = "repo_id bigint, branch string, status int, error string"
OVERLAYS = "repo_id bigint, stage string, payload string"
LEGACY = "function task() {}\n" * 40 + "// TODO: split this up"


def repo(i, status=200, branch="main"):
    return (i, "o", f"r{i}", f"https://github.com/o/r{i}", status, "about", 3, branch)


def inputs(spark, repos=(), listing=(), bodies=(), archives=(), attempts=()):
    pairs = [(repos, REPOS), (listing, LISTING), (bodies, BODIES), (archives, ARCHIVES), (attempts, ATTEMPTS)]
    return [spark.createDataFrame(list(rows), schema) for rows, schema in pairs]


def simple(spark, files, i=1, **more):
    """One readable repository with the given (path, content) files."""
    listing = [(i, n, "blob", p, len(c.encode())) for n, (p, c) in enumerate(files)]
    return inputs(spark, [repo(i)], listing, [(i, p, c) for p, c in files], **more)


def report(spark, tables, overlays=None):
    laid = None if overlays is None else spark.createDataFrame(overlays, OVERLAYS)
    return {r.repo_id: r for r in R.repo_report(*tables, laid, RUN_AT).collect()}


CAPS = {"max_files": 75, "max_bytes": 45_000, "max_chars": 45_000}


def resolve(tables, **limits):
    """The resolved repository, and its files in order."""
    repos, listing, bodies, archives, attempts = tables
    files = snapshots.snapshot_files(repos, listing, bodies, archives, **limits)
    resolved = snapshots.resolve_snapshots(repos, listing, files, attempts, limits.get("max_files"))
    (row,) = resolved.collect()
    return row, snapshots.snapshot_rows(resolved, files).orderBy("pos").collect()


def test_structure_of_three_files(spark):
    paths = ["src/main.ts", "src/components/Card.tsx", "api/server.py"]
    row = report(spark, simple(spark, [(p, "x") for p in paths]))[1]
    s = row.architecture.data.structure
    assert s.root_directories == ["src", "api"]
    assert [(p.language, p.n) for p in s.languages] == [("TypeScript", 2), ("Python", 1)]
    assert s.entry_points == ["src/main.ts", "api/server.py"]
    assert s.sampled_file_count == 3


def test_legacy_file(spark):
    row = report(spark, simple(spark, [("src/legacy.ts", LEGACY)]))[1]
    (hot,) = row.debt.data.hotspots
    assert (hot.path, hot.lines, hot.score) == ("src/legacy.ts", 41, 100)
    assert hot.signals == ["1 maintenance markers", "high function density"]
    assert row.debt.data.total_debt_score == 100
    cost = row.cost.data
    assert (cost.annual_cost, cost.priority, cost.roi_months) == (1800, "High", 7)
    assert row.refactor.data.target == "src/legacy.ts"
    assert [f.path for f in row.refactor.data.scaffolds] == [
        "src/features/legacy/legacy.ts", "src/features/legacy/legacy.test.ts"]
    assert "createlegacy" in row.refactor.data.scaffolds[0].content
    assert [e.agent for e in row.events if e.status == "complete"] == C.STAGES
    assert [e.seq for e in row.events] == list(range(10))
    assert (row.mode, row.is_demo) == ("demo", True)


def test_empty_repository_has_a_report(spark):
    row = report(spark, inputs(spark, [repo(1)]))[1]
    assert row.debt.data.total_debt_score == 0
    assert row.cost.data.annual_cost == 250
    assert row.refactor.data.target == "src/feature.ts"
    assert row.architecture.data.framework == "Polyglot application"
    assert row.architecture.data.structure.sampled_file_count == 0
    assert row.review.data.caveat is None


def test_listing_route_filters(spark):
    listing = [
        (1, 0, "tree", "src", None),
        (1, 1, "blob", "README.md", 10),
        (1, 2, "blob", "src/main.ts", 20),
        (1, 3, "blob", "src/big.ts", 45_001),
        (1, 4, "blob", "src/edge.ts", 45_000),
        (1, 5, "blob", "src/failed.ts", 5),
        (1, 6, "blob", "src/empty.ts", 5),
        (1, 7, "blob", "src/nosize.ts", None),
    ]
    bodies = [(1, "src/main.ts", "export {}"), (1, "src/edge.ts", "y" * 50_000), (1, "src/empty.ts", ""),
              (1, "README.md", "text"), (1, "src/big.ts", "z"), (1, "src/nosize.ts", "n")]
    tables = inputs(spark, [repo(1)], listing, bodies)
    row, files = resolve(tables, **CAPS)
    assert [(f.path, f.size) for f in files] == [("src/main.ts", 20), ("src/edge.ts", 45_000)]
    whole = resolve(tables)[1]
    assert [f.path for f in whole] == ["src/main.ts", "src/big.ts", "src/edge.ts", "src/nosize.ts"]
    assert (row.route, row.truncated, row.description, row.stars) == ("listing", False, "about", 3)


def test_cap_comes_before_empty_files_drop(spark):
    files = [(f"src/f{n}.ts", "" if n < 10 else "x") for n in range(100)]
    row, kept = resolve(simple(spark, files), **CAPS)
    assert len(kept) == row.profile.n == 65 and kept[-1].path == "src/f74.ts"
    assert row.truncated
    row, kept = resolve(simple(spark, files))
    assert len(kept) == row.profile.n == 90 and not row.truncated


def test_large_repository_counts_as_a_whole(spark):
    files = [(f"d{n % 9}/f{n}.{'ts' if n % 3 else 'py'}", "x\n" * (130 + n // 100)) for n in range(10_000)]
    row = report(spark, simple(spark, files))[1]
    s = row.architecture.data.structure
    assert s.sampled_file_count == 10_000
    assert [(p.language, p.n) for p in s.languages] == [("TypeScript", 6666), ("Python", 3334)]
    assert [h.path for h in row.debt.data.hotspots] == [f"d{n % 9}/f{n}.{'ts' if n % 3 else 'py'}" for n in range(9_700, 9_706)]


def test_truncated_counts_every_entry(spark):
    for extra, truncated in ((74, False), (75, True)):
        listing = [(1, 0, "blob", "a.ts", 1)] + [(1, n + 1, "tree", f"d{n}", None) for n in range(extra)]
        tables = inputs(spark, [repo(1)], listing, [(1, "a.ts", "x")])
        assert resolve(tables, **CAPS)[0].truncated is truncated
        assert resolve(tables)[0].truncated is False


def archive(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in entries:
            z.writestr(name, text)
    return buffer.getvalue()


def test_archive_source(spark, tmp_path):
    (tmp_path / "1-main.zip").write_bytes(
        archive([("x-main/", ""), ("top.ts", "t"), ("x-main/src/main.ts", "export {}"), ("x-main/README.md", "r"),
                 ("x-main/empty.ts", ""), ("x-main/long.ts", "é" * 50_000)]))
    (tmp_path / "2-dev.zip").write_bytes(b"no archive")
    found = A.read_archive_files(spark, str(tmp_path), r"([0-9]+)-([a-z]+)[.]zip$")
    assert found.count() == 2
    rows = A.archive_scan(found).orderBy("pos").collect()
    assert [(r.repo_id, r.branch, r.path, r.size) for r in rows] == [
        (1, "main", "src/main.ts", 9), (1, "main", "long.ts", 50_000)]
    (failed,) = A.archive_attempts(A.unpack_archives(found)).collect()
    assert (failed.repo_id, failed.branch, failed.status) == (2, "dev", 200) and "zip" in failed.error
    capped = A.archive_scan(found, max_files=1, max_chars=3).collect()
    assert [(r.path, r.content) for r in capped] == [("src/main.ts", "exp")]
    none = [spark.createDataFrame([], schema) for schema in (LISTING, BODIES)]
    repos = spark.createDataFrame([repo(1, 403), repo(2, 403)], REPOS)
    files = snapshots.snapshot_files(repos, *none, A.archive_scan(found))
    tried = A.archive_attempts(A.unpack_archives(found)).unionByName(
        spark.createDataFrame([(2, "dev", 200, None)], ATTEMPTS))
    routes = {r.repo_id: r for r in snapshots.resolve_snapshots(repos, none[0], files, tried).collect()}
    assert (routes[1].route, routes[1].profile.context) == ("archive", ["src/main.ts", "long.ts"])
    assert routes[2].route == "sample" and "zip" in routes[2].fallback_reason


def test_archives_share_frames(tmp_path):
    """Many small archives make few frames, unpacked or listed; a large one is cut."""
    import pandas as pd

    blobs = [archive([("r/a.ts", f"a{k}"), ("r/b.ts", "b")]) if k % 10 else b"no archive" for k in range(200)]
    for k, blob in enumerate(blobs):
        (tmp_path / f"{k}-main.zip").write_bytes(blob)
    batch = pd.DataFrame({"repo_id": range(200), "branch": "main", "zip": blobs})
    frames = list(A._unpack(None, None)(iter([batch, batch])))
    assert len(frames) == 1 and list(frames[0].columns) == A.ENTRY_COLUMNS and len(frames[0]) == 2 * (180 * 2 + 20)
    assert frames[0]["error"].notna().sum() == 40 and frames[0]["pos"].max() == 1
    files = pd.DataFrame({"repo_id": range(200), "branch": "main", "file": [f"file:{tmp_path}/{k}-main.zip" for k in range(200)], "first_pos": 0})
    (listed,) = A._directory(iter([files]))
    assert len(listed) == 180 * 2 + 20 and listed["error"].notna().sum() == 20
    large = pd.DataFrame({"repo_id": [1], "branch": "main", "zip": [archive([(f"r/f{k}.ts", "x" * 500_000) for k in range(20)])]})
    cut = list(A._unpack(None, None)(iter([large])))
    assert sum(map(len, cut)) == 20 and max(map(len, cut)) <= 8


def test_entries_by_byte_range(spark, tmp_path):
    """The same rows as from whole archives, whatever the range, from stored and packed entries."""
    texts = {f"r/src/f{k}.ts": f"export const x{k} = {k}\n" * (k % 50 * 20 + 1) for k in range(300)}
    for kind, name in ((zipfile.ZIP_STORED, "7-main-0.zip"), (zipfile.ZIP_DEFLATED, "7-main-1000.zip"), (zipfile.ZIP_DEFLATED, "8-dev-0.zip")):
        with zipfile.ZipFile(tmp_path / name, "w", kind) as z:
            z.writestr("r/", "")
            for path, text in texts.items():
                z.writestr(path, text)
            z.writestr("r/NOTES.md", "not read")
            z.writestr("top.ts", "no root")
            z.writestr("r/empty.ts", "")
            z.writestr("r/bad.ts", b"\xff\xfe")
    (tmp_path / "9-dev-0.zip").write_bytes(b"no archive")
    pattern = r"([0-9]+)-([a-z]+)-([0-9]+)[.]zip$"
    want = sorted((7, "main", first + k, f"src/f{k - 1}.ts", texts[f"r/src/f{k - 1}.ts"]) for first in (0, 1000) for k in range(1, 301))
    for size in (200, 5000, A.RANGE_BYTES):
        rows = A.read_archive_entries(spark, str(tmp_path), pattern, range_bytes=size)
        good = A.readable_archives(rows)
        got = good.filter("repo_id = 7 AND path LIKE 'src/%'").collect()
        assert sorted((r.repo_id, r.branch, r.pos, r.path, r.content) for r in got) == want
        assert all(r.size == len(r.content) for r in got)
        assert good.filter("repo_id = 8").count() == 301 and good.filter("path = 'bad.ts'").first().content == "\ufffd\ufffd"
        (failed,) = A.archive_attempts(rows).collect()
        assert (failed.repo_id, failed.branch, failed.status) == (9, "dev", 200)
    cut = A.readable_archives(A.read_archive_entries(spark, str(tmp_path), pattern, max_chars=9)).filter("repo_id = 8 AND path = 'src/f49.ts'")
    assert cut.first().content == texts["r/src/f49.ts"][:9]


def test_zip_files_are_opened_once(spark, tmp_path):
    """Measured entries are read from their table; the tasks that open files are not as few as the rows' bytes."""
    (tmp_path / "zips").mkdir()
    for k in range(40):
        (tmp_path / "zips" / f"{k}-main.zip").write_bytes(archive([("r/a.ts", f"a{k}\n// TODO"), ("r/b.ts", "")]))
    (tmp_path / "zips" / "90-main.zip").write_bytes(b"no archive")
    rows = A.read_archive_entries(spark, str(tmp_path / "zips"), r"([0-9]+)-([a-z]+)[.]zip$")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f"RepartitionByExpression [file" in (plan := rows._jdf.queryExecution().logical().toString()) and f"], {n}" in plan
    want = sorted(map(str, snapshots.prefer_branch(snapshots.archive_files(A.readable_archives(rows))).drop("error").select("repo_id", "path", "size", "lines", "markers").collect()))
    measured = A.measured_entries(rows, str(tmp_path / "entries"))
    assert [r.repo_id for r in A.archive_attempts(measured).collect()] == [90]
    kept = snapshots.prefer_branch(snapshots.archive_files(A.readable_archives(measured)))
    assert "MapInPandas" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, kept.select("repo_id", "path", "size", "lines", "markers").collect())) == want and len(want) == 40


def test_no_task_holds_an_archive(spark, tmp_path):
    """Entries of one large archive are read by several tasks; other files' names are all that is known of them."""
    with zipfile.ZipFile(tmp_path / "1-main.zip", "w") as z:
        for k in range(400):
            z.writestr(f"r/f{k}.ts", f"{k} " * 500)
            z.writestr(f"r/f{k}.png", b"\0" * 5000)
    rows = A.read_archive_entries(spark, str(tmp_path), r"([0-9]+)-([a-z]+)[.]zip$", range_bytes=1 << 17)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in shares) == 400 and len(shares) > 1 and max(r.n for r in shares) < 300
    plan = A.list_archive_files(spark, str(tmp_path), r"([0-9]+)-([a-z]+)[.]zip$")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_the_driver_knows_no_archive_file(spark, tmp_path):
    """Tasks list the folders: the files are those that Spark lists, but none of them is in the plan."""
    names = [f"{part}/{k}-main-{part}.zip" for part in range(5) for k in range(40)]
    names += ["7-dev-1.zip", "a/b/c/8-dev-2.zip", "a b/9%20-dev-3.zip", "_k=1/10-dev-4.zip", "_metadata_x/11-dev-5.zip", "é/12-dev-6.zip"]
    hidden = ["_x/1-main-1.zip", ".x/1-main-1.zip", "_1-main-1.zip", ".1-main-1.zip", "_metadata", "1-main-1.zip._COPYING_", "empty/1-main-1.zip"]
    for name in names + hidden:
        (tmp_path / "zips" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "zips" / name).write_bytes(b"" if name.startswith("empty") else archive([("r/a.ts", name)]))
    (tmp_path / "zips" / "none").mkdir()
    pattern = r"([0-9]+)[^/]*-([a-z]+)-([0-9]+)[.]zip$"
    for path in ("zips", "zips/[0-2]", "zips/0/*-main-0.zip", "zips/none", "zips/_*"):
        listed = A.list_archive_files(spark, f"{tmp_path}/{path}", pattern)
        by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/{path}").select("path", "length")
        got = listed.select("file", "length").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, by_spark.collect())), path
        assert not [f for f in listed.inputFiles() if f.endswith(".zip")]
    whole = A.list_archive_files(spark, str(tmp_path / "zips"), pattern)
    assert whole.count() == len(names) and whole.rdd.getNumPartitions() < 40
    assert {(r.repo_id, r.branch, r.first_pos) for r in whole.filter("branch = 'dev' AND repo_id = 8").collect()} == {(8, "dev", 2)}
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        A.list_archive_files(spark, str(tmp_path / "absent"), pattern)
    rows = A.read_archive_entries(spark, str(tmp_path / "zips"), pattern)
    assert not [f for f in rows.inputFiles() if f.endswith(".zip")]
    assert rows.filter("error IS NULL AND branch = 'main'").count() == 200


def test_a_damaged_entry_makes_the_archive_unreadable(spark, tmp_path):
    blob = bytearray(archive([("x/a.ts", "first text"), ("x/b.ts", "second text")]))
    at = blob.index(b"second text")
    blob[at] ^= 1
    (tmp_path / "1-main.zip").write_bytes(bytes(blob))
    (tmp_path / "2-main.zip").write_bytes(archive([("x/a.ts", "first text")])[:-5])
    (tmp_path / "3-main.zip").write_bytes(archive([("x/a.ts", "old"), ("x/c.ts", "c"), ("x/a.ts", "new")]))
    rows = A.read_archive_entries(spark, str(tmp_path), r"([0-9]+)-([a-z]+)[.]zip$")
    assert {(r.repo_id, r.path, r.content, r.pos) for r in A.readable_archives(rows).collect()} == {(3, "a.ts", "new", 0), (3, "c.ts", "c", 1)}
    assert sorted(r.repo_id for r in A.archive_attempts(rows).collect()) == [1, 2]


def test_rate_limit_uses_archive(spark):
    archives = [
        (1, "dev", 0, "r-dev/a.py", "x = 1"),
        (1, "master", 0, "r/", ""),
        (1, "master", 1, "r/README.md", "text"),
        (1, "trunk", 0, "r/src/main.ts", "export {}"),
        (1, "trunk", 1, "main.ts", "no root"),
        (1, "feature", 0, "r/z.ts", "never tried"),
    ]
    row, files = resolve(inputs(spark, [repo(1, 403)], archives=archives))
    assert (row.route, row.default_branch, row.truncated) == ("archive", "trunk", False)
    assert [f.path for f in files] == ["src/main.ts"]
    assert (row.description, row.stars, row.fallback_reason) == ("", 0, None)


def test_archive_cap_keeps_75_nonempty(spark):
    archives = [(1, "main", n, f"r/f{n}.ts", "" if n % 2 else "x") for n in range(160)]
    row, files = resolve(inputs(spark, [repo(1, 403)], archives=archives), **CAPS)
    assert len(files) == 75 and row.truncated
    assert files[-1].path == "f148.ts"


def test_sample_stands_in(spark):
    attempts = [(1, "main", 404, None), (1, "dev", 200, None), (2, "dev", 404, "socket closed"), (2, "main", 404, None)]
    tables = inputs(spark, [repo(1, 403), repo(2, 403), repo(3, 403), repo(4, 500), repo(5, 404)], attempts=attempts)
    rows = report(spark, tables)
    assert sorted(rows) == [1, 2, 3]
    assert "GitHub archive" in rows[1].fallback_reason and "dev" in rows[1].fallback_reason
    assert rows[2].fallback_reason == "socket closed"
    assert rows[3].fallback_reason == M.ARCHIVE_DEFAULT
    row = rows[1]
    s = row.architecture.data.structure
    assert s.sampled_file_count == len(M.SAMPLE_FILES) == 4
    assert s.root_directories == ["src", "server"]
    assert [(p.language, p.n) for p in s.languages] == [("TypeScript", 2), ("JavaScript", 2)]
    assert row.debt.data.hotspots == [] and row.debt.data.total_debt_score == 0
    assert (row.cost.data.annual_cost, row.cost.data.priority, row.cost.data.roi_months) == (250, "Low", 1)
    assert row.refactor.data.target == M.SAMPLE_FILES[0][0]
    assert row.debt.data.summary == M.DEBT_FALLBACK
    assert (row.default_branch, row.stars, row.truncated) == ("main", 0, False)


def test_hotspots_order_and_limits(spark):
    def lines(n):
        return "x\n" * (n - 1) + "x"

    files = [("a.ts", lines(120)), ("b.ts", lines(124))] + [(f"t{n}.ts", lines(400)) for n in range(6)] + [("c.ts", lines(480))]
    row = report(spark, simple(spark, files))[1]
    assert [(h.path, h.score) for h in row.debt.data.hotspots] == [("c.ts", 60)] + [(f"t{n}.ts", 50) for n in range(5)]
    assert row.debt.data.total_debt_score == 52  # (60 + 5 * 50) / 6 = 51.67
    only = report(spark, simple(spark, files[:2]))[1]
    assert [h.path for h in only.debt.data.hotspots] == ["b.ts"]  # 15 is no hotspot, 16 is


def test_limits_of_the_profile(spark):
    files = [(f"d{n}/components/a-service{n}/index.ts", "x") for n in range(12)]
    row = report(spark, simple(spark, files))[1].architecture.data
    assert row.structure.root_directories == [f"d{n}" for n in range(8)]
    assert len(row.structure.entry_points) == 6 and len(row.violations) == 3


@pytest.mark.parametrize(
    ("score", "cost", "priority", "months"),
    [(65, 1170, "Medium", 5), (36, 648, "Low", 2), (37, 666, "Medium", 3), (66, 1188, "Medium", 5),
     (67, 1206, "High", 5), (0, 250, "Low", 1), (100, 1800, "High", 7)],
)
def test_cost(evaluate, score, cost, priority, months):
    annual = rules.annual_cost(F.col("a"))
    row = F.struct(annual, rules.cost_priority(annual), rules.payback_months(annual))
    assert tuple(evaluate(row, [(score,)], "a int")[0]) == (cost, priority, months)


CASES = {
    "number": ("debt", '{"totalDebtScore": 50.5}'),
    "twice": ("debt", '{"totalDebtScore": "50", "totalDebtScore": "60"}'),
    "nulls": ("debt", '{"totalDebtScore": null, "hotspots": null}'),
    "zero": ("debt", '{"totalDebtScore": 0}'),
    "text": ("debt", '{"totalDebtScore": "50"}'),
    "words": ("debt", '{"totalDebtScore": "many"}'),
    "no hotspots": ("debt", '{"hotspots": []}'),
    "broken": ("debt", '{"totalDebtScore": 5'),
    "trailing": ("debt", '{"totalDebtScore": 5} done'),
    "null": ("debt", "null"),
    "array": ("debt", "[1]"),
    "empty": ("debt", "{}"),
    "target": ("refactor", '{"scaffolds": [], "target": "a/my-file.x.ts"}'),
    "no target": ("refactor", '{"scaffolds": [], "target": null}'),
    "own files": ("refactor", '{"scaffolds": [{"path": "p", "content": "c"}]}'),
    "structure": ("architecture", '{"structure": {"sampledFileCount": 9, "languages": [["Go", 2]]}}'),
}


def test_overlays(spark):
    numbers = {name: i for i, name in enumerate(CASES, start=1)}
    tables = inputs(
        spark,
        [repo(i) for i in numbers.values()],
        [(i, 0, "blob", "src/legacy.ts", len(LEGACY)) for i in numbers.values()],
        [(i, "src/legacy.ts", LEGACY) for i in numbers.values()],
    )
    rows = report(spark, tables, [(numbers[name], *case) for name, case in CASES.items()])
    got = {name: rows[i] for name, i in numbers.items()}

    row = got["number"]
    assert (row.debt.source, row.debt.data.total_debt_score, row.cost.data.annual_cost) == ("overlay", 50.5, 909)
    assert (row.mode, row.is_demo) == ("live", False)
    assert len(row.debt.data.hotspots) == 1
    assert got["twice"].debt.data.total_debt_score == 60
    row = got["nulls"]
    assert row.debt.data.total_debt_score is None and row.debt.data.hotspots is None
    assert row.cost.data.annual_cost == 1800 and row.refactor.data.target == "src/legacy.ts"
    assert got["zero"].cost.data.annual_cost == 1800
    assert got["text"].cost.data.annual_cost == 900
    assert got["words"].debt.data.total_debt_score == 100
    assert got["no hotspots"].refactor.data.target == "src/legacy.ts"
    for name in ("broken", "trailing"):
        assert (got[name].debt.source, got[name].debt.data.total_debt_score) == ("fallback", 100)
        assert got[name].mode == "demo"
    for name in ("null", "array", "empty"):
        assert (got[name].debt.source, got[name].debt.data.total_debt_score) == ("overlay", 100)
        assert got[name].mode == "live"
    files = got["target"].refactor.data.scaffolds
    assert [f.path for f in files] == ["src/features/myfilex/myfilex.ts", "src/features/myfilex/myfilex.test.ts"]
    assert "createMyfilex" in files[0].content
    assert got["no target"].refactor.data.target is None
    assert got["no target"].refactor.data.scaffolds[0].path == "src/features/feature/feature.ts"
    assert [tuple(f) for f in got["own files"].refactor.data.scaffolds] == [("p", "c")]
    structure = got["structure"].architecture.data.structure
    assert structure.languages[0].language == "Go" and structure.root_directories is None


def test_is_json(evaluate):
    texts = ['{"a":1,"b":', '{"a":1,"b":2', '{"a":1} x', '{"a":1,"a":2}', '{"a":{"x":1,"x":2}}', '{"a":1,}',
             '{"a":1}{"b":2}', "{'a':1}", '  {"a":1} ', '""', '"x"', "5", "tru", "[1,", "[1] 2", "", "   ",
             '{"a":01}', '{"a":"\\u00e9"}', "null", "1,2", '1,"b":2', "1],[2", "1}", "[]", "[[1],{}]", "```{}```"]

    def valid(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return True

    got = evaluate(is_json(F.col("c")), [(t,) for t in texts], "c string")
    assert dict(zip(texts, got)) == {t: valid(t) for t in texts}


def test_landed_documents(spark):
    pages = spark.createDataFrame(
        [(1, 0, '{"tree": [{"type": "blob", "path": "a.ts", "size": 1}, {"type": "tree", "path": "d"}]}'),
         (1, 2, '{"tree": [{"type": "blob", "path": "b.ts", "size": 2}]}'),
         (2, 0, '{"message": "none"}'), (3, 0, "broken")],
        "repo_id bigint, first_pos bigint, payload string")
    rows = sorted(tuple(r) for r in landed.listing_scan(pages).collect())
    assert rows == [(1, 0, "blob", "a.ts", 1), (1, 1, "tree", "d", None), (1, 2, "blob", "b.ts", 2)]
    meta = spark.createDataFrame(
        [(1, '{"default_branch": "main", "stargazers_count": 3}'), (2, '{"description": null}')],
        "repo_id bigint, metadata string")
    got = [tuple(r) for r in landed.metadata_scan(meta).orderBy("repo_id").collect()]
    assert got == [(1, "", 3, "main"), (2, "", 0, None)]


def test_join_equals_one_table(spark):
    files = [(1, n, "blob", f"s/f{n % 50}-{n}.ts", 5, "" if n % 7 == 0 else f"function a{n}") for n in range(300)]
    table = spark.createDataFrame(files, LISTING + ", content string")
    one = sampling.sample_files(table, 75).select("repo_id", "pos", "path", "lines", "functions")
    joined = sampling.join_bodies(
        sampling.listing_sample(table.drop("content"), 75), table.select("repo_id", "path", "content"))
    two = joined.select("repo_id", "pos", "path", "lines", "functions")
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 64


def test_context_and_sources(spark):
    files = spark.createDataFrame(
        [(1, n, f"f{n}.ts", 200 + n, 0, 0) for n in range(40)],
        "repo_id bigint, pos bigint, path string, lines int, markers int, functions int")
    rows = P.with_profile(spark.createDataFrame([(1,), (2,)], "repo_id bigint"), P.profile(files, ["repo_id"]))
    got = {r.repo_id: r for r in rows.select("repo_id", P.source_files(F.col("hot")).alias("s"), "profile").collect()}
    assert got[1].s == ["f36.ts", "f37.ts", "f38.ts", "f39.ts"]
    assert got[1].profile.context == [f"f{n}.ts" for n in range(25)]
    assert got[2].s == [] and got[2].profile.n == 0


def test_latest_overlay_at_or_before_the_report(spark):
    from datetime import datetime, timedelta, timezone

    at = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
    rows = [
        (1, "debt", "z oldest", at - timedelta(hours=2)), (1, "debt", "a latest", at), (1, "debt", "a latest", at), (1, "debt", "x too late", at + timedelta(seconds=1)),
        (1, "cost", "tie b", at), (1, "cost", "tie a", at), (2, "debt", "z no time", None), (2, "debt", "a timed", at - timedelta(days=9)),
        (3, "debt", "only later", at + timedelta(hours=1)), (4, "debt", "z no time", None),
    ]
    df = spark.createDataFrame(rows, "repo_id bigint, stage string, payload string, at timestamp")
    for laid in (df, df.repartition(5)):
        got = O.pivot_overlays(laid, "repo_id", ["debt", "cost"], F.lit(at)).collect()
        assert {r.repo_id: (r.debt_payload, r.cost_payload) for r in got} == {
            1: ("a latest", "tie b"), 2: ("a timed", None), 4: ("z no time", None)}
    plain = O.pivot_overlays(df.drop("at"), "repo_id", ["debt"]).collect()
    assert {r.repo_id: r.debt_payload for r in plain}[1] == "z oldest"
    one = O.latest_overlays(df.filter("stage = 'debt'"), "repo_id", F.lit(at)).collect()
    assert {r.repo_id: r.payload for r in one} == {1: "a latest", 2: "a timed", 4: "z no time"}


def test_page_coverage(spark):
    def page(n):
        return json.dumps({"tree": [{"type": "blob", "path": f"f{i}.ts", "size": 1} for i in range(n)]})

    rows = [
        (1, 0, page(3)), (1, 3, page(2)), (1, 5, page(1)),  # whole
        (2, 0, page(3)), (2, 2, page(3)), (2, 0, page(3)),  # overlapping, and a page again
        (3, 0, page(2)), (3, 5, page(1)), (3, 9, page(2)),  # two gaps
        (4, 2, page(2)),  # the first page is missing
        (5, 0, page(10)), (5, 2, page(3)), (5, 10, page(1)),  # one inside another
        (6, 0, '{"message": "empty"}'), (6, 0, None),
    ]
    docs = spark.createDataFrame(rows, "repo_id bigint, first_pos bigint, payload string")
    got = {r.repo_id: tuple(r)[1:] for r in landed.page_coverage(docs.repartition(5)).collect()}
    assert got == {
        1: (3, 6, 0, 0, 0, True), 2: (3, 5, 4, 0, 0, True), 3: (3, 5, 0, 2, 6, False),
        4: (1, 2, 0, 1, 2, False), 5: (3, 11, 3, 0, 0, True)}
    entries = landed.distinct_entries(landed.listing_scan(docs))
    counts = {r.repo_id: r["count"] for r in entries.groupBy("repo_id").count().collect()}
    assert counts == {k: v[1] for k, v in got.items()}
    repos = spark.createDataFrame([repo(1, 200), repo(3, 200)], REPOS)
    files = snapshots.snapshot_files(repos, entries, *[spark.createDataFrame([], s) for s in (BODIES, ARCHIVES)])
    resolved = snapshots.resolve_snapshots(repos, entries, files, spark.createDataFrame([], ATTEMPTS), coverage=landed.page_coverage(docs))
    assert {r.repo_id: r.truncated for r in resolved.collect()} == {1: False, 3: True}
    reviews = R.analyse(resolved, None, F.lit(datetime(2024, 5, 1))).collect()
    assert {r.repo_id: r.review.data.caveat is not None for r in reviews} == {1: False, 3: True}
