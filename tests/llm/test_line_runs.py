from __future__ import annotations

import re

from llm.conftest import docs_frame, prose
from pyspark.sql import functions as F

from debtscope.llm import line_runs as L


def key_of(line):
    stripped = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in stripped)


def brute(rows, min_docs=5, min_chars=40):
    """Sorted (id, lines, dropped, kept) by a dictionary of all keys."""
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= min_chars:
                holders.setdefault(key_of(line), set()).add(L.NO_ID if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = L.NO_ID if i is None else i
        stay = [x for x in lines if len(holders.get(key_of(x), ())) < min_docs or max(holders[key_of(x)]) == own]
        out.append((i, len(lines), len(lines) - len(stay), None if text is None else "\n".join(stay)))
    return sorted(out, key=str)


def found(df):
    rows = df.select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    return sorted((tuple(r) for r in rows), key=str)


FOOTER = "Copyright notice: all of these pages are offered as they are."
MENU = "  \tHome | News | Weather | Sports | Ä Ö Ü | About us\x0b"


def shared_rows():
    rows = []
    for k in range(60):
        lines = [prose(12, k), FOOTER if k % 2 else FOOTER.upper() + "\r", prose(15, k % 9)]
        if k % 3 == 0:
            lines.insert(1, MENU)
        if k % 10 == 0:
            lines += [FOOTER, FOOTER]  # several copies in one document
        rows.append((k * 7 % 61, "\n".join(lines)))
    rows += [(k, prose(15, 40)) for k in (70, 71, 72, 73)]  # in four documents only
    rows += [(80, prose(15, 41) + f"\nversion {k}") for k in range(6)]  # six rows, one document
    rows += [(None, prose(15, 42)) for _ in range(9)]
    rows += [(k, "ß" * 39 + "\n" + "é" * 40) for k in range(90, 97)]  # code points count, not bytes
    return rows


def test_whole_table(spark, edge_rows):
    rows = [(i, t) for i, t, _, _ in edge_rows] + shared_rows()
    df = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    want = brute(rows)
    assert sum(r[2] for r in want) > 60
    for batches, fanout in ((1, 2), (4, 2), (5, 3), (7, 100)):
        assert found(L.dedup(df, batches=batches, fanout=fanout)) == want
    # the join of hot keys: all of them, and none
    assert found(L.dedup(df, hot_keys=10_000)) == want
    assert found(L.dedup(df, hot_keys=1)) == want
    assert found(L.dedup(df, min_docs=2, min_chars=3)) == brute(rows, 2, 3)


def test_carries_columns_and_empty_table(spark, edge_docs, no_docs):
    got = L.dedup(edge_docs)
    assert got.select("row.*").columns == edge_docs.columns
    assert L.dedup(no_docs).count() == 0


def test_runs_are_levelled_and_sorted(spark):
    rows = shared_rows()
    df = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    lines, n = L.scan(df, batches=4)
    runs, seen = L.LineRuns(spark, fanout=2, buckets=3), []
    for batch in range(n):
        part = lines.filter(F.col("batch") == batch)
        before = {r.a for run in runs.runs() for r in run.filter("n >= 5").collect()}
        fresh = runs.fresh(part.groupBy(*L.KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("owner")))
        assert not before & {r.a for r in fresh.collect()}  # settled keys leave
        runs.add(part)
        seen.append([len(level) for level in runs.levels])
    assert seen == [[1], [0, 1], [1, 1], [0, 0, 1]]
    (run,) = runs.runs()
    keys = [tuple(r) for r in run.select(*L.KEY).collect()]
    assert len(keys) == len(set(keys))


def test_runs_in_any_order(spark):
    """Oldest batch first: owners move on, counts add up."""
    rows = shared_rows()
    df = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    lines, n = L.scan(df, batches=4)
    runs = L.LineRuns(spark, fanout=3)
    for batch in reversed(range(n)):
        runs.add(lines.filter(F.col("batch") == batch))
    want = lines.groupBy(*L.KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("owner")).filter("n >= 5")
    assert sorted(map(tuple, runs.frequent().select(*L.KEY, "owner").collect())) == sorted(map(tuple, want.select(*L.KEY, "owner").collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_run_is_exchanged(spark):
    df = docs_frame(spark, [(i, t, "en", "s") for i, t in shared_rows()])
    lines, n = L.scan(df, batches=3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        runs = L.LineRuns(spark, fanout=9)
        for batch in range(n):
            runs.add(lines.filter(F.col("batch") == batch))
        merge = plan_of(runs.frequent())
        batch = lines.groupBy(*L.KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("owner"))
        own, anti = plan_of(batch), plan_of(runs.fresh(batch))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "FullOuter" in merge and "Exchange" not in merge
    # the batch itself is shuffled for its counts, the runs are not
    assert anti.count("LeftAnti") == n and anti.count("Exchange") == own.count("Exchange")
