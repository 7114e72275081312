"""Run registered queries next to their SQL and report every difference."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cut = [tuple(row[i] for i in order) for row in rows]
    return sorted(cut, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple], dict]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    return sorted(columns), _rows(columns, result.fetchall()), types


SPARK_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def difference(spark, con, sf_dir: str, run, sql: str) -> str | None:
    df = run(spark, sf_dir)
    got_columns, got = spark_rows(df)
    want_columns, want, types = duck_rows(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    wrong = {n: (t, types[n]) for n, t in df.dtypes if SPARK_TYPES.get(t) != types[n]}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            parts = [(n, x, y) for n, x, y in zip(got_columns, a, b) if x != y]
            return f"first difference {parts[:3]} in {dict(zip(got_columns, a))}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from debtscope.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    runs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or runs:
        start = time.time()
        try:
            found = difference(spark, con, sf_dir, runs[name], sqls[name]) if name in sqls else "no SQL"
        except Exception as error:  # noqa: BLE001 - report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'BAD '} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
