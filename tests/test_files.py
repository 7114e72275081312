"""M1-M10 and the path filters, on fixed vectors and against plain Python."""

from __future__ import annotations

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope.functions import files as X




def test_line_count(evaluate):
    texts = ["", "a", "a\n", "a\r\nb", "a\rb", "\n\n"]
    assert evaluate(X.line_count(F.col("c")), [(t,) for t in texts], "c string") == [1, 1, 2, 2, 1, 3]


def test_marker_count(evaluate):
    texts = ["TODO", "todoList hackathon FixMe", "t o d o", "HACK", "TODOTODO", ""]
    assert evaluate(X.marker_count(F.col("c")), [(t,) for t in texts], "c string") == [1, 3, 0, 0, 2, 0]


def test_function_count(evaluate):
    texts = [
        "function a() {}",
        "function a",
        "function () {}",
        "x => { y }",
        "x =>\n\t{ y }",
        "x => y",
        "def f(): pass",
        "func f() {}",
        "myfunction b",
        "Function a",
        "function\x0bx",
    ]
    want = [1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 1]
    assert evaluate(X.function_count(F.col("c")), [(t,) for t in texts], "c string") == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.lists(
            st.sampled_from(
                ["TODO", "fixme", "HaCk", "ha", "ck", "function", " ", "\n", "\r\n", "f", "=>", "{", "=", ">",
                 "name", "é", "K", "　", "todo"]
            ),
            max_size=30,
        ).map("".join),
        min_size=40,
        max_size=60,
    )
)
def test_counts_like_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    got = df.select("id", X.line_count(F.col("c")), X.marker_count(F.col("c")), X.function_count(F.col("c"))).collect()
    for i, lines, markers, functions in got:
        assert lines == texts[i].count("\n") + 1
        assert markers == len(re.findall("(?ai)TODO|FIXME|HACK", texts[i]))
        assert functions == len(re.findall("(?a)" + C.FUNCTIONS, texts[i]))


@pytest.mark.parametrize(
    ("lines", "markers", "functions", "score"),
    [
        (41, 1, 40, 100),  # 5.125 + 8 + 96 = 109.125, capped
        (1, 0, 0, 0),
        (4, 0, 0, 1),  # 0.5 rounds up
        (12, 0, 0, 2),  # 1.5 rounds up
        (120, 0, 8, 15),
        (124, 0, 8, 16),  # 15.5
        (1, 1, 9, 11),
        (800, 0, 0, 100),
    ],
)
def test_debt_score(evaluate, lines, markers, functions, score):
    column = X.debt_score(F.col("a"), F.col("b"), F.col("d"))
    assert evaluate(column, [(lines, markers, functions)], "a int, b int, d int") == [score]
    plain = min(100, math.floor(lines / 8 + markers * 8 + max(0, functions - 8) * 3 + 0.5))
    assert plain == score


def test_signals(evaluate):
    column = X.signals(F.col("a"), F.col("b"), F.col("d"))
    rows = [(251, 2, 9), (250, 0, 8), (1, 1, 1)]
    assert evaluate(column, rows, "a int, b int, d int") == [
        ["large file", "2 maintenance markers", "high function density"],
        [],
        ["1 maintenance markers"],
    ]


def test_paths(evaluate):
    paths = ["src/main.ts", "a.b.TSX", "README.md", "noext", "x/constructor", "/lead.py", "api/server.py",
             "src/Routes.js", "lib/mainly.ts", "main.go", ".ts", "d/.py", "a/b.ts\n"]
    rows = [(p,) for p in paths]
    assert evaluate(X.is_code_file(F.col("c")), rows, "c string") == [
        True, True, False, False, False, True, True, True, True, True, True, True, False]
    assert evaluate(X.file_language(F.col("c")), rows, "c string")[:7] == [
        "TypeScript", "TypeScript", "Other", "Other", "Other", "Python", "Python"]
    assert evaluate(X.path_root(F.col("c")), rows, "c string")[:7] == [
        "src", "a.b.TSX", "README.md", "noext", "x", None, "api"]
    assert evaluate(X.is_entry_point(F.col("c")), rows, "c string") == [
        True, False, False, False, False, False, True, True, False, False, False, False, False]
    assert evaluate(X.module_name(F.col("c")), rows, "c string")[:12] == [
        "main", "a.b", "README", "noext", "constructor", "lead", "server", "Routes", "mainly", "main",
        "Feature", "Feature"]


def test_layer_violation(evaluate):
    paths = ["components/UserService.ts", "component/x/service", "components/service", "services/x.tsx",
             "Service/deep/y.TSX", "services/x.ts", "componentservice"]
    got = evaluate(X.is_layer_violation(F.col("c")), [(p,) for p in paths], "c string")
    assert got == [True, True, False, True, True, False, False]


def test_framework_rules(evaluate):
    paths = ["webapp/x.ts", "next.config.js", "vite.config.ts", "src/main.jsx", "src/main.ts", "package.json",
             "pyproject/a.py", "requirements.txt", "NEXT.config.js", "lib/a.go"]
    rules = evaluate(X.framework_rule(F.col("c")), [(p,) for p in paths], "c string")
    assert rules == [1, 1, 2, 2, None, 3, 4, 4, None, None]
    names = evaluate(X.framework_name(F.col("c")), [(1,), (2,), (3,), (4,), (None,)], "c int")
    assert names == ["Next.js", "React + Vite", "Node.js / JavaScript", "Python", "Polyglot application"]


def test_truncate(evaluate):
    texts = ["abc", "é" * 5, "abcdef", None]
    assert evaluate(X.truncate(F.col("c"), 4), [(t,) for t in texts], "c string") == ["abc", "éééé", "abcd", None]
