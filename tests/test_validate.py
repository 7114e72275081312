"""V1-V4."""

from __future__ import annotations

from pyspark.sql import functions as F

from debtscope.functions import urls
from debtscope.operators import validate

ACCEPTED = {
    "https://github.com/acme/tool-kit": ("acme", "tool-kit"),
    "https://github.com/a.b/c_d/": ("a.b", "c_d"),
    "https://github.com/a/b.git": ("a", "b"),
    "https://github.com/a/b?tab=x/y": ("a", "b"),
    "https://github.com/a/b#L1": ("a", "b"),
    "HTTPS://GitHub.COM/A/b": ("A", "b"),
    "https://github.com:443/a/b": ("a", "b"),
    "https://github.com:/a/b": ("a", "b"),
    "https://me:pw@github.com/a/b": ("a", "b"),
    "  https://github.com/a/b \n": ("a", "b"),
    "https://github.com/a/b.git.git": ("a", "b.git"),
}
REJECTED = {
    None: "missing",
    "  ": "missing",
    "github.com/a/b": "not https",
    "http://github.com/a/b": "not https",
    "https://example.com/a/b": "other host",
    "https://github.com.example.com/a/b": "other host",
    "https://github.com@example.com/a/b": "other host",
    "https://notgithub.com/a/b": "other host",
    "https://github.com:99999/a/b": "bad port",
    "https://github.com/a/b/issues": "not owner/repository",
    "https://github.com/a": "not owner/repository",
    "https://github.com": "not owner/repository",
    "https://github.com/a/b//": "not owner/repository",
    "https://github.com/a b/c": "not owner/repository",
    "https://github.com/../b": "dot segment",
    "https://github.com/a/.git": "empty repository",
}


def test_urls(spark):
    rows = [(u,) for u in [*ACCEPTED, *REJECTED]]
    df = spark.createDataFrame(rows, "url string")
    verdicts = {r.url: r.reject_reason for r in validate.validate_urls(df).collect()}
    assert verdicts == {**dict.fromkeys(ACCEPTED), **REJECTED}
    parsed = {r.url: (r.owner, r.repository, r.canonical_url) for r in validate.parse_urls(df).collect()}
    assert parsed == {u: (o, r, f"https://github.com/{o}/{r}") for u, (o, r) in ACCEPTED.items()}


def test_ids(evaluate):
    ids = ["6fa459ea-ee8a-3ca4-894e-db77e160355e", "6FA459EA-EE8A-3CA4-894E-DB77E160355E", "x", None,
           "6fa459ea-ee8a-3ca4-894e-db77e160355e\n", "6fa459eaee8a3ca4894edb77e160355e"]
    reasons = evaluate(urls.id_reject_reason(F.col("a")), [(i,) for i in ids], "a string")
    assert [r is None for r in reasons] == [True, True, False, False, False, False]


def test_questions(spark):
    texts = ["abc", "ab", "  ab ", " \t abc ﻿\n", None, "x" * 500, "x" * 501, " " + "x" * 500 + " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, question string")
    rows = sorted(validate.validate_questions(df).collect())
    assert [r.reject_reason for r in rows] == [
        None, "too short", "too short", None, "too short", None, "too long", None]
    assert rows[3].trimmed == "abc"
