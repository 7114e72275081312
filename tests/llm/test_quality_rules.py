from __future__ import annotations

import re
from collections import Counter

from llm.conftest import docs_frame, prose

from debtscope.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, edge_rows):
    repeats = prose(9, 1)
    rows = edge_rows + [
        (20, " ".join([repeats, "x y", repeats, "z", repeats]), "en", "s"),
        (21, "one two\none two\n \n\nthree # * <b>\none two", "en", "s"),
        (22, "w " * 30, "en", "s"),
    ]
    got = Q.ledger(docs_frame(spark, rows)).select("row.doc_id", "row.tokens", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits")
    got = sorted(map(tuple, got.collect()), key=str)
    want = sorted(((i, "own tokens", *brute(t)) for i, t, _, _ in rows), key=str)
    assert [g[:-1] for g in got] == want
    assert {g[0]: g[-1] & Q.BASE for g in got}[22] == Q.BITS["repeated_windows"]
    assert {g[0]: g[-1] for g in got}[2] == Q.BITS["few_words"]


def test_policies_and_ablations(spark, edge_docs, no_docs):
    kept = Q.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(kept.select("doc_id").toPandas()["doc_id"].fillna(-1)) == [-1, 1, 5, 5]
    ledger = spark.createDataFrame([(b,) for b in (0, 0, 1, 3, 4, 32)], "fail_bits long")
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in Q.ablations(ledger, "v2").collect()}
    assert got == {"few_words": (2, 1, 4), "repeated_windows": (1, 0, 3), "many_symbols": (1, 1, 4), "duplicate_lines": (0, 0, 3)}
    assert ledger.filter(Q.passes("v1")).count() == 4 and ledger.filter(Q.passes("v3")).count() == 2
    assert Q.keep(no_docs).count() == 0
    assert all(r.n_failed == 0 for r in Q.ablations(ledger.limit(0)).collect())


def test_native(edge_docs):
    plan = Q.ledger(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_bits_are_appended_only():
    assert list(Q.BITS.values()) == [1 << k for k in range(len(Q.RULES))]
