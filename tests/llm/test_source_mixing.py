from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from llm.conftest import docs_frame
from pyspark.sql import functions as F

import corpus_pipeline
from debtscope.llm import source_mixing as M


def fill(budget, children):
    """Reference water-filling in fractions: {name: (weight, capacity)} -> {name: share}."""
    from fractions import Fraction

    left, open_, out = Fraction(min(budget, sum(c for _, c in children.values()))), dict(children), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = [n for n, (w, c) in open_.items() if c * total <= w * left]
        if not full:
            return out | {n: left * w / total for n, (w, _) in open_.items()}
        for n in full:
            out[n] = open_.pop(n)[1]
        left = budget - sum(out.values()) if budget < sum(c for _, c in children.values()) else left - sum(children[n][1] for n in full)
    return out


@pytest.mark.parametrize("total", [0, 7, 100, 1000, 1601, 5000])
def test_budgets(spark, total):
    leaves = [("a", "x", 100), ("a", "y", 10), ("a", "z", 500), ("b", "x", 30), ("b", "y", 60), ("c", "x", 101)]
    weights = {"top": {"a": 1, "b": 3, "c": 2}, "leaf": {"x": 5, "y": 1, "z": 1}}
    df = spark.createDataFrame(leaves, "top string, leaf string, tokens long")
    got = {(r.top, r.leaf): r.budget for r in M.budgets(df, ["top", "leaf"], weights, total, 2).collect()}
    tops = defaultdict(int)
    for top, _, n in leaves:
        tops[top] += 2 * n
    share = fill(total, {t: (weights["top"][t], c) for t, c in tops.items()})
    assert sum(got.values()) == min(total, 2 * 801)
    for top in tops:
        mine = sum(v for k, v in got.items() if k[0] == top)
        assert abs(mine - share[top]) < 1
        parts = fill(mine, {l: (weights["leaf"][l], 2 * n) for t, l, n in leaves if t == top})
        assert all(abs(got[top, l] - v) < 1 for l, v in parts.items())
        assert all(got[top, l] <= 2 * n for t, l, n in leaves if t == top)


def test_shortage_stays_among_siblings(spark):
    df = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "top string, leaf string, tokens long")
    got = {(r.top, r.leaf): r.budget for r in M.budgets(df, ["top", "leaf"], {}, 400, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}


HOW = {"levels": {"language": "lang", "source": "source"}, "weights": {"language": {"en": 300}}}


def test_prefixes(spark):
    rows = [(i, "w " * (i % 9 + 1), "en" if i % 3 else "de", f"s{i % 4 // 3}") for i in range(600)]
    out = M.mix(docs_frame(spark, rows), total=3600, max_epochs=3, seed=5, **HOW)
    got = out.select("row.doc_id", "row.epoch", "language", "source", F.col("epoch").alias("e"), "tokens", "tokens_taken").collect()
    assert sum(r.tokens_taken for r in got) == 3600 and all(r["epoch"] == "own epoch" for r in got)
    leaf_docs = defaultdict(set)
    for i, t, lang, src in rows:
        leaf_docs[lang, src].add(i)
    by = defaultdict(lambda: defaultdict(set))
    for r in got:
        by[r.language, r.source][r.e].add(r.doc_id)
    for leaf, epochs in by.items():
        assert all(epochs[e] == leaf_docs[leaf] for e in range(max(epochs)))  # full epochs before the partial one
    cut = [r for r in got if r.tokens_taken != r.tokens]
    assert len(cut) <= len(by) and all(0 < r.tokens_taken < r.tokens for r in cut)
    again = M.mix(docs_frame(spark, rows[::-1]), total=3600, max_epochs=3, seed=5, **HOW)
    assert Counter(r.row.doc_id for r in again.collect()) == Counter(r.doc_id for r in got)
    other = M.mix(docs_frame(spark, rows), total=3600, max_epochs=3, seed=6, **HOW)
    assert Counter(r.row.doc_id for r in other.collect()) != Counter(r.doc_id for r in got)


def test_edges(spark, edge_docs, no_docs):
    every = M.mix(edge_docs, total=10**12, max_epochs=1, **HOW)
    assert every.count() == sum(1 for r in edge_docs.select("text").collect() if (r.text or "").split()) + empty_taken(every)
    assert {r.source for r in every.select("source").collect()} >= {"src1", "src2", "src3"}
    assert M.mix(no_docs, total=100, **HOW).count() == 0
    none = M.mix(edge_docs, total=0, **HOW)
    assert none.count() == 0
    assert corpus_pipeline.mixing(spark, edge_docs, "").columns == edge_docs.columns


def empty_taken(df):
    return df.filter("tokens = 0").count()


def test_native(edge_docs):
    plan = M.mix(edge_docs, total=500, **HOW)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_weight_of_zero_switches_off(spark):
    leaves = [("a", "x", 100), ("a", "y", 100), ("b", "x", 100), ("b", "y", 50), ("c", "x", 70)]
    df = spark.createDataFrame(leaves, "top string, leaf string, tokens long")
    def got(weights, total):
        return {(r.top, r.leaf): r.budget for r in M.budgets(df, ["top", "leaf"], weights, total, 1).collect() if r.budget}
    assert got({"top": {"a": 0, "c": 0}}, 120) == {("b", "x"): 70, ("b", "y"): 50}
    # what lies below a node that is off is no capacity of its parent: the rest goes to the parent's siblings
    assert got({"leaf": {"y": 0}}, 260) == {("a", "x"): 95, ("b", "x"): 95, ("c", "x"): 70}
    assert got({"top": {"a": 0, "b": 0, "c": 0}}, 100) == {}
    assert got({"top": {"a": -5}}, 1000) == {("b", "x"): 100, ("b", "y"): 50, ("c", "x"): 70}
    docs = docs_frame(spark, [(i, "w " * 5, "en" if i % 2 else "de", "s") for i in range(100)])
    out = M.mix(docs, levels={"language": "lang"}, weights={"language": {"en": 100, "de": 0}}, total=60)
    assert {r.language for r in out.collect()} == {"en"} and out.agg(F.sum("tokens_taken")).first()[0] == 60


@pytest.mark.parametrize("budget", [13, 100, 333, 600])
def test_repeated_and_missing_ids_hit_the_budget(spark, budget):
    rows = [(5, "one two three four five six seven eight nine ten")] * 2 + [(None, "a b c")] * 40 + [(None, f"x y z{i % 7}") for i in range(60)]
    rows += [(i % 9, "same words again") for i in range(45)] + [(3, None), (None, "")]
    docs = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    for seed in (1, 2, 3, 4):
        out = M.mix(docs, levels={"language": "lang"}, weights={}, total=budget, max_epochs=1, seed=seed)
        got = out.select("row.doc_id", "row.text", "tokens", "tokens_taken").collect()
        capacity = sum(len((t or "").split()) for _, t in rows)
        assert sum(r.tokens_taken for r in got) == min(budget, capacity)
        assert all(0 <= r.tokens_taken <= r.tokens for r in got)
        assert sum(0 < r.tokens_taken < r.tokens for r in got) <= 1
        assert not Counter((r.doc_id, r.text) for r in got) - Counter(rows)


def test_selection_by_sorting(spark):
    """The prefix that a plain sort of each leaf's epochs gives."""
    rows = [(i, "w " * (i % 6), "en" if i % 3 else "de", "s") for i in range(200)] + [(7, "other text", "en", "s")]
    docs = docs_frame(spark, rows)
    keyed = docs.withColumn("doc_digest", F.xxhash64("text"))
    for budget, epochs in ((90, 1), (700, 2), (2000, 3)):
        out = M.mix(docs, levels={"language": "lang"}, weights={"language": {"en": 200}}, total=budget, max_epochs=epochs, seed=9)
        got = Counter()
        for r in out.select("language", "row.doc_id", "row.text", "tokens_taken", "epoch").collect():
            got[r.language, r.doc_id, r.text] += r.tokens_taken
        sizes = {lang: sum(len(t.split()) for _, t, l, _ in rows if l == lang) for lang in ("en", "de")}
        share = fill(budget, {lang: ((200 if lang == "en" else 100), sizes[lang] * epochs) for lang in sizes})
        for lang in sizes:
            mine = sum(n for k, n in got.items() if k[0] == lang)
            assert abs(mine - share[lang]) < 1
            full, left = divmod(mine, sizes[lang])
            want = Counter({(lang, i, t): full * len(t.split()) for i, t, l, _ in rows if l == lang})
            order = keyed.filter(F.col("lang") == lang).orderBy(
                F.xxhash64(F.lit(9), F.lit(full).cast("long"), F.col("doc_id"), F.col("doc_digest")), "doc_id")
            for r in order.select("doc_id", "text").collect():
                take = min(left, len(r.text.split()))
                want[lang, r.doc_id, r.text] += take
                left -= take
            assert +got.__class__({k: n for k, n in got.items() if k[0] == lang}) == +want


def test_null_level_and_its_name(spark):
    docs = docs_frame(spark, [(1, "a", None, "s"), (2, "b", "(null)", "s"), (3, "c", "((null))", "s"), (4, "d", "en", "s")])
    out = M.mix(docs, levels={"language": "lang"}, weights={}, total=100, max_epochs=1)
    assert {r.doc_id: r.language for r in out.select("row.doc_id", "language").collect()} == {1: "(null)", 2: "((null))", 3: "(((null)))", 4: "en"}
