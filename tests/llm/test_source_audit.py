from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from llm.conftest import docs_frame

from debtscope.llm import source_audit as A


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_df=3, top=200):
    """Every kept term of every pair, in plain integers."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or "")))
        groups.add((lang, source))
        df[lang].update(terms.keys())
        counts[lang, source].update(terms)
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_df)
        total = Counter()
        for g in groups:
            if g[0] == lang:
                total.update({t: counts[g][t] for t in kept})

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        part = lambda p, q: (p - q) ** 2 // q
        p = {s: shares(counts[lang, s]) for g, s in groups if g == lang}
        q = shares(total)
        for s in p:
            pairs = [(sum(part(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(part(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for kind, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, kind, item, value, k) for k, (value, item) in enumerate(ordered, 1) if kind == "pair" or k <= top]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)] + ["Straße", "ÉTÉ", "été", "naïve x", "日本", "a🙂b"]
    for k in range(160):
        source = "hot" if k % 3 == 0 else f"src{k % 7}"
        out.append((" ".join(rng.choice(words[: 40 + 60 * (k % 7)]) for _ in range(rng.randint(0, 80))), ("en", "de")[k % 4 == 0], source))
    out += [("same again " * 3, "en", "hot")] * 5  # repeated rows
    out += [("", "en", "silent"), (None, "en", "none"), ("1 2 3", "fr", "digits"), ("One word", "fr", None), ("words", None, "src1"), (None, None, None)]
    out += [("rare rarer", "only", "x"), ("rare rarest", "only", "y")]  # a language without kept terms
    out += [(" ".join(["tie"] * 4), "en", f"Z{k}") for k in range(3)]
    return out


def frame(spark, rows):
    return docs_frame(spark, [(k, t, lang, source) for k, (t, lang, source) in enumerate(rows)])


@pytest.mark.parametrize("block_terms", [A.BLOCK_TERMS, 100])
def test_whole_table(spark, rows, block_terms):
    assert found(A.audit(frame(spark, rows), block_terms=block_terms)) == brute(rows)


def test_other_settings(spark, rows):
    assert found(A.audit(frame(spark, rows), min_df=1, top=3)) == brute(rows, 1, 3)


def test_edge_rows(spark, edge_rows, edge_docs):
    assert found(A.audit(edge_docs, min_df=1)) == brute([(t, lang, source) for _, t, lang, source in edge_rows], 1)


def test_empty_table(spark, no_docs):
    assert A.audit(no_docs).count() == 0


def test_shared_terms_by_pieces(spark, monkeypatch, rows):
    """Sums sent on in small pieces, terms that go on from batch to batch."""
    monkeypatch.setattr(A, "FLUSH", 5)
    monkeypatch.setattr(A, "PAIR_ROWS", 200)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(A.audit(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_large_counts_stay_exact(spark):
    big = 10**13
    df = spark.createDataFrame([(big, 3 * big, 10**9)], "n long, total long, kept long")
    p = df.select(A.share(df.n, df.total, df.kept).alias("p")).first().p
    assert p == 1 + 10**9 * (big + 1) // (3 * big + 10**9)


def stretches(rows, blocks, min_df):
    """Rows that a task sends on for (lang, source, text) rows."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["lang", "source", "text"])
    return [row for out in A._tokens(blocks, min_df)(iter([batch])) for row in out.to_pylist()]


def test_joined_documents_keep_counts_and_presence(monkeypatch):
    """Each count comes back from its bits; a term stands in as many presence rows as documents, or min_df."""
    texts = ["word " * 37 + "other", "word", "word other", "word", "x " * 5]
    rows = [("en", f"s{k % 2}", t) for k, t in enumerate(texts)] * 30
    for held in (A.HELD_TERMS, 0):
        monkeypatch.setattr(A, "HELD_TERMS", held)
        got = stretches(rows, 2, 3)
        counts = Counter()
        for row in got:
            for term in (row["terms_0"] or []) + (row["terms_1"] or []):
                counts[row["lang"], row["source"], row["weight"] > 0, term] += max(1, row["weight"])
        plain = Counter(("en", s, True, "en\x00" + w) for _, s, t in rows for w in t.split())
        assert Counter({k: n for k, n in counts.items() if k[2]}) == plain
        assert all(n >= 3 for k, n in counts.items() if not k[2])
    monkeypatch.undo()
    assert len(stretches(rows, 2, 3)) < 20  # not a row for each document
    few = stretches([("en", "s", "a b"), ("en", "t", "a")], 1, 3)
    assert Counter(t for r in few if not r["weight"] for t in r["terms_0"]) == {"en\x00a": 2, "en\x00b": 1}


def test_stretches_cut_short(spark, monkeypatch, rows):
    monkeypatch.setattr(A, "HELD_TERMS", 50)
    monkeypatch.setattr(A, "ROW_TERMS", 7)
    assert found(A.audit(frame(spark, rows), block_terms=100)) == brute(rows)


def test_a_group_is_joined_over_the_whole_table(spark, monkeypatch):
    """Groups that alternate in the table give about a row each, not one for each part of the table."""
    rows = [(f"common w{chr(97 + k % 20)}", "en", f"s{k % 20}") for k in range(400)]
    seen, sums = [], A.sums
    monkeypatch.setattr(A, "sums", lambda v: seen.append(v.filter("weight > 0").groupBy("group").count().collect()) or sums(v))
    counts = Counter()
    groups, counted, _ = A.term_counts(frame(spark, rows).repartition(4), 1)
    for r in counted.join(groups, "group").collect():
        counts[r["source"]] += r["n"]
    assert counts == {f"s{k}": 40 for k in range(20)}
    # 20 documents of each group; the bits of 20 are two, a group on a border of tasks has more
    assert sum(r["count"] for r in seen[0]) <= 20 * 2 + 4 * 5


def test_large_groups_are_cut_among_tasks(spark):
    rows = [(f"text {k}", "en", "hot" if k % 10 else "other") for k in range(2000)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        dealt = A.by_group(frame(spark, rows).select("lang", "source", "text"))
        sizes = dealt.rdd.mapPartitions(lambda it: [sum(1 for r in it if r["source"] == "hot")]).collect()
    finally:
        spark.conf.unset(coalesce)
    assert sum(sizes) == 1800 and max(sizes) < 900


def test_terms_cut_as_arrays(monkeypatch):
    """Texts that touch, slices, capitals beyond ASCII, parts of a few bytes."""
    import pyarrow as pa

    texts = ["ab", "cd", "", "É été ÉTÉ", "x1y[z`a{b\x7fc@D", "日本 🙂é\x80\x85", "\x00A\x00", "", "tail"] * 7
    want = Counter((str(k % 2), w) for k, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["x"] + ["l"] * len(texts)), pa.array(["x"] + [str(k % 2) for k in range(len(texts))]), pa.array(["skipped", *texts])],
        names=["lang", "source", "text"]).slice(1)
    for name, size in (("CHUNK_BYTES", A.CHUNK_BYTES), ("CHUNK_BYTES", 5), ("HELD_BYTES", 0), ("ROW_TERMS", 1)):
        monkeypatch.setattr(A, name, size)
        got = Counter()
        for row in (r for out in A._tokens(3, 3)(iter([batch])) for r in out.to_pylist()):
            for term in row["terms_0"] + row["terms_1"] + row["terms_2"]:
                if row["weight"]:
                    got[row["source"], term.removeprefix("l\x00")] += row["weight"]
        assert got == want


def test_vocabularies_stay_small(spark):
    """Millions of different terms are not one vocabulary in the driver."""
    letters = "translate(cast(id * 150 + k as string), '0123456789', 'abcdefghij')"
    texts = spark.range(16_000).selectExpr("'en' as lang", f"array_join(transform(sequence(0, 149), k -> {letters}), ' ') as text")
    assert A.n_blocks(texts, A.BLOCK_TERMS) > 1  # 2,400,000


def test_plans_do_not_grow_with_blocks(spark, monkeypatch, rows):
    """All blocks are read as one folder, and no block joins the groups again."""
    fitted, vectors = [], A.vectors
    monkeypatch.setattr(A, "vectors", lambda block, min_df: fitted.append(block) or vectors(block, min_df))
    _, counts, names = A.term_counts(frame(spark, rows), block_terms=100)
    assert len(fitted) > 2
    for df in (counts, names, *fitted):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "Join" not in plan
