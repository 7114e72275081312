from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from llm.conftest import docs_frame, prose

from debtscope.llm import simhash_dedup as S


def brute_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    """{print: root} by comparing all pairs."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def check(rows, got):
    prints = [(i, brute_print(t)) for i, t in rows]
    roots = brute_components(p for _, p in prints)
    least = {}
    for i, p in prints:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    want = sorted((str(i), f"{p:016x}", str(least.get(roots[p]))) for i, p in prints)
    assert sorted((str(r.id), r.fingerprint, str(r.component_id)) for r in got) == want


def found(df):
    return S.near_duplicates(df).select("id", S.hex_digits("fp").alias("fingerprint"), "component_id").collect()


def near_copies(n):
    out = []
    for k in range(n):
        words = prose(300, k % 3 + 1).split()
        words[5 * (k % 50)] = f"changed{k % 7}"
        out.append((100 + k, " ".join(words)))
    return out


def test_whole_table(spark, edge_rows):
    rows = [(i, t) for i, t, _, _ in edge_rows] + near_copies(60) + [(400 + k, "ONE two") for k in range(5)] + [(500, "one TWO"), (501, "Ä b c")]
    df = docs_frame(spark, [(i, t, "en", "s") for i, t in rows])
    check(rows, found(df))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    expected = {r.component_id for r in found(df) if r.component_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(expected)


@pytest.mark.parametrize("thresholds", [[0, 0, 0, 0, 0], [1, 1, 0], [2, 0, 0], [-1, 2, 1], [1, 0, 0, 0], [0, 0, 0, 0, 0, -1]])
def test_every_allocation_finds_all_links(spark, thresholds):
    rng = np.random.default_rng(len(thresholds))
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = {int(c) for c in centres}
    for c in list(prints):
        for d in range(1, 7):
            flips = rng.choice(64, d, replace=False)
            prints.add(c ^ sum(1 << int(b) for b in flips))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    n, parts = len(thresholds), [sum(1 << b for b in range(k, 64, len(thresholds))) for k in range(len(thresholds))]
    edges = [(u % (1 << 64), v % (1 << 64)) for u, v in S.links(df, list(zip(parts, thresholds))).collect()]
    assert sum(thresholds) == 4 - n + 1
    root = {p: p for p in prints}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for u, v in edges:
        root[max(find(u), find(v))] = min(find(u), find(v))
    assert {p: find(p) for p in prints} == brute_components(prints)


def test_large_bucket():
    rng = np.random.default_rng(1)
    own = np.unique(np.r_[rng.integers(0, 1 << 40, 6000, dtype=np.uint64), (np.uint64(1) << rng.integers(0, 40, 400).astype(np.uint64))])
    mask = sum(1 << b for b in range(40, 64))
    touched = {x for a, b in S.bucket_links(own, own[:0], mask, 4) for x in (*a.tolist(), *b.tolist())}
    assert touched == {int(x) for x in own if (np.bitwise_count(own ^ x) <= 4).sum() > 1}


def test_thresholds():
    assert S.allocate([[0, 1, 9, 99]] * 3, 0)[0] == 1 + 1 + 1
    assert S.allocate([[0, 100, 900], [0, 1, 5], [0, 1, 5]], 1) == (10, [-1, 1, 1])
    assert len(S.flips(0b1011, 2)) == 1 + 3 + 3 and set(S.flips(0b1011, 1)) == {0, 1, 2, 8}
    groups = S.group_bits([[50 if a == b else 49 if a // 16 == b // 16 else 25 for b in range(64)] for a in range(64)], 100, 4)
    assert sorted(map(tuple, groups)) == [tuple(range(k, k + 16)) for k in (0, 16, 32, 48)]
    assert S.within([0.5, 0.5], 2) == [0.25, 0.75, 1.0]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in S.components(chain).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_empty(no_docs):
    assert found(no_docs) == [] and S.keep_one(no_docs).count() == 0


def test_probes_give_a_forest():
    """A dense bucket gives about as many edges as fingerprints, and connects the same ones."""
    rng = np.random.default_rng(2)
    flips = [0, *(1 << b for b in range(36)), *((1 << a) | (1 << b) for a in range(36) for b in range(a))]
    base = 0x123456789ABCDEF0
    own = np.array([base ^ f for f in flips], np.uint64)
    probing = np.unique(np.array([base ^ (1 << 60) ^ flips[k] for k in rng.integers(0, len(flips), 60)], np.uint64))
    mask = 0xFFFFFFF000000000
    edges = [(int(a), int(b)) for x, y in S.bucket_links(own, probing, mask, 4) for a, b in zip(x, y)]
    assert len(edges) <= len(own) + len(probing)
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    root = {int(v): int(v) for v in [*own, *probing]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_components([int(v) for v in [*own, *probing]])
    assert len({find(v) for v in root}) == len(set(want.values())) == 1


def test_keep_one_of_rows_that_differ_elsewhere(spark):
    text = prose(80)
    rows = [(1, text, lang, "s") for lang in ("fr", "de", "es")] + [(9, text, "en", "s"), (2, prose(70, 9), "en", "s")]
    for n in (1, 4):
        got = sorted((r.doc_id, r.lang) for r in S.keep_one(docs_frame(spark, rows).repartition(n)).collect())
        assert got == [(1, "de"), (2, "en")]


@pytest.mark.parametrize("large", [1, 20_000])
def test_ids_of_large_components(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE_COMPONENTS", large)
    rows = near_copies(40) + [(900 + k, prose(100, k)) for k in range(5)]
    check(rows, found(docs_frame(spark, [(i, t, "en", "s") for i, t in rows])))
