from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from llm.conftest import CLASHING
from pyspark.sql import functions as F

from debtscope.llm import prefix_trie as P

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows, graft=True):
    """All nodes with dictionaries of whole prefixes."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by_conv[conv].append((turn is not None, turn or 0, turn_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in by_conv.items()}
    whole = own
    if graft:
        whole = {}
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            base = own.get(c - int(abs(c) % 20 * (1 if c >= 0 else -1)), [])
            whole[c] = base[:h] + turns[h:]
    members, last = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        last[tuple(turns)].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len([w for w in node[-1][1].translate({c: 32 for c in range(9, 14)}).split(" ") if w]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * words
    out = []
    for node, convs in members.items():
        ids = ",".join(map(str, sorted(last[node])))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("own") for n in [*CLASHING, "conv", "pos", "depth", "path", "parent"]})


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    for c in range(-25, 130):
        if c % 20 == 0 and c > 60:
            continue  # groups without a first conversation
        for turn in range(rng.randint(1, 7)):
            out.append((c, turn, ("user", "assistant")[turn % 2], rng.choice(["hello", "how are\tyou", "fine  thanks", "Ünï code"])))
    out += [(200 + k, t, "user", f"same {t}") for k in range(40) for t in range(5)]  # copies of one conversation
    out += [(300, t, "user", f"word {t % 3}") for t in range(150)] + [(320, t, "user", f"word {t % 3}") for t in range(140)]
    out += [(7, 0, None, None), (7, None, "user", "no number"), (7, 0, "user", None), (7, 0, None, ""), (8, 1, "user", "x"), (8, 1, "user", "x")]
    out += [(None, 0, "user", "lost"), (350, 0, "user", "word " * 30_000), (351, 0, "us", "erword"), (352, 0, "user", "word")]
    out += [(10_000 + 5000 * k, 0, "user", "far apart") for k in range(30)]  # ends over many blocks
    return out


def test_rebuilt_conversations(spark, rows):
    want = brute(rows)
    assert max(r[1] for r in want) > 100
    assert found(P.conversation_trie(frame(spark, rows), group=20)) == want


@pytest.mark.parametrize(("height", "hot"), [(1, 20_000), (7, 1), (500, 10)])
def test_bands_and_hot_parents(spark, rows, height, hot):
    if height == 1:
        rows = [r for r in rows if r[0] not in (300, 320)]  # a band per depth
    got = P.conversation_trie(frame(spark, rows), height=height, hot_parents=hot)
    assert found(got) == brute(rows, graft=False)


def test_conversation_without_turns(spark):
    # h of 2 is 3, its first conversation is missing: nothing is left of it
    assert zlib.crc32(b"22") % 4 > 0
    rows = [(22, 0, "user", "only turn"), (23, 0, "user", "x"), (23, 1, "user", "y"), (23, 2, "user", "z"), (23, 3, "user", "w")]
    want = brute(rows)
    assert found(P.conversation_trie(frame(spark, rows), group=20)) == want
    assert want[0][3] == 2 and any(r[1] == 0 for r in want)


def test_empty_table(spark):
    assert P.conversation_trie(frame(spark, []), group=20).count() == 0


def test_rows_a_node_explodes_to_are_bounded(spark):
    """A long conversation explodes to its band only: depth * height rows at most, not depth squared."""
    walked = P.steps(frame(spark, [(1, t, "user", str(t)) for t in range(1000)]))
    seen = P.visits(P.starts(walked).unionByName(walked), 32)
    assert seen.agg(F.max(F.length("path")), F.max(F.length("upper"))).first()[:] == (32 * P.DIGEST, 32 * P.DIGEST)
    tree = P.nodes(seen)
    assert tree.filter("length(upper) > 0").count() == 1000 // 32
    totals = {r.key: r.n_leaves for r in P.rollup(tree, 32).collect()}
    assert len(totals) == 1001 and set(totals.values()) == {1}
