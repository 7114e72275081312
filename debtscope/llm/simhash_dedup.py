"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint has 64 bits; two documents are linked if at most ``distance`` bits differ.
The bits are grouped into m partitions, correlated bits together, and partition i gets a
threshold t_i of -1 or more with sum(t_i) = distance - m + 1.  Two linked fingerprints then
differ by at most t_i bits in some partition i, so it is enough to look up, in each
partition, the keys at up to t_i flipped bits, and to verify what meets there.  Thresholds
come from a dynamic programme over estimated costs: probes, and pairs to verify, which are
the exact number of equal pairs in the partition scaled by the bits' own statistics.

Only different fingerprints are compared.  A bucket answers with a spanning forest of its
links, so no pairs are listed; forests are joined by the large-star, small-star algorithm
over tables in the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
a component's id is its smallest document id, null if it has none; repeated rows are
answered one by one; only the id and text columns are read, so others cannot clash; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.llm.common import materialize, packed, whole_text
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

BITS, SHINGLE, SEED, DISTANCE = 64, 4, 42, 4
#: Seconds of one probe row and of verifying one pair, for the cost estimates.
PROBE_S, PAIR_S = 2e-6, 5e-9
#: Components with more than one in so many of all fingerprints are broadcast for their ids.
LARGE_COMPONENTS = 20_000
#: Removed documents up to this number go to every executor when rows are filtered.
BROADCAST_KEYS = 500_000


# --- fingerprints -------------------------------------------------------------
def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all word shingles, as a signed number."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    ones, n = np.zeros(BITS, np.int64), max(1, len(words) - size + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, 65_536):
        part = words[at:at + 65_536 + size - 1] if n > 1 else words
        shingles = map(join, zip(*(part[k:] for k in range(size)))) if n > 1 else [join(part)]
        hashes = np.array([digest(s, SEED) for s in shingles], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    import pyarrow as pa

    for batch in batches:
        prints = [fingerprint(x.as_py()) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], names=["id", "fp", "digest"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, digest) of every document, written once; digest tells texts apart."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"), F.md5(whole_text(text_col)).alias("digest"))
    return materialize(texts.mapInArrow(_fingerprints, "id long, fp long, digest string"), "prints")


# --- partitions and thresholds ------------------------------------------------
def bit_counts(prints: DataFrame) -> list[list[int]]:
    """How often two bits are both set, over all rows: 64 x 64 sums, whatever the input."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
        at = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "n"])

    rows = prints.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    table = [[0] * BITS for _ in range(BITS)]
    for row in rows:
        table[row.at // BITS][row.at % BITS] = row.n
    return table


def group_bits(both: list[list[int]], n: int, parts: int) -> list[list[int]]:
    """Partitions of near equal size: from the most correlated bit left, add its closest."""
    p = [both[b][b] / max(n, 1) for b in range(BITS)]

    def correlation(a: int, b: int) -> float:
        spread = math.sqrt(p[a] * (1 - p[a]) * p[b] * (1 - p[b]))
        return abs(both[a][b] / max(n, 1) - p[a] * p[b]) / spread if spread > 0 else 0.0

    close = [[correlation(a, b) if a != b else 0.0 for b in range(BITS)] for a in range(BITS)]
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        group = [max(sorted(left), key=lambda a: sum(close[a][b] for b in left))]
        left.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(left), key=lambda b: sum(close[a][b] for a in group)))
            left.discard(group[-1])
        groups.append(sorted(group))
    return groups


def within(differ: list[float], most: int) -> list[float]:
    """P(at most t of the bits differ), t = 0..most, for two random documents."""
    exact = [1.0] + [0.0] * most
    for d in differ:
        for t in range(most, -1, -1):
            exact[t] = exact[t] * (1 - d) + (exact[t - 1] * d if t else 0)
    return [sum(exact[: t + 1]) for t in range(most + 1)]


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with the given sum; ``costs[i][t + 1]`` is for t = -1, 0, ..."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                option = (cost + more, [*chosen, k - 1])
                if spent + k - 1 not in step or option < step[spent + k - 1]:
                    step[spent + k - 1] = option
        best = step
    return best[total]


def plan(prints: DataFrame, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions for these distinct fingerprints."""
    n = prints.count()
    both = bit_counts(prints)
    differ = [2 * (both[b][b] / max(n, 1)) * (1 - both[b][b] / max(n, 1)) for b in range(BITS)]

    def costs(groups, equal):
        out = []
        for group, pairs in zip(groups, equal):
            near = within([differ[b] for b in group], distance)
            probes = [sum(math.comb(len(group), j) for j in range(t + 1)) for t in range(distance + 1)]
            scale = [pairs * x / near[0] if near[0] > 0 else pairs for x in near]
            out.append([0.0] + [PROBE_S * n * q + PAIR_S * s for q, s in zip(probes, scale)])
        return out

    def guess(groups):
        return [n * n / 2 * within([differ[b] for b in g], 0)[0] for g in groups]

    options = {m: group_bits(both, n, m) for m in range(3, distance + 3)}
    groups = min(options.values(), key=lambda g: allocate(costs(g, guess(g)), distance - len(g) + 1)[0])
    masks = [sum(1 << b for b in g) for g in groups]
    keys = prints.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for i, m in enumerate(masks)
    ])).alias("k"))
    sizes = keys.groupBy("k").agg(F.count("*").cast("double").alias("n"))
    equal = {r.part: r.pairs for r in sizes.groupBy("k.part").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    chosen = allocate(costs(groups, [equal.get(i, 0.0) for i in range(len(groups))]), distance - len(groups) + 1)[1]
    return list(zip(masks, chosen))


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


# --- probing and verifying ----------------------------------------------------
def flips(mask: int, most: int) -> list[int]:
    """All ways to flip up to ``most`` bits of a mask, none first."""
    bits, found, level = [1 << b for b in range(BITS) if mask >> b & 1], [0], [(0, 0)]
    for _ in range(most):
        level = [(v | bits[k], k + 1) for v, at in level for k in range(at, len(bits))]
        found += [v for v, _ in level]
    return found


def _key_struct(part: int, mask: int):
    return lambda flip: F.struct(
        F.lit(part).alias("part"),
        F.col("fp").bitwiseAND(_signed(mask)).bitwiseXOR(flip).alias("key"),
        (flip != 0).alias("probe"),
    )


def probes(prints: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(part, key, probe, fp): each fingerprint under its own key and the flipped ones."""
    sets = []
    for part, (mask, t) in enumerate(parts):
        if t >= 0:
            masks = F.array(*[_signed(v) for v in flips(mask, t)])
            sets.append(F.transform(masks, _key_struct(part, mask)))
    rows = prints.select("fp", F.explode(F.concat(*sets)).alias("k"))
    return rows.select("k.part", "k.key", "k.probe", "fp")


def _near(a, b, distance: int):
    import numpy as np

    return np.bitwise_count(a ^ b) <= distance


def link_members(fps, distance: int):
    """Root (a place in ``fps``) of each fingerprint, links within ``fps`` only."""
    import numpy as np

    n = len(fps)
    if n <= 256:
        near = _near(fps[:, None], fps[None, :], distance)
        if near.sum() == n:
            return np.arange(n)
        roots = np.arange(n)
        while True:
            lower = np.where(near, roots[None, :], n).min(1)
            if (lower == roots).all():
                return roots
            roots = lower
    # Breadth first: what a member reaches leaves the pool, so dense groups cost little.
    roots, pool = np.full(n, -1), np.arange(n)
    while len(pool):
        root, pool, front = pool[0], pool[1:], [pool[0]]
        roots[root] = root
        while front and len(pool):
            hit = _near(fps[pool], fps[front.pop()], distance)
            if hit.any():
                roots[pool[hit]] = root
                front += pool[hit].tolist()
                pool = pool[~hit]
    return roots


def bucket_links(own, probing, mask: int, distance: int):
    """Edges of a spanning forest of the links in one bucket: a forest of its own members, and
    for each probe one link to each of their trees that it reaches.

    A large bucket is divided again: members that agree in it differ elsewhere by at most
    ``distance`` bits, so they agree in one of distance + 1 groups of the other bits.
    """
    import numpy as np

    root = {}  # of own members, as the edges below connect them

    def find(fp):
        while root.get(fp, fp) != fp:
            root[fp] = fp = root.get(root[fp], root[fp])
        return fp

    def members(fps, divide):
        if len(fps) > 4096 and divide:
            rest = [b for b in range(BITS) if not mask >> b & 1]
            for k in range(distance + 1):
                sub = np.uint64(sum(1 << b for b in rest[k::distance + 1]))
                order = np.argsort(fps & sub, kind="stable")
                cuts = np.flatnonzero(np.diff((fps & sub)[order])) + 1
                for group in np.split(order, cuts):
                    if len(group) > 1:
                        yield from members(fps[group], False)
            return
        roots = link_members(fps, distance)
        at = np.flatnonzero(roots != np.arange(len(fps)))
        yield fps[roots[at]], fps[at]

    for a, b in members(own, True):
        yield a, b
        if len(probing):
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
    if len(probing) and len(own):
        tree = np.array([find(fp) for fp in own.tolist()], np.uint64)
        trees = np.unique(tree, return_inverse=True)[1]
        step = max(1, 2_000_000 // len(own))
        for at in range(0, len(probing), step):
            some = probing[at:at + step]
            p, o = np.nonzero(_near(some[:, None], own[None, :], distance))
            one = np.unique(p * len(own) + trees[o], return_index=True)[1]  # a link of each probe to each tree
            yield some[p[one]], own[o[one]]


def _bucket_links(parts: list[tuple[int, int]], distance: int):
    """Buckets sorted by key -> edges; holds the fingerprints of one bucket at a time."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def edges(cols):
            part, key, probe, fp = cols
            change = np.flatnonzero((np.diff(part) != 0) | (np.diff(key) != 0)) + 1
            starts, ends = np.r_[0, change], np.r_[change, len(fp)]
            many = ends - starts > 1
            for s, e in zip(starts[many], ends[many]):
                p = probe[s:e]
                yield from bucket_links(fp[s:e][~p], fp[s:e][p], parts[part[s]][0], distance)

        def batch_of(found):
            a = np.concatenate([x for x, _ in found]).view(np.int64)
            b = np.concatenate([y for _, y in found]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[3] = cols[3].astype("<i8").view(np.uint64)
            if not len(cols[0]):
                continue
            if held is not None:
                same = (cols[0] == held[0][0][0]) & (cols[1] == held[1][0][0])
                if same.all():
                    for k in range(4):
                        held[k].append(cols[k])
                    continue
                cut = int(np.argmin(same))
                whole = [np.concatenate([*held[k], cols[k][:cut]]) for k in range(4)]
                found = [x for x in edges(whole) if len(x[0])]
                if found:
                    yield batch_of(found)
                cols = [c[cut:] for c in cols]
            last = int(np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[-1] + 1) if (
                (cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1])).any() else 0
            if last:
                found = [x for x in edges([c[:last] for c in cols]) if len(x[0])]
                if found:
                    yield batch_of(found)
            held = [[c[last:]] for c in cols]
        if held is not None:
            found = [x for x in edges([np.concatenate(h) for h in held]) if len(x[0])]
            if found:
                yield batch_of(found)

    return run


def links(prints: DataFrame, parts: list[tuple[int, int]], distance: int = DISTANCE) -> DataFrame:
    """Distinct edges (u < v) that connect what is linked, never all pairs."""
    rows = probes(prints, parts).repartition("part", "key").sortWithinPartitions("part", "key")
    found = rows.mapInArrow(_bucket_links(parts, distance), "u long, v long")
    return found.filter("u <> v").distinct()


# --- components ---------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without an edge are left out.

    Large-star joins the larger neighbours of each node to its smallest one, small-star the
    smaller ones; they alternate until the edges are stars.  Each round is written.
    """
    edges, before = materialize(edges.select("u", "v"), "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")
        large = materialize(large.filter("u <> v").distinct(), "edges")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
        edges = materialize(small.filter("u <> v").distinct(), "edges")


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, root, component_id) for each different fingerprint."""
    least = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), plan(least, distance), distance))
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    smallest = materialize(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "smallest")
    large = F.col("members") > named.count() / LARGE_COMPONENTS  # fewer than so many
    hot = F.broadcast(smallest.filter(large).drop("members"))
    near = named.join(hot, "root")
    rest = named.join(hot, "root", "left_anti").join(smallest.filter(~large).drop("members"), "root")
    return near.unionByName(rest).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fp, id, digest, root, component_id) of every document."""
    prints = fingerprints(docs, id_col, text_col)
    return prints.join(classes(prints, distance), "fp")


def hex_digits(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def _key(id_col: str) -> list[Column]:
    """An id in two columns that are never null; no id sorts last."""
    return [F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id")]


def keep_one(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one of smallest id.

    Among rows that share this id the smallest text digest stays, once; a component without
    ids keeps one row by the same rule.  Texts are matched by (id, digest), nulls equal; of rows
    equal in both, the one whose columns come first as JSON stays.
    """
    on = ["no_id", "id", "digest"]
    found = near_duplicates(docs, distance, id_col, text_col)
    found = materialize(found.select("root", *_key("id"), "digest"), "members")
    stay = found.groupBy("root").agg(F.min(F.struct(*on)).alias("k")).select("k.*", F.lit(True).alias("stays"))
    keys = found.groupBy(*on).agg(F.count("*").alias("n")).join(stay, on, "left")
    keys = materialize(keys.filter("stays IS NULL OR n > 1"), "removed")
    rows = packed(docs, *_key(id_col), F.md5(whole_text(text_col)).alias("digest"))
    small = keys.count() <= BROADCAST_KEYS
    sized = F.broadcast if small else (lambda df: df)
    kept = rows.join(sized(keys.select(*on)), on, "left_anti").select("row.*")
    again = keys.filter("stays")
    if again.isEmpty():
        return kept
    once = rows.join(sized(again.select(*on)), on, "left_semi").groupBy(*on).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.unionByName(once.select("row.*"))
