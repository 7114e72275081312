"""Nearest neighbours of a stated query set by a block matrix join on int8 products.

Candidates and queries are dealt into blocks by their id; each pair of blocks meets in one
task as a tile.  In a tile all vectors are quantised to int8 with a scale of their own and
multiplied as matrices.  With r the length of what quantising lost, the true distance lies
within r_query + r_candidate of the distance of the quantised vectors, so every candidate
whose lower bound exceeds the k-th smallest upper bound can go.  The rest are computed
again from the original vectors in double precision.  Tiles give at most k rows a query;
these are merged by heaps of k, first in the task that made them, then by query.

Defined results: rows without an id, and vectors that are null, zero or hold null or
non-finite components, take no part; vectors meet only those of their own length; rows that
repeat an id count once, by the vector that sorts first; ties go to the smaller id; a query
never finds its own id; only the id and vector columns are read; fewer candidates than k
give fewer rows, an empty table none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.shipping import ship_by_value

ship_by_value(__name__)

#: Vectors in a block, on average: a task holds one block of each side.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096
#: Queries of a tile that are multiplied at once.
STRIPE = 256


def quantise(x):
    """int8 values as floats, scale and length of the loss of each row of ``x``."""
    import numpy as np

    scale = np.abs(x).max(1) / 127.0
    q = np.rint(x / scale[:, None])
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(1))


def tile_neighbours(query_ids, queries, ids, candidates, k: int):
    """(query id, id, distance) of the k nearest of the tile, exactly."""
    import numpy as np

    # products of int8 are exact in float32 as long as their sum stays below 2^24
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    cq, cs, cr = quantise(candidates)
    c_tile, c_norm = cq.astype(kind).T, (cq**2).sum(1) * cs**2
    found = []
    for at in range(0, len(queries), STRIPE):
        some, own = queries[at:at + STRIPE], query_ids[at:at + STRIPE]
        qq, qs, qr = quantise(some)
        q_norm = (qq**2).sum(1) * qs**2
        product = (qq.astype(kind) @ c_tile).astype(np.float64)
        square = q_norm[:, None] + c_norm[None, :] - 2.0 * qs[:, None] * cs[None, :] * product
        near = np.sqrt(np.maximum(square, 0.0))
        # room for rounding in the square root of a difference
        loss = qr[:, None] + cr[None, :] + 1e-6 * np.sqrt(q_norm[:, None] + c_norm[None, :])
        mine = own[:, None] == ids[None, :]
        upper = np.where(mine, np.inf, near + loss)
        most = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(some), np.inf)
        q, c = np.nonzero((near - loss <= most[:, None]) & ~mine)
        for lo in range(0, len(q), 1 << 18):
            a, b = q[lo:lo + (1 << 18)], c[lo:lo + (1 << 18)]
            exact = np.sqrt(((some[a] - candidates[b]) ** 2).sum(1))
            found.append((own[a], ids[b], exact))
    q, c, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((c, d, q))
    q, c, d = q[order], c[order], d[order]
    starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1] if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = place < k
    return q[keep], c[keep], d[keep]


def _matrix(table, dim: int):
    """Ids and vectors of a block; of rows that repeat an id the smallest vector."""
    import numpy as np

    ids = table.column("id").to_numpy()
    flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(ids), dim)
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        ids, x = ids[first], x[first]
    return ids, x


def _tile(k: int):
    def run(key, left, right):
        import pyarrow as pa

        names, types = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not left.num_rows or not right.num_rows:
            cols = [[], [], []]
        else:
            dim = key[0].as_py()
            cols = tile_neighbours(*_matrix(right, dim), *_matrix(left, dim), k)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def _merge(k: int):
    """Heaps of the k best by query over all rows of a task."""

    def run(batches):
        import heapq

        import pyarrow as pa

        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, other, score in zip(*(batch.column(n).to_pylist() for n in ("query_id", "vec_id", "score"))):
                heap, entry = heaps.setdefault(query, []), (-score, -other)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        rows = ((q, rank, -o, -s) for q, heap in heaps.items() for rank, (s, o) in enumerate(sorted(heap, reverse=True), 1))
        held = []
        for row in rows:
            held.append(row)
            if len(held) == 50_000:
                yield _rows(pa, held)
                held = []
        if held:
            yield _rows(pa, held)

    return run


def _rows(pa, rows):
    types = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["query_id", "rank", "vec_id", "score"])


RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vec: str) -> Column:
    return F.expr(f"{vec} IS NOT NULL AND forall({vec}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
                  f" AND exists({vec}, x -> x <> 0)")


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of each query: (query_id, rank, vec_id, score)."""
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(vec_col)).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.size(vec_col).alias("dim"), is_query.alias("asks"))
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks = lambda count, size: F.lit(max(1, -(-count // size)))
    c_blocks, q_blocks = blocks(n, CANDIDATE_BLOCK), blocks(n_queries, QUERY_BLOCK)
    block = lambda count: F.pmod(F.xxhash64("id"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))
    left = rows.select("dim", block(c_blocks).alias("c"), every(q_blocks).alias("q"), "id", "vec")
    right = rows.filter("asks").select("dim", every(c_blocks).alias("c"), block(q_blocks).alias("q"), "id", "vec")
    on = ["dim", "c", "q"]
    tiles = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    best = tiles.mapInArrow(_merge(k), RESULT)
    return best.repartition("query_id").mapInArrow(_merge(k), RESULT)
