"""Prefix trie of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns.  Its key is a chain of digests, computed where a
conversation's turns stream by in order, so texts are neither shuffled nor compared.  Depths
are cut into bands of fixed height.  A node carries the keys of its ancestors within its band
and explodes to these alone; the totals of band roots, complete from the deepest band up, then
go to the ancestors in the band above.  With ``height`` at least the square root of the
greatest depth, neither the rounds nor the rows a node explodes to exceed
``max(height, sqrt(depth))``.

No group is gathered as a whole: members and children are counted with partial sums; ids of
conversations that end at a node are joined in blocks of neighbouring ids, whose texts a
task then hashes as they stream by, in order; the few parents that have more than one in
``HOT_PARENTS`` of all nodes as children are broadcast, so that no other fills a task.

Defined results: null roles and texts are empty; turns go by number, null first, equal ones by
digest of role and text, and repeated rows are turns like any other; rows without a
conversation id take no part; a conversation without turns is a member of the root alone; other
columns are not read; an empty table gives no rows.  A conversation streams through one task.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from debtscope.llm.common import materialize, whole_text
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

#: Least height of a band.
HEIGHT = 32
HOT_PARENTS = 20_000
#: Ids of one block have all but so many low bits in common.
BLOCK_BITS = 12
DIGEST = 16
ROOT = bytes(DIGEST)
WORD_GAP = r"[\x20\x09-\x0D]+"
STEPS = "conv long, pos int, digest binary, words long"
VISITS = "conv long, depth int, path binary, upper binary, words long, ends boolean"


# --- conversations ------------------------------------------------------------
def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, WORD_GAP), "")).cast("long")


def steps(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, words) of every turn, numbered from 1 in each conversation."""
    role, text = whole_text(role_col), whole_text(text_col)
    framed = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.md5(framed).alias("digest"), n_words(text).alias("words"))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv", F.row_number().over(order).alias("pos"), F.unhex("digest").alias("digest"), "words")


def grafted(own: DataFrame, group: int, most: int) -> DataFrame:
    """Conversations rebuilt on the first turns of their group's first one.

    Conversation c takes the first h = crc32(c) % (most + 1) turns of conversation
    c - c % group, then its own turns after its first h.
    """
    own = materialize(own, "steps")
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)).cast("int")
    rest = own.filter(F.col("pos") > taken)
    base = F.col("conv") - F.col("conv") % group
    heads = own.filter((F.col("pos") <= most) & (base == F.col("conv"))).select(F.col("conv").alias("base"), "pos", "digest", "words")
    convs = own.select("conv").distinct().withColumns({"base": base, "taken": taken})
    # a group has a bounded number of conversations, and a head of turns
    first = convs.join(heads, "base").filter(F.col("pos") <= F.col("taken")).select("conv", "pos", "digest", "words")
    return starts(own).unionByName(first).unionByName(rest)


def starts(own: DataFrame) -> DataFrame:
    """Every conversation's place before its first turn, at the root."""
    return own.select("conv").distinct().select(
        "conv", F.lit(0).alias("pos"), F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("words"))


# --- nodes --------------------------------------------------------------------
def _walk(height: int):
    """Sorted steps -> a visit of one node each: the keys of its band's ancestors and itself in
    ``path``, those of the band above in ``upper`` if it is a band root."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        names = ["conv", "depth", "path", "upper", "words", "ends"]
        conv, depth, key, path, held, rows = None, 0, ROOT, b"", None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for i, pos, digest, words in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    rows.append((*held, i != conv))
                if i != conv:
                    conv, depth, key, path, upper = i, 0, ROOT, ROOT, b""
                else:
                    depth, key, upper = depth + 1, hashlib.md5(key + digest).digest(), b""
                    if depth % height:
                        path += key
                    else:
                        upper, path = path, key
                held = (conv, depth, path, upper, words)
                if len(rows) >= 5000:
                    yield flush()
                    rows = []
        if held is not None:
            rows.append((*held, True))
            yield flush()

    return run


def visits(walked: DataFrame, height: int) -> DataFrame:
    """(conv, depth, path, upper, words, ends): each conversation at each of its nodes."""
    ordered = walked.select("conv", "pos", "digest", "words").repartition("conv").sortWithinPartitions("conv", "pos")
    return materialize(ordered.mapInArrow(_walk(height), VISITS), "visits")


def _last(packed_keys: str) -> Column:
    return F.expr(f"substring({packed_keys}, length({packed_keys}) - {DIGEST - 1}, {DIGEST})")


def _each(packed_keys: str) -> Column:
    """The keys of a packed list."""
    return F.expr(f"transform(sequence(0, length({packed_keys}) div {DIGEST} - 1), k -> substring({packed_keys}, k * {DIGEST} + 1, {DIGEST}))")


def nodes(seen: DataFrame) -> DataFrame:
    """One row per node: key, parent, depth, path, upper, words, least conversation, members, children."""
    found = seen.groupBy("depth", "path", "upper", "words").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"))
    above = F.expr(f"CASE WHEN depth = 0 THEN NULL WHEN length(path) > {DIGEST} "
                   f"THEN substring(path, length(path) - {2 * DIGEST - 1}, {DIGEST}) ELSE substring(upper, length(upper) - {DIGEST - 1}, {DIGEST}) END")
    found = materialize(found.withColumns({"key": _last("path"), "parent": above}), "found")
    children = found.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    return materialize(found.join(children, "key", "left").fillna(0, ["n_children"]), "nodes")


# --- totals -------------------------------------------------------------------
SUMS = ["n_leaves", "saved_tokens"]


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS])


def rollup(tree: DataFrame, height: int) -> DataFrame:
    """(key, n_leaves, saved_tokens) over each node's whole subtree."""
    own = {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}
    inside = _summed(tree.withColumns(own).select(F.explode(_each("path")).alias("key"), *SUMS))
    inside = materialize(inside, "inside")
    parts, sent = [inside], None
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    for band in range(deepest // height, 0, -1):
        tops = tree.filter(F.col("depth") == band * height).select("key", "upper").join(inside, "key")
        if sent is not None:  # what the band below sent up completes these
            more = sent.select("key", *[F.col(c).alias(f"more_{c}") for c in SUMS])
            tops = tops.join(more, "key", "left").select(
                "key", "upper", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in SUMS])
        sent = materialize(_summed(tops.select(F.explode(_each("upper")).alias("key"), *SUMS)), "sent")
        parts.append(sent)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _summed(whole) if len(parts) > 1 else whole


def _hash_blocks(batches):
    """(key, block, ids) sorted -> (key, ends_sha256); holds one block's text at a time."""
    import pyarrow as pa

    key, digest, out = None, None, []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
            out = []
    if key is not None:
        out.append((key, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])


def ends(seen: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end: their ids, ascending, comma-joined."""
    rows = seen.filter("ends").select(_last("path").alias("key"), F.expr(f"shiftright(conv, {BLOCK_BITS})").alias("block"), "conv")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    blocks = rows.groupBy("key", "block").agg(ids.alias("ids"))  # distinct ids, so a block is bounded
    ordered = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "block", "ids")
    return ordered.mapInArrow(_hash_blocks, "key binary, ends_sha256 string")


def with_parents(tree: DataFrame, hot_parents: int = HOT_PARENTS) -> DataFrame:
    """(key, parent_conv_id) of all nodes but the root."""
    below = tree.filter("depth > 0").select("key", "parent")
    above = tree.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"), "n_children")
    is_hot = F.col("n_children") > tree.count() / hot_parents  # fewer than hot_parents: all children are different nodes
    hot, other = F.broadcast(above.filter(is_hot).drop("n_children")), above.filter(~is_hot).drop("n_children")
    near = below.join(hot, "parent")
    rest = below.join(hot.select("parent"), "parent", "left_anti").join(other, "parent")
    return near.unionByName(rest).select("key", "parent_conv_id")


def trie(walked: DataFrame, height: int | None = None, hot_parents: int = HOT_PARENTS) -> DataFrame:
    """All nodes of the trie of conversations given as (conv, pos, digest, words), pos 0 first."""
    if height is None:
        longest = walked.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        height = max(HEIGHT, int(longest**0.5) + 1)
    seen = visits(walked, height)
    tree = nodes(seen)
    empty = hashlib.sha256(b"").hexdigest()
    found = tree.join(rollup(tree, height), "key").join(ends(seen), "key", "left").join(with_parents(tree, hot_parents), "key", "left")
    return found.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", *SUMS,
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, group: int | None = None, most: int = 3, **how) -> DataFrame:
    """The trie of a table of turns; with ``group`` of the conversations rebuilt as ``grafted`` says."""
    own = steps(turns)
    if group:
        return trie(materialize(grafted(own, group, most), "walked"), **how)
    own = materialize(own, "steps")
    return trie(starts(own).unionByName(own), **how)
