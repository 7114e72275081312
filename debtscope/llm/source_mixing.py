"""Mixing sources to target weights by hierarchical budgets.

A tree of levels (domain, language, source) has a weight for each node.  A token budget
goes down the tree: the children of a node share its budget by weight, none above its
capacity (the tokens below it times the allowed epochs).  What a short child leaves over
goes to its siblings; only what all of them together cannot take was never given to their
parent, so shortages are met among siblings before ancestors.

Each leaf is read as a stream of epochs, each in its own seeded order, and the prefix that
holds its budget is selected.  Full epochs take every document; in the one partial epoch a
document is taken if its (hash, id) is at or before the leaf's cut, so selecting is a
filter against one row per leaf and texts are not shuffled.  The cut is found in two
steps: token sums per hash bucket, then single documents of the one bucket where the
budget ends.  A leaf of n documents has the square root of n buckets, so either step brings
about that many rows together, and a leaf with a third of all rows never meets as a whole.

Defined results: null and empty texts have no tokens and are taken with the epochs that
reach them; a null level is a node of its own, shown as ``(null)``, and real values of that
form get brackets; rows are placed by id and text, and equal ones on the cut share what is
left, the first ones whole; a document on the cut comes with its whole text and
``tokens_taken`` has the part that counts; a weight of 0 or less switches a node off; a budget above all capacity takes everything; other columns are carried
in the struct ``row``; empty tables give no rows.  All shares are exact integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.llm.common import materialize, packed, whole_text

#: Leaves up to this number are sent to every executor (some 200 bytes each); beyond it
#: the join with the leaf table is left to the optimizer.
BROADCAST_LEAVES = 20_000
#: Weights are integers, shares of a node's budget; nodes without one get this.
DEFAULT_WEIGHT = 100
NULL_NODE = "(null)"
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text_col: str = "text") -> Column:
    """Tokens are words here; any integer column may take its place."""
    words = F.array_remove(F.split(whole_text(text_col), r"[\x20\x09-\x0D]+"), "")
    return F.size(words).cast("long")


def _share(children: DataFrame, parents: list[str], key: str) -> DataFrame:
    """Split ``parent_budget`` over the children of each node by weight up to capacity.

    Children are filled in order of capacity per weight: one is full if its capacity is at
    most its share of what is left, and after the first that is not full none is.  The
    rest is split by cumulative rounding, which keeps the total exact.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.nullif("weight", F.lit(0))).otherwise(0)
    order = [ratio.asc(), F.col(key).asc()]
    w = W.partitionBy(*parents).orderBy(*order)
    before, onward = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing)
    wide = lambda c: c.cast("decimal(38,0)")
    df = children.withColumns({
        "left": F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(onward),
    })
    fits = wide(F.col("capacity")) * F.col("weight_left") <= wide(F.col("weight")) * F.col("left")
    df = df.withColumn("full", F.min(F.when(fits, 1).otherwise(0)).over(w) == 1)
    rest = F.when(F.col("full"), 0)
    df = df.withColumns({
        "rest_budget": F.col("parent_budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(W.partitionBy(*parents)),
        "rest_weight": F.sum(rest.otherwise(F.col("weight"))).over(W.partitionBy(*parents)),
        "upto": F.sum(rest.otherwise(F.col("weight"))).over(w.rowsBetween(W.unboundedPreceding, 0)),
    })
    cut = lambda upto: F.expr(f"CAST(rest_budget AS decimal(38,0)) * ({upto}) div nullif(rest_weight, 0)")
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(cut("upto") - cut("upto - weight"))
    return df.withColumn("budget", budget)


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: int | str,
            max_epochs: int) -> DataFrame:
    """Adds ``budget`` to ``leaves`` (the levels, ``tokens``).

    ``weights`` has for each level the weights of its nodes by name; ``total`` is a number
    or an SQL aggregate over the leaves.  A weight of 0 switches a node off, and all below it.
    """
    weight_of, live = {}, F.lit(True)
    for level in levels:
        given, weight = weights.get(level, {}), F.lit(DEFAULT_WEIGHT)
        if given:
            known = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
            weight = F.coalesce(F.try_element_at(known, F.col(level)), weight)
        weight_of[level] = F.greatest(weight, F.lit(0)).cast("long")
        live = live & (weight_of[level] > 0)
    usable = F.when(live, F.col("tokens")).otherwise(0)
    above = leaves.agg(F.expr(str(total)).cast("long").alias("parent_budget")).withColumn("root", F.lit(0))
    for depth, level in enumerate(levels, 1):
        path, parents = levels[:depth], (["root"] if depth == 1 else levels[: depth - 1])
        nodes = leaves.groupBy(*path).agg(
            (F.sum(usable) * max_epochs).alias("capacity"), F.sum("tokens").alias("tokens")
        ).withColumns({"weight": weight_of[level], "root": F.lit(0)})
        above = (
            _share(nodes.join(above, parents), parents, level)
            .select(*path, F.col("budget").alias("parent_budget"), "tokens")
        )
        if depth < len(levels):
            above = above.drop("tokens")
    return above.withColumnRenamed("parent_budget", "budget")


def plan(tokens: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: int | str,
         max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf: budget, full epochs and the cut of the partial epoch.

    ``tokens`` has the levels, ``id``, ``digest`` and ``tokens`` of each document.
    """
    stats = tokens.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))
    stats = materialize(stats, "leaves")  # a few rows, used at each level of the tree
    given = budgets(stats, levels, weights, total, max_epochs).drop("tokens").join(stats, levels)
    full = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    leaves = given.withColumns({
        "full_epochs": full.cast("long"),
        "wanted": F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0),
        "n_buckets": F.ceil(F.sqrt("n_docs")),
    })
    leaves = materialize(leaves, "budgets")
    open_leaves = leaves.filter("wanted > 0").select(*levels, "full_epochs", "wanted", "n_buckets")
    ordered = tokens.join(_sized(open_leaves, leaves), levels).withColumn("h", order_hash(seed, "full_epochs", "id", "digest"))
    bucket = F.expr("CAST(floor((h / 18446744073709551616D + 0.5D) * n_buckets) AS bigint)")
    ordered = ordered.withColumn("bucket", F.least(bucket, F.col("n_buckets") - 1))
    sums = ordered.groupBy(*levels, "bucket", "wanted").agg(F.sum("tokens").alias("n"))
    w = W.partitionBy(*levels).orderBy("bucket")
    sums = sums.withColumn("before", F.sum("n").over(w) - F.col("n"))
    edge = sums.filter("before < wanted AND before + n >= wanted").select(*levels, "bucket", "before")
    # keys of the one bucket per leaf where the budget ends
    keys = ordered.join(_sized(edge, leaves), [*levels, "bucket"]).groupBy(*levels, "wanted", "before", "h", "id").agg(
        F.sum("tokens").alias("n"), F.count("*").alias("cut_rows"))
    at = W.partitionBy(*levels).orderBy("h", "id")
    keys = keys.withColumn("upto", F.col("before") + F.sum("n").over(at))
    cuts = keys.filter("upto - n < wanted AND upto >= wanted").select(
        *levels, F.col("h").alias("cut_h"), F.col("id").alias("cut_id"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("cut_tokens"), "cut_rows"
    )
    return materialize(leaves.join(cuts, levels, "left"), "mix")


def _sized(df: DataFrame, leaves: DataFrame) -> DataFrame:
    """At most one row per leaf: broadcast below the bound, else as the optimizer likes."""
    return F.broadcast(df) if leaves.count() <= BROADCAST_LEAVES else df


def order_hash(seed: int, epoch: str, *doc: str) -> Column:
    """Place of a document in the order of an epoch."""
    return F.xxhash64(F.lit(seed), F.col(epoch), *[F.col(c) for c in doc])


def _level(name: str) -> Column:
    """A level's value; null is a node of its own, so a value that looks like its name gets brackets."""
    value = F.expr(name).cast("string")
    return F.when(value.isNull(), NULL_NODE).when(value.rlike(r"\A\(+null\)+\z"), F.concat(F.lit("("), value, F.lit(")"))).otherwise(value)


def mix(docs: DataFrame, levels: dict[str, str], weights: dict[str, dict[str, int]], total: int | str,
        max_epochs: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row``, the levels, ``tokens``, ``epoch`` and ``tokens_taken`` of every selected document.

    ``levels`` maps the names of the tree's levels, from the top, to SQL expressions over
    ``docs``.  A document comes once for each epoch that takes it.
    """
    names = list(levels)
    named = packed(docs, F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"), F.xxhash64(text_col).alias("digest"),
                   n_tokens(text_col).alias("tokens"), *[_level(levels[n]).alias(n) for n in names])
    narrow = materialize(named.drop("row"), "tokens")
    leaves = plan(narrow, names, weights, total, max_epochs, seed)
    rows = named.join(_sized(leaves.select(*names, "full_epochs", "cut_h", "cut_id", "cut_tokens", "cut_rows"), leaves), names)
    rows = rows.withColumn("h", order_hash(seed, "full_epochs", "id", "digest"))
    on_cut = F.expr("h = cut_h AND id = cut_id")
    taken = F.coalesce(F.expr("h < cut_h OR (h = cut_h AND id <= cut_id)"), F.lit(False))
    copies = F.col("full_epochs") + F.when(taken, 1).otherwise(0)
    epochs = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("row", "id", *names, "tokens", "full_epochs", on_cut.alias("on_cut"), "cut_tokens", "cut_rows", F.explode(epochs).alias("epoch"))
    part = F.coalesce(F.col("on_cut") & (F.col("epoch") == F.col("full_epochs")), F.lit(False))
    out = ["row", *names, "tokens", "epoch"]
    whole = rows.select(*out, F.when(part, F.col("cut_tokens")).otherwise(F.col("tokens")).alias("tokens_taken"), part.alias("part"), "cut_rows")
    if leaves.filter("cut_rows > 1").isEmpty():
        return whole.drop("part", "cut_rows")
    # equal rows on a cut share what it leaves: the first ones whole, one in part, the others not at all
    shared = F.col("part") & (F.col("cut_rows") > 1)
    w = W.partitionBy(*names).orderBy("tokens", F.to_json("row")).rowsBetween(W.unboundedPreceding, 0)
    ties = rows.filter(part & (F.col("cut_rows") > 1)).withColumn("upto", F.sum("tokens").over(w))
    taken = F.least("tokens", F.col("cut_tokens") - F.col("upto") + F.col("tokens"))
    ties = ties.withColumn("tokens_taken", taken).filter("tokens_taken > 0 OR tokens = 0")
    return whole.filter(~shared).drop("part", "cut_rows").unionByName(ties.select(*out, "tokens_taken"))
