"""Per-repository figures from all of its files.

:func:`profile` goes from narrow measured rows to one row per key without ever bringing
the files of a repository together.  Counts by language and root are keyed aggregates with
map-side partial sums; hotspots, entry points, violations and context paths are top lists
cut in every map task before the shuffle.  Only these bounded lists become arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions import files as X
from debtscope.functions.text import fill
from debtscope.operators.topk import top_k

PROFILE = (
    "struct<n:int,rule:int,first_path:string,roots:array<string>,"
    "languages:array<struct<language:string,n:int>>,entries:array<string>,"
    "hot:array<struct<path:string,lines:int,score:double,signals:array<string>>>,"
    "violating:array<string>,context:array<string>>"
)


def _counted(scored: DataFrame, keys: list[str]) -> DataFrame:
    """A2, A3 and the totals: counts and first places by value, the leading ones only."""
    values = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("language").alias("kind"), F.col("language").alias("value")),
        F.struct(F.lit("root").alias("kind"), F.col("root").alias("value")),
    )
    rows = scored.select(*keys, "pos", "path", "rule", F.explode(values).alias("v"))
    counts = (
        rows.filter("v.value IS NOT NULL")
        .groupBy(*keys, F.col("v.kind").alias("kind"), F.col("v.value").alias("text"))
        .agg(
            F.count(F.lit(1)).cast("int").alias("n"),
            F.min("pos").alias("first"),
            F.min("rule").alias("rule"),
        )
    )
    order = [F.when(F.col("kind") == "language", -F.col("n")).otherwise(0), F.col("first")]
    most = max(C.TOP_LANGUAGES, C.TOP_ROOTS)
    return top_k(counts, [*keys, "kind"], order, most)


def _listed(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The leading files of each list."""
    kind = lambda name, order, test: F.when(test, F.struct(F.lit(name).alias("kind"), order.cast("int").alias("order")))
    kinds = F.array(
        kind("context", F.lit(0), F.lit(True)),
        kind("hot", -F.col("score"), F.col("score") > C.HOTSPOT_MIN_SCORE),
        kind("entry", F.lit(0), F.col("is_entry")),
        kind("violation", F.lit(0), F.col("is_violation")),
    )
    rows = scored.select(
        *keys, "pos", "path", "lines", "markers", "functions", "score", F.explode(kinds).alias("k")
    ).filter("k IS NOT NULL")
    rows = rows.withColumns({"kind": F.col("k.kind"), "order": F.col("k.order")}).drop("k")
    return top_k(rows, [*keys, "kind"], [F.col("order"), F.col("pos")], C.TOP_CONTEXT_PATHS)


def profile(files: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and ``profile``, from rows ``(keys, pos, path, lines, markers, functions)``."""
    lines, markers, functions = F.col("lines"), F.col("markers"), F.col("functions")
    scored = files.select(
        *keys,
        "pos",
        "path",
        "lines",
        "markers",
        "functions",
        X.debt_score(lines, markers, functions).alias("score"),
        X.file_language(F.col("path")).alias("language"),
        X.path_root(F.col("path")).alias("root"),
        X.is_entry_point(F.col("path")).alias("is_entry"),
        X.is_layer_violation(F.col("path")).alias("is_violation"),
        X.framework_rule(F.col("path")).alias("rule"),
    )
    none = F.lit(None)
    counted = _counted(scored, keys).select(
        *keys, "kind", "rank", "text", "n", "rule", none.cast("double").alias("score"), none.cast("array<string>").alias("signals")
    )
    listed = _listed(scored, keys).select(
        *keys,
        "kind",
        "rank",
        F.col("path").alias("text"),
        lines.alias("n"),
        none.cast("int").alias("rule"),
        F.col("score").cast("double").alias("score"),
        X.signals(lines, markers, functions).alias("signals"),
    )
    rows = counted.unionByName(listed)
    item = F.struct("kind", "rank", "text", "n", "rule", "score", "signals")
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def items(kind: str, k: int) -> Column:
        return F.filter("items", lambda x: (x["kind"] == kind) & (x["rank"] <= k))

    def texts(kind: str, k: int) -> Column:
        return F.transform(items(kind, k), lambda x: x["text"])

    total = F.get(items("all", 1), F.lit(0))
    built = F.struct(
        total["n"].alias("n"),
        total["rule"].alias("rule"),
        F.get(texts("context", 1), F.lit(0)).alias("first_path"),
        texts("root", C.TOP_ROOTS).alias("roots"),
        F.transform(
            items("language", C.TOP_LANGUAGES),
            lambda x: F.struct(x["text"].alias("language"), x["n"].alias("n")),
        ).alias("languages"),
        texts("entry", C.TOP_ENTRY_POINTS).alias("entries"),
        F.transform(
            items("hot", C.TOP_HOTSPOTS),
            lambda x: F.struct(
                x["text"].alias("path"), x["n"].alias("lines"), x["score"].alias("score"), x["signals"].alias("signals")
            ),
        ).alias("hot"),
        texts("violation", C.TOP_VIOLATIONS).alias("violating"),
        texts("context", C.TOP_CONTEXT_PATHS).alias("context"),
    )
    return gathered.select(*keys, built.cast(PROFILE).alias("profile"))


def no_files() -> Column:
    """The profile of a repository in which nothing was kept."""
    empty = ["roots", "languages", "entries", "hot", "violating", "context"]
    return F.struct(
        F.lit(0).alias("n"),
        F.lit(None).alias("rule"),
        F.lit(None).alias("first_path"),
        *[F.array().alias(name) for name in empty],
    ).cast(PROFILE)


def with_profile(repos: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every repository, with an empty profile where nothing was kept, and its hotspots."""
    joined = repos.join(profiles, "repo_id", "left")
    filled = joined.withColumn("profile", F.coalesce("profile", no_files()))
    return filled.withColumn("hot", F.col("profile.hot"))


def sampled_count(p: Column) -> Column:
    """A1."""
    return p["n"]


def structure(p: Column) -> Column:
    """A5."""
    return F.struct(
        p["n"].alias("sampled_file_count"),
        p["roots"].alias("root_directories"),
        p["languages"].alias("languages"),
        p["entries"].alias("entry_points"),
    )


def framework(p: Column) -> Column:
    """The earliest rule that any file satisfies."""
    return X.framework_name(p["rule"])


def debt_total(hot: Column) -> Column:
    """Rounded mean score of the hotspots, 0 without any."""
    total = F.aggregate(hot, F.lit(0.0), lambda acc, h: acc + h.score)
    return F.round(total / F.greatest(F.size(hot), F.lit(1))).cast("int")


def violations(p: Column) -> Column:
    """A10, T6."""
    return F.transform(p["violating"], lambda path: fill(M.VIOLATION, path=path))


def refactor_target(hot: Column, p: Column) -> Column:
    """B2: worst hotspot, else first file, else a default."""
    return F.coalesce(F.get(hot, 0).path, F.nullif(p["first_path"], F.lit("")), F.lit(M.DEFAULT_TARGET))


def source_files(hot: Column, k: int = C.TOP_SOURCE_FILES) -> Column:
    """Evidence for answers."""
    return F.slice(F.transform(hot, lambda h: h.path), 1, k)
