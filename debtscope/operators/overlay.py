"""Refined JSON fields laid over deterministic results.

An overlay row is ``(key, stage, payload)``, with ``at`` where versions follow each other; the
latest one at or before the report counts.  The merge is shallow: a field present in
the payload replaces the base field, also when its value is null.  A value that cannot
be read as the field's type counts as absent.  Text that is no JSON leaves the base
untouched and marks the stage as a fallback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope import constants as C

HOTSPOTS = "array<struct<path:string,lines:int,score:double,signals:array<string>>>"
SCAFFOLDS = "array<struct<path:string,content:string>>"
STRINGS = "array<string>"
STRUCTURE = (
    "struct<sampledFileCount:int,rootDirectories:array<string>,"
    "languages:array<array<string>>,entryPoints:array<string>>"
)

# Field of the result struct -> (key in the payload, type).
FIELDS = {
    "architecture": {
        "framework": ("framework", "string"),
        "layers": ("layers", STRINGS),
        "structure": ("structure", STRUCTURE),
        "violations": ("violations", STRINGS),
        "summary": ("summary", "string"),
    },
    "debt": {
        "hotspots": ("hotspots", HOTSPOTS),
        "total_debt_score": ("totalDebtScore", "double"),
        "summary": ("summary", "string"),
    },
    "cost": {
        "annual_cost": ("annualCost", "double"),
        "priority": ("priority", "string"),
        "roi_months": ("roiMonths", "double"),
        "assumption": ("assumption", "string"),
    },
    "refactor": {
        "target": ("target", "string"),
        "steps": ("steps", STRINGS),
        "scaffolds": ("scaffolds", SCAFFOLDS),
        "pull_request_title": ("pullRequestTitle", "string"),
    },
    "review": {
        "verdict": ("verdict", "string"),
        "checks": ("checks", STRINGS),
        "caveat": ("caveat", "string"),
    },
    "answer": {
        "answer": ("answer", "string"),
        "confidence": ("confidence", "double"),
        "source_files": ("sourceFiles", STRINGS),
    },
}


def known_at(overlays: DataFrame, as_of: Column | None) -> tuple[DataFrame, Column]:
    """The versions there were at a time, and what to order them by.

    ``at`` is when a version came; null is before all others, and later versions than
    ``as_of`` do not count.  Versions of one time go by their text, so repeats and ties have
    one outcome.
    """
    if "at" not in overlays.columns:
        return overlays, F.struct("payload")
    known = overlays if as_of is None else overlays.filter(F.col("at").isNull() | (F.col("at") <= as_of))
    return known, F.struct("at", "payload")


def latest_overlays(overlays: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
    """``(key, payload)``: the latest version of each key."""
    known, order = known_at(overlays, as_of)
    return known.groupBy(key).agg(F.max_by("payload", order).alias("payload"))


def pivot_overlays(overlays: DataFrame, key: str, stages: list[str] = C.STAGE_KEYS, as_of: Column | None = None) -> DataFrame:
    """One row per key with one payload column per stage: its latest version at ``as_of``.

    An as-of join by aggregation: versions are cut down in the map tasks, and one row per key
    meets the report.
    """
    known, order = known_at(overlays, as_of)
    return known.groupBy(key).agg(
        *[F.max_by("payload", F.when(F.col("stage") == s, order)).alias(f"{s}_payload") for s in stages]
    )


STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def is_json(payload: Column) -> Column:
    """The whole text is one JSON value.

    ``from_json`` stops after the first value and would accept trailing text, so the
    payload is read inside brackets and inside braces; only a single value survives both.
    """
    listed = F.from_json(F.concat(F.lit("["), payload, F.lit("]")), STRINGS, STRICT)
    named = F.from_json(
        F.concat(F.lit('{"v":'), payload, F.lit("}")),
        "struct<v:string,bad:string>",
        {**STRICT, "columnNameOfCorruptRecord": "bad"},
    )
    return F.coalesce(F.size(listed) == 1, F.lit(False)) & named.bad.isNull()


def parsed_fields(payload: Column) -> Column:
    """Top-level fields of a JSON object as (key, value) entries; null for anything else."""
    return F.map_entries(F.from_json(payload, "map<string,string>", STRICT))


def _read(value: Column, ddl: str) -> Column:
    if ddl == "double":
        return value.try_cast("double")
    parsed = F.from_json(value, ddl)
    if ddl != STRUCTURE:
        return parsed
    pairs = F.transform(
        parsed.languages,
        lambda pair: F.struct(F.get(pair, 0).alias("language"), F.get(pair, 1).try_cast("int").alias("n")),
    )
    return F.when(
        parsed.isNotNull(),
        F.struct(
            parsed.sampledFileCount.alias("sampled_file_count"),
            parsed.rootDirectories.alias("root_directories"),
            pairs.alias("languages"),
            parsed.entryPoints.alias("entry_points"),
        ),
    )


def laid_over(base: Column, fields: Column, key: str, ddl: str) -> Column:
    """One field: the payload's value when the key is there and readable, else the base."""
    entry = F.try_element_at(F.filter(fields, lambda e: e.key == key), F.lit(-1))
    value = entry.value
    if ddl == "string":
        return F.when(entry.isNotNull(), value).otherwise(base)
    read = _read(value, ddl)
    return F.when(entry.isNotNull() & value.isNull(), F.lit(None)).otherwise(F.coalesce(read, base))


def overlay_inputs(stages: list[str]) -> dict[str, Column]:
    """Columns ``<stage>_source`` and ``<stage>_fields`` from the columns ``<stage>_payload``."""
    columns = {}
    for stage in stages:
        payload = F.col(f"{stage}_payload")
        parsed = payload.isNotNull() & is_json(payload)
        columns[f"{stage}_source"] = (
            F.when(payload.isNull(), C.SOURCE_BASE)
            .when(parsed, C.SOURCE_OVERLAY)
            .otherwise(C.SOURCE_FALLBACK)
        )
        columns[f"{stage}_fields"] = F.when(parsed, parsed_fields(payload))
    return columns


def overlaid(stage: str, base: dict[str, Column]) -> Column:
    """struct(data, source) of a stage; needs the columns of :func:`overlay_inputs`."""
    names, fields = FIELDS[stage], F.col(f"{stage}_fields")
    data = F.struct(
        *[laid_over(value, fields, *names[name]).alias(name) for name, value in base.items()]
    )
    return F.struct(data.alias("data"), F.col(f"{stage}_source").alias("source"))
