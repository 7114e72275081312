"""Per-file expressions over a path and a body (M1-M10 and the path filters)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M


# --- paths ----------------------------------------------------------------
def is_code_file(path: Column) -> Column:
    """Has a supported source extension."""
    return F.rlike(path, F.lit(C.CODE_FILE))


def strip_root(name: Column) -> Column:
    """P5: archive entry name without its first segment."""
    return F.regexp_replace(name, "^[^/]*/", "")


def has_root(name: Column) -> Column:
    return F.instr(name, "/") > 0


def file_language(path: Column) -> Column:
    """M6: language by extension."""
    extension = F.lower(F.substring_index(path, ".", -1))
    table = F.create_map(*[F.lit(x) for pair in C.LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, extension), F.lit(C.OTHER_LANGUAGE))


def path_root(path: Column) -> Column:
    """M7: first path segment; null when that is empty."""
    return F.nullif(F.substring_index(path, "/", 1), F.lit(""))


def is_entry_point(path: Column) -> Column:
    """M8: conventional entry file."""
    return F.rlike(path, F.lit(C.ENTRY_POINT))


def is_layer_violation(path: Column) -> Column:
    """M9: path mixes user-interface and service names."""
    return F.rlike(path, F.lit(C.LAYER_VIOLATION))


def framework_rule(path: Column) -> Column:
    """Number (1-based) of the first framework rule this path satisfies, else null."""
    cases = F.when(F.rlike(path, F.lit(C.FRAMEWORK_RULES[0][0])), 1)
    for number, (pattern, _) in enumerate(C.FRAMEWORK_RULES[1:], start=2):
        cases = cases.when(F.rlike(path, F.lit(pattern)), number)
    return cases


def framework_name(rule: Column) -> Column:
    """Label of a rule number."""
    labels = F.array(*[F.lit(label) for _, label in C.FRAMEWORK_RULES])
    return F.coalesce(F.get(labels, rule - 1), F.lit(C.FRAMEWORK_DEFAULT))


def base_name(path: Column) -> Column:
    """Last path segment without its last extension; null when nothing is left."""
    last = F.substring_index(path, "/", -1)
    return F.nullif(F.regexp_replace(last, r"[.][^.]+\z", ""), F.lit(""))


def module_name(path: Column) -> Column:
    """Name of the module to scaffold."""
    return F.coalesce(base_name(path), F.lit(M.DEFAULT_MODULE))


# --- bodies ---------------------------------------------------------------
def truncate(content: Column, max_chars: int) -> Column:
    """First ``max_chars`` characters.  Short bodies skip the character walk."""
    return F.when(F.octet_length(content) > max_chars, F.substring(content, 1, max_chars)).otherwise(
        content
    )


def line_count(content: Column) -> Column:
    """M1: LF-separated lines.  Byte lengths, so neither regex nor array is built."""
    without = F.replace(content, F.lit("\n"), F.lit(""))
    return (F.octet_length(content) - F.octet_length(without) + 1).cast("int")


def _hinted_count(content: Column, pattern: str, first: str, text: Column, hints: list[str]) -> Column:
    """Regex count behind two cheap necessary conditions that leave the count as it is.

    A file without any of ``hints`` skips the regex, and the look-ahead on the possible
    first characters lets the regex skip most positions.
    """
    hinted = reduce(lambda a, b: a | b, [F.contains(text, F.lit(hint)) for hint in hints])
    quick = F.lit(f"(?=[{first}])(?:{pattern})")
    return (
        F.when(hinted, F.regexp_count(content, quick)).when(content.isNotNull(), 0).cast("int")
    )


def marker_count(content: Column) -> Column:
    """M2: maintenance markers, any case, also inside longer words."""
    return _hinted_count(content, C.MARKERS, "TtFfHh", F.lower(content), C.MARKER_WORDS)


def function_count(content: Column) -> Column:
    """M3: named functions and arrow bodies."""
    return _hinted_count(content, C.FUNCTIONS, "f=", content, C.FUNCTION_HINTS)


def debt_score(lines: Column, markers: Column, functions: Column) -> Column:
    """M4: 0..100."""
    extra = F.greatest(F.lit(0), functions - C.FREE_FUNCTIONS)
    points = (
        lines / F.lit(float(C.LINES_PER_POINT))
        + markers * C.POINTS_PER_MARKER
        + extra * C.POINTS_PER_EXTRA_FUNCTION
    )
    return F.least(F.lit(C.MAX_SCORE), F.round(points)).cast("int")


def signals(lines: Column, markers: Column, functions: Column) -> Column:
    """M5: labels of what raised the score, in fixed order."""
    return F.array_compact(
        F.array(
            F.when(lines > C.LARGE_FILE_LINES, F.lit(C.SIGNAL_LARGE)),
            F.when(markers > 0, F.concat(markers.cast("string"), F.lit(f" {C.SIGNAL_MARKERS}"))),
            F.when(functions > C.FREE_FUNCTIONS, F.lit(C.SIGNAL_FUNCTIONS)),
        )
    )
