"""Business rules on one repository's figures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions.files import base_name, module_name
from debtscope.functions.text import fill


# --- B1 -------------------------------------------------------------------
def cost_basis(refined: Column, base: Column) -> Column:
    """The refined score counts unless it is absent or zero."""
    return F.coalesce(F.nullif(refined, F.lit(0.0)), base.cast("double"))


def annual_cost(score: Column) -> Column:
    return F.greatest(F.lit(C.MIN_ANNUAL_COST), F.round(score * C.COST_PER_POINT)).cast("double")


def cost_priority(cost: Column) -> Column:
    return (
        F.when(cost > C.HIGH_COST, F.lit(C.PRIORITY_HIGH))
        .when(cost > C.MEDIUM_COST, F.lit(C.PRIORITY_MEDIUM))
        .otherwise(F.lit(C.PRIORITY_LOW))
    )


def payback_months(cost: Column) -> Column:
    return F.greatest(F.lit(1.0), F.round(cost / F.lit(float(C.COST_PER_MONTH))))


# --- B3 -------------------------------------------------------------------
def plan_steps(target: Column) -> Column:
    """What the scaffold of the target brings, and how to go on from it."""
    name = module_name(target)
    module = fill(M.SCAFFOLD_PATH, name=name)
    test = fill(M.SCAFFOLD_TEST_PATH, name=name)
    return F.array(
        fill(M.STEP_MODULE, path=module, fn=F.concat(F.lit("create"), name)),
        fill(M.STEP_CONTRACT, name=name),
        fill(M.STEP_TEST, path=test, target=target),
    )


def pull_request_title(target: Column) -> Column:
    return fill(M.PR_TITLE, target=target)


# --- B4, B5 ---------------------------------------------------------------
def _scaffold_files(name: Column, function: Callable[[Column], Column]) -> Column:
    """Module and test file of a name.  The name is bound once, for the templates use it often."""
    pairs = [
        (M.SCAFFOLD_PATH, M.SCAFFOLD_MODULE),
        (M.SCAFFOLD_TEST_PATH, M.SCAFFOLD_TEST),
    ]

    def files(bound: Column) -> Column:
        slots = {"name": bound["name"], "fn": bound["fn"]}
        return F.array(
            *[
                F.struct(fill(path, **slots).alias("path"), fill(content, **slots).alias("content"))
                for path, content in pairs
            ]
        )

    named = F.transform(F.array(name), lambda n: F.struct(n.alias("name"), function(n).alias("fn")))
    return F.flatten(F.transform(named, files))


def scaffolds(target: Column) -> Column:
    """Module and test for the target; its name is used as it is."""
    return _scaffold_files(module_name(target), lambda name: F.concat(F.lit("create"), name))


def fallback_scaffolds(target: Column) -> Column:
    """Same for a plan without files; here the name is reduced to word characters."""
    path = F.coalesce(F.nullif(target, F.lit("")), F.lit(M.FALLBACK_TARGET))
    plain = F.coalesce(base_name(path), F.lit(M.FALLBACK_MODULE))
    word = F.nullif(F.regexp_replace(plain, r"[^\w]", ""), F.lit(""))

    def function(name: Column) -> Column:
        first, rest = F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))
        return F.concat(F.lit("create"), first, rest)

    return _scaffold_files(F.coalesce(word, F.lit(M.FALLBACK_MODULE)), function)


def ensured_scaffolds(files: Column, target: Column) -> Column:
    """B5 in place: keep the plan's files when there are any."""
    return F.when(F.size(files) > 0, files).otherwise(fallback_scaffolds(target))


# --- B6 -------------------------------------------------------------------
def review_checks(count: Column, hotspots: Column, total: Column, files: Column) -> Column:
    """What the recommendation rests on, and what the scaffold ``files`` touch."""
    tests = F.filter(files, lambda f: f["path"].endswith(M.TEST_SUFFIX))
    return F.array(
        fill(M.CHECK_FILES, count=count),
        fill(M.CHECK_HOTSPOTS, count=F.size(hotspots), total=total),
        fill(M.CHECK_ADDITIVE, count=F.size(files), tests=F.size(tests)),
    )


def review_caveat(truncated: Column) -> Column:
    return F.when(truncated, F.lit(M.CAVEAT))


# --- B7 -------------------------------------------------------------------
def architecture_summary(profile: Column, fallback_reason: Column) -> Column:
    return F.coalesce(
        fill(M.SUMMARY_FALLBACK, reason=F.nullif(fallback_reason, F.lit(""))),
        fill(
            M.SUMMARY_SAMPLED,
            count=profile["n"],
            entries=F.size(profile["entries"]),
            mixed=F.size(profile["violating"]),
        ),
    )


def debt_summary(hotspots: Column, fallback_reason: Column) -> Column:
    unread = F.coalesce(fallback_reason, F.lit("")) != ""
    return (
        F.when(F.size(hotspots) > 0, fill(M.DEBT_FOUND, count=F.size(hotspots)))
        .when(unread, F.lit(M.DEBT_FALLBACK))
        .otherwise(F.lit(M.DEBT_NONE))
    )
