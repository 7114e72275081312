"""Request checks: repository URLs, report ids, questions (V1-V4).

Accepted URLs: any case of scheme and host, optional user info and port, query and
fragment ignored, blanks around it and line breaks inside it removed.  Not accepted,
although a browser would repair them: back-slashes, missing slashes, ``.`` and ``..``
segments, and a repository that is only ``.git``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope.functions.text import trim_all

URL_PATTERN = C.URL_HTTPS + C.URL_AUTHORITY + C.URL_PATH


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, C.URL_EDGE, ""), C.URL_INNER, "")


def url_segment(url: Column, number: int) -> Column:
    """Owner (1) or repository (2) of a cleaned URL; empty when it does not match."""
    return F.regexp_extract(url, URL_PATTERN, number)


def url_reject_reason(url: Column) -> Column:
    """V1: why a URL is refused, null when it is accepted."""
    clean = clean_url(url)
    owner, repository = url_segment(clean, 1), url_segment(clean, 2)
    port = F.regexp_extract(clean, C.URL_PORT, 1)
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", F.lit("missing"))
        .when(~F.rlike(clean, F.lit(C.URL_HTTPS)), F.lit("not https"))
        .when(~F.rlike(clean, F.lit(C.URL_HTTPS + C.URL_AUTHORITY + r"(?:[/?#]|\z)")), F.lit("other host"))
        .when((port != "") & (F.coalesce(port.try_cast("int"), F.lit(C.URL_MAX_PORT + 1)) > C.URL_MAX_PORT), F.lit("bad port"))
        .when(owner == "", F.lit("not owner/repository"))
        .when(owner.isin(".", "..") | repository.isin(".", ".."), F.lit("dot segment"))
        .when(repository == ".git", F.lit("empty repository"))
    )


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """V2: owner, repository and canonical URL of an accepted URL."""
    clean = clean_url(url)
    owner = url_segment(clean, 1)
    repository = F.regexp_replace(url_segment(clean, 2), r"[.]git\z", "")
    canonical = F.concat(F.lit(f"https://{C.URL_HOST}/"), owner, F.lit("/"), repository)
    return owner, repository, canonical


def id_reject_reason(analysis_id: Column) -> Column:
    """V3: why a report id is refused, null when it is accepted."""
    ok = F.coalesce(F.rlike(analysis_id, F.lit(C.UUID)), F.lit(False))
    return F.when(~ok, F.lit("not a report id"))


def question_reject_reason(
    question: Column,
    shortest: int = C.QUESTION_MIN_CHARS,
    longest: int = C.QUESTION_MAX_CHARS,
) -> Column:
    """V4: why a question is refused, null when it is accepted."""
    size = F.coalesce(F.length(trim_all(question)), F.lit(0))
    return F.when(size < shortest, F.lit("too short")).when(size > longest, F.lit("too long"))
