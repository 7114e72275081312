"""Text helpers: trimming, templates, redaction, names and ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M


def fill(template: str, **slots: Column) -> Column:
    """``'a {x} b'`` with columns in the slots, as one ``concat``.  ``{{`` is a brace."""
    parts = []
    for piece in re.split(r"(?<!\{)(\{\w+\})(?!\})", template):
        name = piece[1:-1]
        if piece.startswith("{") and piece.endswith("}") and name in slots:
            parts.append(slots[name].cast("string"))
        elif piece:
            parts.append(F.lit(piece.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts)


def trim_all(text: Column) -> Column:
    """Trim every kind of whitespace at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, f"^{C.WHITESPACE}+|{C.WHITESPACE}+\\z", "")


def redact_tokens(text: Column) -> Column:
    """mask bearer tokens."""
    return F.regexp_replace(text, C.BEARER, M.REDACTED)


def short_url(url: Column) -> Column:
    """owner/repository part of a canonical URL."""
    return F.regexp_replace(url, f"^https://{C.URL_HOST}/".replace(".", "[.]"), "")


def utc_text(ts: Column) -> Column:
    """ISO-8601 UTC text with milliseconds, whatever the session time zone."""
    return F.date_format(
        F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    )


def bundle_name(ts: Column) -> Column:
    """file name stamped with a time that is legal in a file name."""
    return fill(M.BUNDLE_NAME, stamp=F.regexp_replace(utc_text(ts), "[:.]", "-"))


def uuid_of(*parts: Column) -> Column:
    """A UUID-shaped id derived from ``parts``; the same after any retry."""
    digest = F.md5(F.concat_ws("|", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, n) for start, n in cut])
