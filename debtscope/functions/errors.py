"""Error rows to user messages (F2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope import messages as M
from debtscope.functions.text import redact_tokens


def error_status(status: Column, is_validation: Column) -> Column:
    """Own status, else 400 for a failed request check, else 500."""
    own = F.nullif(status, F.lit(0))
    return F.coalesce(own, F.when(is_validation, 400), F.lit(500)).cast("int")


def user_message(status: Column, message: Column) -> Column:
    """First rule that applies decides; the last resort is the redacted text."""
    raw = F.coalesce(F.nullif(message, F.lit("")), F.lit(M.ERROR_DEFAULT))
    return (
        F.when(status == 400, raw)
        .when(status == 404, F.lit(M.ERROR_NOT_FOUND))
        .when(status == 403, F.lit(M.ERROR_RATE_LIMIT))
        .when((status == 504) | F.rlike(raw, F.lit(C.TIMEOUT_TEXT)), F.lit(M.ERROR_TIMEOUT))
        .when(F.rlike(raw, F.lit(C.PROVIDER_TEXT)), F.lit(M.ERROR_PROVIDER))
        .otherwise(redact_tokens(raw))
    )
