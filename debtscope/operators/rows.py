"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(df: DataFrame, keys: list, array: Column, name: str, rank: str | None = None) -> DataFrame:
    """One row per element, with its 1-based place when ``rank`` is given.

    Written as an outer explode plus a test of the element: for a plain explode the
    optimizer adds ``size(array) > 0`` and pushes it down, which computes the array twice.
    """
    if rank is None:
        return df.select(*keys, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
    rows = df.select(*keys, F.posexplode_outer(array).alias("_i", name))
    ranked = rows.filter(F.col("_i").isNotNull()).withColumn(rank, F.col("_i") + 1)
    return ranked.drop("_i")
