"""Helpers that several operators of this folder share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.session import shared_folder
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

#: Bytes that a Python worker takes on at once where its results are as large as what it gets.
PART_BYTES = 2_000_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and go on from the files.

    The lineage ends at files that every executor can read, so a lost executor costs its
    running tasks only, and later uses do not run the Python code above again.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str) -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def parts(batch, column: int, size: int = PART_BYTES):
    """Slices of an Arrow batch, not copied, whose values in ``column`` have up to about ``size`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """All columns of ``docs`` as one struct ``row`` beside ``extra``.

    Working columns can then have any name without meeting one of the table's.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *extra)


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker process and kept for its later tasks.

    Functions that are shipped by value have their globals made anew for every task, so the
    things kept are in a module of their own.
    """
    kept = sys.modules.setdefault("debtscope_worker", types.ModuleType("debtscope_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def qualified(spark: SparkSession, folder: str) -> str:
    """A path with its scheme, as the cluster's default file system has it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
