"""Report table with committed runs.

Rows lie in one folder per UTC day, run and attempt.  A run becomes visible by its commit, one
small file that names the attempt and is written last; a later commit of the run replaces
the earlier one, also if its reports then fall on other days.  An attempt that never came to
its commit, or was replaced, is not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

COMMIT = "run_id string, attempt string, seq bigint"


def created_date(column: str = "created_at"):
    """UTC day of a time."""
    return F.to_date(F.to_utc_timestamp(column, F.current_timezone()))


def path_exists(spark: SparkSession, path: str) -> bool:
    """On whatever file system the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt, seq): the commit that counts of each run."""
    if not path_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], COMMIT)
    rows = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    return rows.groupBy("run_id").agg(F.max_by("attempt", F.struct("seq", "attempt")).alias("attempt"), F.max("seq").alias("seq"))


def stage_reports(records: DataFrame, path: str) -> tuple[str, list[str]]:
    """Write the rows of an attempt, which nobody sees yet; its name, and the runs it has rows of."""
    attempt, seen = uuid.uuid4().hex, Observation()
    rows = records.observe(seen, F.collect_set(F.col("run_id").cast("string")).alias("runs"))
    rows = rows.withColumns({"created_date": created_date(), "attempt": F.lit(attempt)})
    rows.write.mode("append").partitionBy("created_date", "run_id", "attempt").parquet(f"{path}/reports")
    return attempt, sorted(seen.get["runs"])


def commit_runs(spark: SparkSession, path: str, run_ids: list[str], attempt: str) -> None:
    """Make an attempt the one that counts for these runs."""
    runs = spark.createDataFrame([(run,) for run in run_ids], "run_id string")
    before = commits(spark, path).select("run_id", "seq")
    rows = runs.join(before, "run_id", "left").select(
        "run_id", F.lit(attempt).alias("attempt"), (F.coalesce("seq", F.lit(0).cast("bigint")) + 1).alias("seq"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def write_reports(records: DataFrame, path: str, run_ids: list[str] | None = None) -> None:
    """All of a run's reports or none; a run that is repeated replaces its reports.

    ``run_ids`` names the runs where some of them may have no report any more; left out, the
    runs are those of the rows.
    """
    attempt, runs = stage_reports(records, path)
    runs = runs if run_ids is None else sorted({*run_ids, *runs})
    if runs:
        commit_runs(records.sparkSession, path, runs, attempt)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports of all committed runs; a filter on ``created_date`` opens its days alone."""
    found = spark.read.parquet(f"{path}/reports").schema
    names = {"run_id", "attempt"}  # folder names that look like numbers are names
    schema = StructType([StructField(f.name, StringType()) if f.name in names else f for f in found])
    rows = spark.read.schema(schema).parquet(f"{path}/reports")
    return rows.join(commits(spark, path).select("run_id", "attempt"), ["run_id", "attempt"], "left_semi").drop("attempt")


def keyed_reports(reports: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """A serving copy of reports, by day and bucketed by ``analysis_id``.

    Requests are shuffled to the buckets, reports are read where they lie: a look-up has no
    exchange on their side.  ``buckets`` is by default what the session shuffles to, so one
    exchange of the requests fits.  The catalogue name only declares the buckets; the rows
    are the files in ``path``.
    """
    spark = reports.sparkSession
    name = f"keyed_reports_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reports if "created_date" in reports.columns else reports.withColumn("created_date", created_date())
    # a bucket's rows in one task, so that a day has one sorted file for each
    dealt = rows.repartition(n, "analysis_id")
    dealt.write.partitionBy("created_date").bucketBy(n, "analysis_id").sortBy("analysis_id").option("path", path).saveAsTable(name)
    return spark.table(name)
