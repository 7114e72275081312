"""Report registry as a stream (ST1).

Report rows arrive as files, possibly more than once.  For each id the stream keeps a state
from its first row until the report's life is over and the watermark's delay has passed: repeats
meet the state and are dropped, and a session of the report's life ends it and tells so.  Both are
Spark's own streaming operators, so nothing is called for each id.  State thus holds the ids of
about two hours, in RocksDB, however long the job runs.  Rows that come after their report's life
are dropped.

What happens is landed as a table of events by UTC day and micro-batch; a batch that is run
again after a failure replaces its own folders.  The reader opens the days that can hold
live reports, and a table that was never written has no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from debtscope import constants as C
from debtscope.shipping import ship_by_value
from debtscope.sources.reports import created_date, path_exists

ship_by_value(__name__)

REGISTERED, EXPIRED = "registered", "expired"
ROW = "analysis_id string, created_at timestamp, payload string"
LANDED = "analysis_id string, event string, created_at timestamp, payload string"
#: The watermark's delay beyond the life of a report, so none is late while it can be live.
DELAY_MS = 60_000
#: Rows that a task takes in before it drops all but the first of each id.
FOLD_ROWS = 500_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times keep their microseconds on the way through the state.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def report_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here keep their state in RocksDB; the session's own choice comes back."""
    provider = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, provider) if provider else spark.conf.unset(STATE_STORE)


def _first_rows(batches):
    """The earliest row of each id of a task, ties by text, however many batches it comes in."""
    import pyarrow as pa

    order, kept, held = [("analysis_id", "ascending"), ("created_at", "ascending"), ("payload", "ascending")], [], 0

    def first(parts):
        rows = pa.Table.from_batches(parts).sort_by(order).combine_chunks()
        ids = rows.column("analysis_id").combine_chunks() if rows.num_rows else None
        if ids is None or not len(ids):
            return []
        new = pa.compute.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1))
        return rows.filter(pa.concat_arrays([pa.array([True]), new])).to_batches()

    import pyarrow.compute  # noqa: F401

    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held >= FOLD_ROWS:
            kept = first(kept)
            held = 0
    if kept:
        yield from first(kept)


def events(stream: DataFrame, ttl: str = C.REPORT_TTL) -> DataFrame:
    """(analysis_id, event, created_at, payload) of the stream's reports."""
    spark = stream.sparkSession
    life = spark.sql(f"SELECT CAST(unix_millis(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL {ttl}) AS BIGINT)").first()[0]
    rows = stream.filter("analysis_id IS NOT NULL AND created_at IS NOT NULL")
    rows = rows.select("analysis_id", "created_at", F.to_json(F.struct("*"), JSON).alias("payload"))
    firsts = rows.repartition("analysis_id").mapInArrow(_first_rows, ROW)
    new = firsts.withWatermark("created_at", f"{life + DELAY_MS} milliseconds").dropDuplicatesWithinWatermark(["analysis_id"])
    begun = new.select("analysis_id", F.lit(REGISTERED).alias("event"), "created_at", "payload")
    lives = new.groupBy("analysis_id", F.session_window("created_at", f"{life} milliseconds").alias("life")).agg(F.count("*").alias("n"))
    ended = lives.select("analysis_id", F.lit(EXPIRED).alias("event"), F.col("life.start").alias("created_at"), F.lit(None).cast("string").alias("payload"))
    return begun.unionByName(ended)


def register(stream: DataFrame, table: str, checkpoint: str, as_of: datetime, ttl: str = C.REPORT_TTL) -> list[StreamingQuery]:
    """Start the job on what has arrived; returns its two queries.

    The watermark follows the largest time seen, so a row stamped after ``as_of`` would
    end genuine reports of later batches.  Such rows go to a table of their own, which
    :func:`registered` reads as soon as their time has come.
    """
    spark = stream.sparkSession

    def land(path: str):
        def write(batch: DataFrame, batch_id: int) -> None:
            rows = batch.withColumns({"created_date": created_date(), "batch": F.lit(batch_id)})
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("created_date", "batch").parquet(path))

        return write

    on_time = events(stream.filter(F.col("created_at") <= F.lit(as_of)), ttl)
    early = stream.filter(F.col("created_at") > F.lit(as_of))
    with with_rocksdb(spark):
        return [
            rows.writeStream.foreachBatch(land(f"{table}/{name}"))
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True)
            .start()
            for name, rows in (("events", on_time), ("early", early))
        ]


def _landed(spark: SparkSession, path: str, schema: str, since: datetime | None, ttl: str) -> DataFrame:
    """Rows of a table from the first day that can hold a live report on; none if there is no table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{schema}, created_date date, batch int")
    rows = spark.read.schema(f"{schema}, created_date date, batch int").parquet(path)
    if since is None:
        return rows
    oldest = F.lit(since) - F.expr(f"INTERVAL {ttl}")
    return rows.filter(F.col("created_date") >= F.to_date(F.to_utc_timestamp(oldest, F.current_timezone())))


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def registered(spark: SparkSession, table: str, as_of: datetime, schema: StructType, days_only: bool = False,
               ttl: str = C.REPORT_TTL) -> DataFrame:
    """All registered reports of ``schema``, each once; early ones from their time on.

    ``days_only`` reads just the days that can hold live reports.
    """
    schema, since = StructType.fromJson(json.loads(schema.json())), as_of if days_only else None
    events_of = _landed(spark, f"{table}/events", LANDED, since, ttl).filter(F.col("event") == REGISTERED)
    reports = events_of.select(F.from_json("payload", schema, JSON).alias("r")).select("r.*")
    early = _landed(spark, f"{table}/early", _ddl(schema), since, ttl).select(*schema.names)
    due = early.filter(F.col("created_at") <= F.lit(as_of)).dropDuplicates(["analysis_id"])
    return reports.unionByName(due.join(reports.select("analysis_id"), "analysis_id", "left_anti").select(*reports.columns))


def expired(spark: SparkSession, table: str) -> DataFrame:
    """(analysis_id, created_at) of the reports whose life ended while the job ran."""
    rows = _landed(spark, f"{table}/events", LANDED, None, C.REPORT_TTL)
    return rows.filter(F.col("event") == EXPIRED).select("analysis_id", "created_at")
