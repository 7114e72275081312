"""Recent repositories of each user, kept up to date by the event stream.

The state of a user is the last use of the ``k`` URLs used last.  That is enough, in any
order of arrival: a URL that fell out can only come back by a use that is newer than what
stands there, and then its last use is that one.  Each micro-batch lands the lists that it
touched, under its own id, so a batch that is run again replaces itself; a list is read from
the last batch that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from debtscope import constants as C
from debtscope.shipping import ship_by_value
from debtscope.sources.reports import path_exists
from debtscope.streaming.live_reports import with_rocksdb

ship_by_value(__name__)

LIST = "user_id bigint, url string, last_us bigint, rank int"


class RecentList(StatefulProcessor):
    def __init__(self, k: int):
        self.k = k

    def init(self, handle) -> None:
        self.last = handle.getMapState("last", "url string", "last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = {url[0]: int(at[0]) for url, at in self.last.iterator()}
        now = dict(before)
        for part in rows:
            for url, at in part.groupby("url")["last_us"].max().items():
                now[url] = max(int(at), now.get(url, int(at)))
        kept = sorted(now.items(), key=lambda use: (-use[1], use[0]))[: self.k]
        for url in before.keys() - dict(kept).keys():
            self.last.removeKey((url,))
        for url, at in kept:
            if before.get(url) != at:
                self.last.updateValue((url,), (at,))
        if dict(kept) != before:
            yield pd.DataFrame(
                [(key[0], url, at, rank) for rank, (url, at) in enumerate(kept, 1)], columns=["user_id", "url", "last_us", "rank"])

    def close(self) -> None:
        pass


def follow(uses: DataFrame, table: str, checkpoint: str, k: int = C.TOP_RECENT) -> StreamingQuery:
    """Start the job on a stream of ``(user_id, url, ts, ok)``."""
    good = uses.filter("ok AND user_id IS NOT NULL AND url IS NOT NULL").select("user_id", "url", F.unix_micros(F.col("ts").cast("timestamp")).alias("last_us"))
    lists = good.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=RecentList(k), outputStructType=LIST, outputMode="Update", timeMode="None")

    def land(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    with with_rocksdb(uses.sparkSession):
        return (lists.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
                .outputMode("update").trigger(availableNow=True).start())


def recent_lists(spark: SparkSession, table: str) -> DataFrame:
    """``(user_id, url, last_use, rank)`` as of the last batch; no rows where none was landed."""
    if not path_exists(spark, table):
        rows = spark.createDataFrame([], f"{LIST}, batch int")
    else:
        rows = spark.read.schema(f"{LIST}, batch int").parquet(table)
    last = rows.withColumn("newest", F.max("batch").over(Window.partitionBy("user_id"))).filter("batch = newest")
    return last.select("user_id", "url", F.timestamp_micros("last_us").alias("last_use"), "rank")
