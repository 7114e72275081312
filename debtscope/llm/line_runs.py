"""Line dedup by levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of
``min_chars`` code points or more count.  Documents come in batches, newest (largest ids)
first.  A batch merge-anti-joins the runs: keys that a run already holds as frequent, with a
newer owner, need no more counting and leave; the rest is counted (documents, largest id)
and becomes a run of its own.  ``fanout`` runs of a level are merged into one run of the
next.  Runs are bucketed by key and sorted in their buckets, so these joins and merges move
no run over the network.

Keys found in ``min_docs`` documents or more lose all their lines but in the document of
largest id.  Which texts lose what is joined in two parts: frequent keys of which there can
only be ``HOT_KEYS``, because each has more than that share of all lines, are broadcast; no
other key is large enough to fill a task.

Defined results: null and empty texts are one empty line; rows that share an id are one
document, rows without an id together the document of least id; a document keeps each copy
of a line it owns; other columns are carried in the struct ``row``; an empty table gives no
rows.  A text's lines meet in one task, whole documents never.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope.llm.common import materialize, packed, whole_text
from debtscope.session import shared_folder
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches a table is cut into, and runs of a level that are merged.
BATCHES, FANOUT = 4, 2
HOT_KEYS = 20_000
#: The place of rows without an id, before every other.
NO_ID = -(1 << 63)
KEY = ["a", "b"]
RUN = [*KEY, "n", "owner"]


# --- lines --------------------------------------------------------------------
def line_key(line: bytes) -> bytes:
    return line.strip().lower()  # of bytes: ASCII white space and ASCII letters only


def key_hash(key: bytes, min_chars: int) -> bytes | None:
    """128 bits of a key that is long enough to count."""
    import xxhash

    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _scan(min_chars: int):
    """Different counting keys of each text, one row each."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found, sizes = [], []
                for text in part.column(2).to_pylist():
                    keys = set(map(line_key, text.encode().split(b"\n")))
                    hashes = [h for h in (key_hash(k, min_chars) for k in keys) if h]
                    found += hashes
                    sizes.append(len(hashes))
                at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), part.column(3).take(at)],
                    names=["id", "digest", *KEY, "batch"])

    return run


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID).cast("long"))


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(whole_text(text_col)))


def cuts(docs: DataFrame, batches: int, id_col: str) -> list[int]:
    """Ids that divide the rows into batches of about equal size; one row on the driver."""
    parts = [k / batches for k in range(1, batches)]
    if not parts:
        return []
    found = docs.agg(F.percentile_approx(_id(id_col), parts).alias("c")).first().c
    return sorted(set(found or []))


def scan(docs: DataFrame, batches: int = BATCHES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, digest, a, b, batch) of every counting key of every text, and the number of batches.

    Batch 0 has the largest ids.  Each batch is a folder, which its round reads alone.
    """
    bounds = cuts(docs, batches, id_col)
    number = sum((F.when(F.col("id") <= c, 1).otherwise(0) for c in bounds), F.lit(0))
    texts = docs.select(_id(id_col).alias("id"), _digest(text_col).alias("digest"), whole_text(text_col).alias("text"))
    rows = texts.withColumn("batch", number.cast("int")).mapInArrow(_scan(min_chars), "id long, digest binary, a long, b long, batch int")
    path = shared_folder(docs.sparkSession, "lines")
    rows.write.partitionBy("batch").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path), len(bounds) + 1


# --- runs ---------------------------------------------------------------------
def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two runs as one; a merge join of sorted buckets.

    (A union of bucketed tables would claim their buckets without joining them: Spark 4.1
    then groups each of them apart.)
    """
    one, other = one.alias("x"), other.alias("y")
    both = one.join(other, F.expr("x.a = y.a AND x.b = y.b"), "full")
    n = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
    return both.select(*[F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in KEY], n.alias("n"), F.greatest("x.owner", "y.owner").alias("owner"))


class LineRuns:
    """The levels of runs.  A run has each key once: documents counted, largest id."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, max(2, fanout)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame) -> DataFrame:
        """A run on disk: bucketed by key, each bucket sorted.  The name in the catalogue is
        only needed to declare the buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        writer = df.select(*RUN).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", shared_folder(self.spark, "run")).saveAsTable(name)
        return self.spark.table(name)

    def fresh(self, counted: DataFrame) -> DataFrame:
        """Keys of a batch that no run settles: frequent there, with an owner not below."""
        for run in self.runs():
            old, new = run.filter(F.col("n") >= self.min_docs).alias("old"), counted.alias("new")
            counted = new.join(old, F.expr("new.a = old.a AND new.b = old.b AND old.owner >= new.owner"), "left_anti")
        return counted

    def add(self, lines: DataFrame) -> None:
        """Count a batch's keys and add its run.  No document may be in two batches."""
        counted = lines.groupBy(*KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("owner"))
        self._put(0, self.fresh(counted))

    def _put(self, level: int, df: DataFrame) -> None:
        run = self._write(df)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:  # compact
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._all(runs))

    def _all(self, runs: list[DataFrame]) -> DataFrame:
        """Several runs as one, the smaller levels first; all merges but the last are written."""
        whole, *others = runs
        for k, other in enumerate(others, 1):
            whole = merged(whole, other)
            whole = self._write(whole) if k < len(others) else whole
        return whole

    def frequent(self) -> DataFrame:
        """(a, b, n, owner) of the keys that enough documents hold; n may leave out documents
        that came when the key was settled."""
        return self._all(self.runs()).filter(F.col("n") >= self.min_docs)


# --- dropping -----------------------------------------------------------------
def hot(lines: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Keys with more than one in ``hot_keys`` of all rows: fewer than ``hot_keys`` of them."""
    least = lines.count() / hot_keys
    return lines.groupBy(*KEY).agg(F.count("*").alias("rows")).filter(F.col("rows") > least).select(*KEY)


def drops(lines: DataFrame, frequent: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(id, digest, drop): hashes of the lines that each text loses."""
    few = F.broadcast(materialize(hot(lines, hot_keys), "hot"))
    owners = frequent.select(*KEY, "owner")
    common = lines.join(F.broadcast(owners.join(few, KEY, "left_semi")), KEY)
    other = lines.join(few, KEY, "left_anti").join(owners, KEY)
    lost = common.unionByName(other).filter("id <> owner")
    return lost.groupBy("id", "digest").agg(F.collect_set(F.struct(*KEY)).alias("drop"))


KEPT = "kept string, n_dropped long"


def _kept(min_chars: int):
    def kept(texts, drops):
        import numpy as np
        import pyarrow as pa

        rows = []
        for text, drop in zip(texts.to_pylist(), drops):
            if text is None:
                rows.append(None)
                continue
            halves = np.stack([drop.values.field(k).to_numpy() for k in KEY], 1).astype("<i8")
            gone = {half.tobytes() for half in halves}
            lines = text.encode().split(b"\n")
            stay = [line for line in lines if key_hash(line_key(line), min_chars) not in gone]
            rows.append({"kept": b"\n".join(stay).decode(), "n_dropped": len(lines) - len(stay)})
        return pa.array(rows, pa.struct([("kept", pa.string()), ("n_dropped", pa.int64())]))

    return kept


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT,
          id_col: str = "doc_id", text_col: str = "text", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``row``, ``n_lines``, ``n_dropped`` and ``kept``, the text that stays, of every document."""
    lines, n = scan(docs, batches, min_chars, id_col, text_col)
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(n):
        runs.add(lines.filter(F.col("batch") == batch))
    frequent = materialize(runs.frequent(), "frequent")
    lost = materialize(drops(lines.drop("batch"), frequent, hot_keys), "drops")
    text = F.col(f"row.`{text_col}`")
    rows = packed(docs, _id(id_col).alias("id"), _digest(text_col).alias("digest")).join(lost, ["id", "digest"], "left")
    # only texts that lose a line go to Python
    cut = F.arrow_udf(_kept(min_chars), KEPT)(F.when(F.col("drop").isNotNull(), text), "drop")
    rows = rows.select("row", cut.alias("cut"))
    whole = F.coalesce(text, F.lit(""))
    return rows.select(
        "row", (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("cut.n_dropped", F.lit(0).cast("long")).alias("n_dropped"), F.coalesce("cut.kept", text).alias("kept"))
