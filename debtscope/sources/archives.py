"""ZIP archives to rows (S3)."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from debtscope import constants as C
from debtscope.functions.files import is_code_file
from debtscope.operators.sampling import measure
from debtscope.session import shared_folder
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

ENTRY_SCHEMA = (
    "repo_id bigint, branch string, pos bigint, name string, path string, size bigint, content string, error string"
)
ENTRY_COLUMNS = ["repo_id", "branch", "pos", "name", "path", "size", "content", "error"]
DIRECTORY_SCHEMA = (
    "repo_id bigint, branch string, file string, pos bigint, name string, offset bigint, packed bigint, size bigint, method int, "
    "crc bigint, error string"
)
DIRECTORY_COLUMNS = ["repo_id", "branch", "file", "pos", "name", "offset", "packed", "size", "method", "crc", "error"]
#: What lies in a folder; folders have no length.
LISTED_SCHEMA, LISTED_COLUMNS = "path string, length bigint", ["path", "length"]
#: Bytes of a ZIP file that one task reads.
RANGE_BYTES = 64 << 20
UNREADABLE = (
    zipfile.BadZipFile,
    zipfile.LargeZipFile,
    zlib.error,
    NotImplementedError,
    RuntimeError,
    EOFError,
)
BYTES_PER_CHAR = 4
#: What a frame on its way to Spark holds at most; a frame for each archive would cost more than the archive.
FRAME_ROWS, FRAME_CHARS = 10_000, 4_000_000
CODE_FILE = re.compile(C.CODE_FILE.replace(r"\z", r"\Z"))


def framed(rows: Iterator[tuple], columns: list[str], numbers: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames, whichever archives they are from; ``numbers`` may be null."""
    types, held, chars = dict.fromkeys(numbers, "Int64"), [], 0
    at = columns.index("content") if "content" in columns else None
    for row in rows:
        held.append(row)
        chars += 0 if at is None else len(row[at] or "")
        if len(held) >= FRAME_ROWS or chars >= FRAME_CHARS:
            yield pd.DataFrame(held, columns=columns).astype(types)
            held, chars = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns).astype(types)


def is_read(name: str) -> bool:
    """Whether Spark's readers take a file of this name."""
    return not (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _roots(spark: SparkSession, path: str) -> DataFrame:
    """``path``, or what it matches, as the cluster's file systems have it."""
    wanted = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = wanted.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(wanted)
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}.")
    rows = [(f.getPath().toString(), None if f.isDirectory() else f.getLen()) for f in found if f.isDirectory() or is_read(f.getPath().getName())]
    return spark.createDataFrame(rows, LISTED_SCHEMA).coalesce(1)


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The files and folders in each folder, without those that Spark's readers pass over."""
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            store, path = located(quote(folder, safe="/:@"))
            for info in store.get_file_info(fs.FileSelector(path)):
                place = f"{folder.rstrip('/')}/{info.base_name}"
                if info.type == fs.FileType.Directory:
                    if is_read(info.base_name) or info.base_name.startswith(("_metadata", "_common_metadata")):
                        yield place, None
                elif info.type == fs.FileType.File and info.size > 0 and is_read(info.base_name):
                    yield place, info.size


def _listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from framed(_children(batches), LISTED_COLUMNS, ["length"])


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """The files below ``path`` as ``(path, length)``, without empty ones.

    Folders are listed level by level, each by the task that it is dealt to, and what they hold
    is written; the driver counts the folders of a level and knows no file but those that ``path``
    itself names or matches.
    """
    level, written = _roots(spark, path), []
    folder = shared_folder(spark, "listing")
    while True:
        written.append(f"{folder}/{len(written)}")
        level.write.parquet(written[-1])
        folders = spark.read.schema(LISTED_SCHEMA).parquet(written[-1]).filter("length IS NULL")
        if (n := folders.count()) == 0:
            return spark.read.schema(LISTED_SCHEMA).parquet(*written).filter("length > 0")
        level = folders.select("path").repartition(min(n, tasks(folders)), "path").mapInPandas(_listing, LISTED_SCHEMA)


def list_archive_files(spark: SparkSession, path: str, name_pattern: str) -> DataFrame:
    """ZIP files as ``(repo_id, branch, first_pos, file, length)``; no content is read.

    ``name_pattern`` finds repository id (group 1), branch (group 2) and, where a large
    archive is landed in parts, the position of the part's first entry (group 3).
    """
    parts = re.compile(name_pattern).groups >= 3
    first = F.regexp_extract("path", name_pattern, 3).try_cast("bigint") if parts else F.lit(None).cast("bigint")
    return list_tree(spark, path).select(
        F.regexp_extract("path", name_pattern, 1).cast("bigint").alias("repo_id"),
        F.regexp_extract("path", name_pattern, 2).alias("branch"),
        F.coalesce(first, F.lit(0)).alias("first_pos"),
        F.col("path").alias("file"),
        "length",
    )


def read_archive_files(spark: SparkSession, path: str, name_pattern: str) -> DataFrame:
    """Small ZIP files whole, as ``(repo_id, branch, zip)``; for :func:`unpack_archives`."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(
            F.regexp_extract("path", name_pattern, 1).cast("bigint").alias("repo_id"),
            F.regexp_extract("path", name_pattern, 2).alias("branch"),
            F.col("content").alias("zip"),
        )
    )


def located(uri: str):
    """The file system of a file or folder, and its place there."""
    from pyarrow import fs

    if re.match("s3[an]://", uri):
        uri = "s3" + uri[3:]
    if re.match("file:/[^/]", uri):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def open_file(uri: str):
    """A file on any file system, for reads at any place."""
    store, path = located(uri)
    return store.open_input_file(path)


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The entries of each archive from its central directory, which ends the file."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            head = (row.repo_id, row.branch, row.file)
            try:
                with open_file(row.file) as stream, zipfile.ZipFile(stream) as archive:
                    last = {info.filename: info for info in archive.infolist()}
                    first: dict[str, int] = {}
                    for at, info in enumerate(archive.infolist()):
                        first.setdefault(info.filename, at)
            except (*UNREADABLE, OSError, ValueError) as failure:
                text = f"{type(failure).__name__}: {failure}"
                yield (*head, None, None, None, None, None, None, None, text)
                continue
            for name, info in last.items():
                if not info.is_dir():
                    yield (*head, row.first_pos + first[name], name, info.header_offset, info.compress_size, info.file_size,
                           info.compress_type, -1 if info.flag_bits & 1 else info.CRC, None)


def _directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from framed(_listed(batches), DIRECTORY_COLUMNS, ["pos", "offset", "packed", "size", "method", "crc"])


def tasks(rows: DataFrame) -> int:
    """What the session shuffles to, not to be coalesced by size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def archive_directory(files: DataFrame) -> DataFrame:
    """Step one: ``(repo_id, branch, file, pos, name, offset, packed, size, method, crc, error)``.

    Only the ends of the files are read.  A repeated name keeps its first place and its last
    content.  Files are dealt over the tasks by their name; empty ones are not listed.  The
    number of tasks is given: a row is a file to open, and its few bytes say nothing of that.
    """
    spread = files.repartition(tasks(files), "file")
    return spread.select("repo_id", "branch", "file", "first_pos").mapInPandas(_directory, DIRECTORY_SCHEMA)


def unpack_entry(stream, offset: int, packed: int, method: int, crc: int, max_bytes: int | None) -> bytes:
    """One entry from its place in the file; of a limited one no more is unpacked."""
    stream.seek(offset)
    head = stream.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no entry at its place")
    if crc < 0:
        raise RuntimeError("entry is encrypted")
    stream.seek(offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    raw = stream.read(packed)
    if len(raw) < packed:
        raise EOFError("entry is cut off")
    if method == zipfile.ZIP_DEFLATED:
        raw = zlib.decompressobj(-15).decompress(raw, max_bytes or 0)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression method {method}")
    if max_bytes is None and zlib.crc32(raw) != crc:
        raise zipfile.BadZipFile("wrong checksum")
    return raw if max_bytes is None else raw[:max_bytes]


def _entries(max_chars: int | None):
    most = None if max_chars is None else max_chars * BYTES_PER_CHAR

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, stream = None, None
        for batch in batches:
            rows, held = [], 0
            for row in batch.itertuples(index=False):
                content, error, path = None, row.error, row.name and row.name.partition("/")[2]
                if error is None:
                    try:
                        if row.file != name:
                            name, stream = row.file, open_file(row.file)
                        raw = unpack_entry(stream, int(row.offset), int(row.packed), int(row.method), int(row.crc), most)
                        content = raw.decode("utf-8", errors="replace")[:max_chars]
                    except (*UNREADABLE, OSError) as failure:
                        error = f"{type(failure).__name__}: {failure}"
                if content != "":
                    size = None if content is None else len(content)
                    rows.append((row.repo_id, row.branch, row.pos, row.name, path, size, content, error))
                    held += size or 0
                if held > 4_000_000:
                    yield pd.DataFrame(rows, columns=ENTRY_COLUMNS).astype({"pos": "Int64", "size": "Int64"})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=ENTRY_COLUMNS).astype({"pos": "Int64", "size": "Int64"})

    return run


def read_archive_entries(
    spark: SparkSession, path: str, name_pattern: str, max_chars: int | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """S3: the code files of ZIP files as rows of ``ENTRY_SCHEMA``; unreadable ones with ``error``.

    Step two deals the entries over tasks by where they lie, ``range_bytes`` of a file
    together, and each is read from its place.  So no task holds an archive, and one that has
    a third of all entries is read by many.  What is no code file is not read at all.
    """
    listed = archive_directory(list_archive_files(spark, path, name_pattern))
    wanted = listed.filter(F.col("error").isNotNull() | (F.col("name").contains("/") & is_code_file(F.col("name"))))
    span = F.floor(F.col("offset") / range_bytes)
    dealt = wanted.repartition(tasks(wanted), "file", span).sortWithinPartitions("file", "offset")
    return dealt.mapInPandas(_entries(max_chars), ENTRY_SCHEMA)


def measured_entries(entries: DataFrame, metrics: str) -> DataFrame:
    """Entries, unreadable ones too, with counts in place of ``content``, written once to the
    folder ``metrics``: whatever is asked of them later opens no archive again."""
    rows = measure(entries.drop("size"))
    rows.write.parquet(metrics)
    return rows.sparkSession.read.schema(rows.schema).parquet(metrics)


def readable_archives(entries: DataFrame) -> DataFrame:
    """Entries of archives that were read whole; one unreadable entry makes an archive unreadable."""
    broken = entries.filter(F.col("error").isNotNull()).select("repo_id", "branch").distinct()
    return entries.filter(F.col("error").isNull()).drop("error").join(broken, ["repo_id", "branch"], "left_anti")


def entries_of(
    blob: bytes, max_files: int | None = None, max_chars: int | None = None
) -> Iterator[tuple[int, str, str, str]]:
    """Kept entries ``(pos, name, path, content)`` of one archive.

    With limits it stops at ``max_files`` and reads no more of an entry than its kept
    characters can occupy, so a small archive cannot unpack into a huge one.
    """
    kept = 0
    with zipfile.ZipFile(io.BytesIO(blob)) as archive:
        names = {info.filename: info for info in archive.infolist()}
        for pos, (name, info) in enumerate(names.items()):
            root, slash, path = name.partition("/")
            if info.is_dir() or not slash or not CODE_FILE.search(path):
                continue
            with archive.open(info) as stream:
                raw = stream.read(-1 if max_chars is None else max_chars * BYTES_PER_CHAR)
            content = raw.decode("utf-8", errors="replace")[:max_chars]
            if content:
                yield pos, name, path, content
                kept += 1
            if max_files is not None and kept >= max_files:
                return


def _unpack(max_files: int | None, max_chars: int | None):
    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                try:
                    entries = list(entries_of(bytes(row.zip), max_files, max_chars))
                except UNREADABLE as failure:
                    text = f"{type(failure).__name__}: {failure}"
                    yield (row.repo_id, row.branch, None, None, None, None, None, text)
                    continue
                for pos, name, path, content in entries:
                    yield (row.repo_id, row.branch, pos, name, path, len(content), content, None)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from framed(unpacked(batches), ENTRY_COLUMNS, ["pos", "size"])

    return unpack


def unpack_archives(
    archives: DataFrame, max_files: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """Archives ``(repo_id, branch, zip)`` to code files, or to one row with ``error``.

    An archive with any unreadable entry counts as unreadable as a whole.  Batches of
    archives are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """

    return archives.select("repo_id", "branch", "zip").mapInPandas(_unpack(max_files, max_chars), ENTRY_SCHEMA)


def archive_scan(
    archives: DataFrame, max_files: int | None = None, max_chars: int | None = None
) -> DataFrame:
    """S3: the code files of all readable archives, ready for the archive route."""
    unpacked = unpack_archives(archives, max_files, max_chars)
    return unpacked.filter(F.col("error").isNull()).drop("error")


def archive_attempts(unpacked: DataFrame) -> DataFrame:
    """Unreadable archives as attempts ``(repo_id, branch, status, error)`` for J4."""
    failed = unpacked.filter(F.col("error").isNotNull())
    return failed.select("repo_id", "branch", F.lit(200).alias("status"), "error")
