"""Token ids as length-delimited binary records with an offset index.

A data file is a header and framed records::

    header  "TOKREC01", bytes per id (u32), zero (u32)
    record  length (u64), masked crc of it (u32), payload, masked crc of that (u32)
    payload 1 if the document has an id, else 0 (u8); the id (i64); the token ids

All numbers are little-endian; ids take two bytes if the vocabulary allows, else four.  The
masked checksum is CRC-32 rotated right by 15 bits plus a constant, so that a checksum of
data that holds checksums stays useful.  Beside each data file lies an index file: per
record its offset, the ids before it in the file, their number and the document's id, all
of fixed width, for reads in any order.

Files are written from range-partitioned, sorted rows, so that file after file gives the
documents in ascending order.  Ranges go by id, digest of the text and place, so rows that
share an id, or have none, spread over as many files as their size asks for.  A task writes under a name of its own and reports the file
in the manifest; files of tasks that were lost are in no manifest and are never read.

Texts are cut where every pre-token ends, as at spaces that follow a character other than
white space (Arrow does this for many texts at once), and each different piece is encoded by the tokenizer once per worker process.

Defined results: null and empty texts have the end id alone; rows without an id come
first, rows with equal ids by digest; repeated rows are repeated records; only the id and
text columns are read; an empty table gives no files and no rows.
"""

from __future__ import annotations

import array
import re
import struct
import sys
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.llm.common import materialize, per_process, qualified, whole_text
from debtscope.session import shared_folder
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

MAGIC = b"TOKREC01"
#: Added to the rotated checksum, as in other record formats.
MASK_DELTA = 0xA282EAD8
INDEX = [("offset", "<u8"), ("before", "<u8"), ("n_ids", "<u4"), ("has_id", "<u4"), ("id", "<i8")]
#: Parts a task remembers before it starts afresh, and the longest one it keeps.
CACHE, CACHED_CHARS = 1_000_000, 64
MANIFEST = "part int, data_file string, index_file string, has_id boolean, first_id long, n_records long, n_ids long, n_bytes long, width int"
#: A space as byte-level vocabularies write it.
SPACE = "\u0120"
#: Other bytes as these vocabularies write them: those without a mark of their own go from U+0100 on.
WRITTEN = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
#: Letters of the Latin blocks, ASCII digits and ASCII marks, and their runs; an apostrophe takes
#: the endings that byte-level vocabularies of this kind know, but not behind a space.
_LATIN = r"A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F"
_MARKS = r"!-/:-@\[-`{-~"
_PLAIN = re.compile(f"(?!')[{_LATIN}0-9{_MARKS}]+")
_RUNS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LATIN}]+|[0-9]+|[{_MARKS}]+")
LITTLE = sys.byteorder == "little"
#: A space after any white space, for Arrow's matcher.
_UNSAFE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S) ")


# --- tokenizer ----------------------------------------------------------------
class PieceTokenizer:
    """Ids of whole texts as packed bytes, by way of remembered pieces."""

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain  # if so, their strings in a text are ordinary text
        self.width, self.code = (2, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (4, "I")
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}  # ids of parts, each with a space before it
        self.inner: dict[str, bytes] = {}  # ids of runs inside a part

    def pack(self, ids) -> bytes:
        return array.array(self.code, ids).tobytes() if LITTLE else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [self.pack(x.ids) for x in got]

    def _run(self, run: str, before: str = "") -> bytes:
        """Ids of one run of letters, digits or marks: a pre-token, which the model takes as its bytes are written."""
        written = run if run.isascii() else run.encode().decode("latin-1").translate(WRITTEN)
        return self.pack([token.id for token in self.tokenizer.model.tokenize(before + written)])

    def _learn(self, parts) -> None:
        """Parts of Latin letters, ASCII digits and marks are cut into their runs; all else goes
        through the whole tokenizer."""
        known, inner, rest, run_ids, runs_of = self.known, self.inner, [], self._run, _RUNS.findall
        for part in parts:
            if part.isascii() and part.isalpha():
                known[part] = run_ids(part, SPACE)
            elif _PLAIN.fullmatch(part) and not any(s in part for s in self.special):
                first, *others = runs_of(part)
                ids = known.get(first)
                if ids is None:
                    ids = known[first] = run_ids(first, SPACE)
                for run in others:
                    more = inner.get(run)
                    if more is None:
                        more = inner[run] = run_ids(run)
                    ids += more
                known[part] = ids
            else:
                rest.append(part)
        for at in range(0, len(rest), 20_000):
            some = rest[at:at + 20_000]
            known.update(zip(some, self._ids_of([" " + p for p in some])))

    def _ids_of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts; only unknown ones are encoded."""
        if len(self.known) + len(self.inner) > CACHE:
            self.known, self.inner = {}, {}
        found = list(map(self.known.get, parts))
        unknown = [part for part, ids in zip(parts, found) if ids is None]
        self._learn(unknown)
        if unknown:
            found = [self.known[part] if ids is None else ids for part, ids in zip(parts, found)]
            for part in unknown:
                if len(part) > CACHED_CHARS:
                    self.known.pop(part, None)
        return found

    def encode(self, texts) -> list[bytes]:
        """Packed ids of each text of an Arrow array.

        Arrow cuts the texts at their spaces, tells the different parts and puts the ids of
        parts back in order; Python sees each different part once.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        offsets, flat = split.offsets.to_numpy(), split.flatten()
        unsafe = np.flatnonzero(pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False))
        if len(unsafe):  # a space after white space belongs to the part before it
            lists = [flat.slice(a, b - a) for a, b in zip(offsets, offsets[1:])]
            for k in unsafe.tolist():
                lists[k] = pa.array(_CUT.split(texts[k].as_py()), pa.large_string())
            offsets = np.r_[0, np.cumsum([len(x) for x in lists])]
            flat = pa.concat_arrays(lists)
        heads = self._ids_of(flat.take(pa.array(offsets[:-1])).to_pylist())  # no space before these
        encoded = flat.dictionary_encode()
        at = encoded.indices.to_numpy().astype(np.int64)
        ids = self._ids_of_parts(encoded.dictionary.to_pylist())
        at[offsets[:-1]] = len(ids) + np.arange(len(texts))
        pieces = pa.array(ids + heads, pa.large_binary()).take(pa.array(at))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pieces), pa.scalar(b"", pa.large_binary()))
        return joined.to_pylist()


# --- framing ------------------------------------------------------------------
def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))])


class RecordError(ValueError):
    """A file does not hold what its checksums or its index say."""


def read_record(read) -> bytes | None:
    """The next payload from ``read(n)``; None at the end of the file."""
    head = bytes(read(12))
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked_crc(head[:8]):
        raise RecordError("length")
    payload = bytes(read(struct.unpack_from("<Q", head)[0]))
    crc = bytes(read(4))
    if len(crc) < 4 or struct.unpack("<I", crc)[0] != masked_crc(payload):
        raise RecordError("payload")
    return payload


def split_payload(payload: bytes, width: int):
    """(id or None, ids as unsigned 32-bit numbers)."""
    import numpy as np

    has_id, doc = struct.unpack_from("<Bq", payload)
    return (doc if has_id else None), np.frombuffer(payload, f"<u{width}", offset=9).astype("<u4")


def open_folder(uri: str):
    """File system and path of a folder every executor reaches."""
    from pyarrow import fs

    if re.match("s3[an]://", uri):
        uri = "s3" + uri[3:]
    return fs.FileSystem.from_uri(uri)


# --- writing ------------------------------------------------------------------
def slices(batch, most: int = 4096, size: int = 16 << 20):
    """Slices of a batch with about ``size`` bytes of text (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        done = upto[lo - 1] if lo else 0
        hi = min(lo + most, max(lo + 1, int(np.searchsorted(upto, done + size, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _write(path: str, folder: str, end_id: int):
    def run(batches):
        import gc

        gc.disable()  # many short-lived lists without cycles: collecting is a tenth of the time
        try:
            yield from write(batches)
        finally:
            gc.enable()

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        tokenizer = per_process(("tokenizer", path), lambda: PieceTokenizer(path))
        end = tokenizer.pack([end_id])
        out, index, entries, offset, before, first = None, None, 0, 0, 0, None
        for batch in batches:
            for part in slices(batch):
                ids = part.column(0).to_pylist()
                if out is None:
                    store, base = open_folder(folder)
                    store.create_dir(base, recursive=True)
                    name = f"{folder}/{uuid.uuid4().hex}"
                    data_file, index_file = f"{name}.rec", f"{name}.idx"
                    out = store.open_output_stream(f"{base}/{data_file.rsplit('/', 1)[1]}")
                    index = store.open_output_stream(f"{base}/{index_file.rsplit('/', 1)[1]}")
                    out.write(MAGIC + struct.pack("<II", tokenizer.width, 0))
                    offset, first = 16, ids[0]
                rows = np.zeros(len(ids), INDEX)
                for k, (doc, packed) in enumerate(zip(ids, tokenizer.encode(part.column(1)))):
                    n_ids = len(packed) // tokenizer.width + 1
                    record = frame(struct.pack("<Bq", doc is not None, doc or 0) + packed + end)
                    out.write(record)
                    rows[k] = (offset, before, n_ids, doc is not None, doc or 0)
                    offset, before = offset + len(record), before + n_ids
                index.write(rows.tobytes())
                entries += len(ids)
        if out is not None:
            out.close()
            index.close()
            row = {"part": TaskContext.get().partitionId(), "data_file": data_file, "index_file": index_file, "has_id": first is not None, "first_id": first or 0,
                   "n_records": entries, "n_ids": before, "n_bytes": offset, "width": tokenizer.width}
            kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))

    return run


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order; returns the manifest, one row per file.

    ``start`` is the number of ids in all files before.
    """
    folder = qualified(docs.sparkSession, folder or shared_folder(docs.sparkSession, "records"))
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"),
                        F.monotonically_increasing_id().alias("place"))
    order = [F.col("id").asc_nulls_first(), F.col("digest"), F.col("place")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    files = materialize(ordered.mapInArrow(_write(tokenizer_path, folder, end_id), MANIFEST), "manifest")
    # one row per file, so a single window over them stays small; the files of one id go by part
    upto = F.sum("n_ids").over(W.orderBy("part"))
    return materialize(files.withColumn("start", upto - F.col("n_ids")), "manifest")


# --- reading ------------------------------------------------------------------
def _read_files(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            store, data = open_folder(row["data_file"])
            _, index_path = open_folder(row["index_file"])
            index = np.frombuffer(store.open_input_stream(index_path).read(), INDEX)
            if len(index) != row["n_records"]:
                raise RecordError("index")
            with store.open_input_stream(data, buffer_size=1 << 20) as stream:
                if stream.read(16) != MAGIC + struct.pack("<II", row["width"], 0):
                    raise RecordError("header")
                out, at = [], 16
                for entry in index:
                    payload = read_record(stream.read)
                    if payload is None or at != entry["offset"]:
                        raise RecordError("offset")
                    at += len(payload) + 16
                    doc, ids = split_payload(payload, row["width"])
                    out.append((doc, row["start"] + int(entry["before"]), len(ids), zlib.crc32(ids.tobytes())))
                    if len(out) == 10_000:
                        yield _rows(pa, out)
                        out = []
                if read_record(stream.read) is not None:
                    raise RecordError("more records than the index has")
                if out:
                    yield _rows(pa, out)


def _rows(pa, out):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, all checksums and offsets verified."""
    files = max(1, manifest.count())
    return manifest.repartition(files).mapInArrow(_read_files, "id long, start long, n_tokens long, ids_crc32 long")


def _index_rows(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            store, path = open_folder(row["index_file"])
            index = np.frombuffer(store.open_input_stream(path).read(), INDEX)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["data_file"]] * len(index), pa.string()), pa.array([row["width"]] * len(index), pa.int32()),
                 pa.array(index["offset"].astype("i8")), pa.array(index["n_ids"].astype("i8"))],
                names=["data_file", "width", "offset", "n_ids"])


def _read_at(batches):
    import pyarrow as pa

    files: dict = {}
    for batch in batches:
        docs, ids = [], []
        for row in batch.to_pylist():
            if row["data_file"] not in files:
                if len(files) >= 64:
                    files.pop(next(iter(files))).close()
                store, path = open_folder(row["data_file"])
                files[row["data_file"]] = store.open_input_file(path)
            stream = files[row["data_file"]]
            stream.seek(row["offset"])
            doc, found = split_payload(read_record(stream.read), row["width"])
            docs.append(doc)
            ids.append(found.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary())], names=["id", "ids"])


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """(id, ids) of every record in a seeded order; only index entries are shuffled, and
    records are read by offset where the order puts them."""
    entries = manifest.repartition(max(1, manifest.count())).mapInArrow(_index_rows, "data_file string, width int, offset long, n_ids long")
    place = F.xxhash64(F.lit(seed), "data_file", "offset")
    return entries.withColumn("place", place).orderBy("place").drop("place").mapInArrow(_read_at, "id long, ids binary")
