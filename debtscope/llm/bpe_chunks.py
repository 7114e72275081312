"""Byte-level BPE by overlapping chunks: parallel pre-tokenising, stitching, encoding.

A text longer than ``chunk`` code points is cut into windows of ``chunk`` plus ``overlap``
code points.  Each window is pre-tokenised on its own, starting wherever it was cut, even
inside a pre-token.  The pattern looks only forward, so two scans that share one boundary
agree from there on: neighbours are stitched at the first boundary both have in their
overlap.  A window that meets no common boundary (a run longer than the overlap) is
scanned again from the last good boundary.  Pieces are encoded by merge ranks with their
window; decoding concatenates the raw bytes of the ids.  The windows of very long texts
are dealt over all tasks, so that one text is the work of many; those of others are worked on
where the text is read.

Defined results: null and empty texts have no ids; a document that occurs more than once
gives one row for each occurrence; only the id and text columns are read, so other columns
cannot clash; an empty table gives no rows.  Ids travel as little-endian unsigned 32-bit
binaries, four bytes an id.
"""

from __future__ import annotations

import base64
import bisect
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.llm.common import parts, per_process, whole_text
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

CHUNK = 16_384
OVERLAP = 256
#: A boundary is trusted if the scan saw this many code points beyond it: contractions
#: look two ahead, runs of white space one.
LOOK = 4
#: Distinct pieces whose ids a task remembers before it starts afresh.
CACHE, CACHED_CHARS = 150_000, 64
#: Texts of up to so many code points are worked on where they are read, longer ones by many tasks.
SPREAD = 65_536


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PieceEncoder:
    """Ids of single pre-tokens as packed bytes, remembered by piece."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.known: dict[str, bytes] = {}

    def each(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; long pieces are not remembered."""
        try:
            return list(map(self.known.__getitem__, pieces))
        except KeyError:
            pass
        import array

        if len(self.known) > CACHE:
            self.known.clear()
        known, ids_of, long = self.known, self.ranks.encode_ordinary, {}
        for piece in pieces:
            if piece not in known and piece not in long:
                keep = known if len(piece) <= CACHED_CHARS else long
                keep[piece] = array.array("I", ids_of(piece)).tobytes()
        return [known[p] if p in known else long[p] for p in pieces] if long else list(map(known.__getitem__, pieces))

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(self.each(pieces))


def windows(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each window; the last one ends with the text."""
    return [(at, min(len(text), at + chunk + overlap)) for at in range(0, max(len(text), 1), chunk)]


def piece_ends(matcher, text: str, whole: bool) -> list[int]:
    """Ends of the pre-tokens of a window; without those that more text could change."""
    ends = [m.end() for m in matcher.finditer(text)]
    if not whole:
        while ends and ends[-1] > len(text) - LOOK:
            ends.pop()
    return ends


def _batches(rows, names_types):
    """Arrow batches of bounded size from tuples whose last but one field is the payload."""
    import pyarrow as pa

    schema = pa.schema(names_types)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), names_types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), names_types)], schema=schema)


def _texts(batches):
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.column(0)[at].as_py(), batch.column(1)[at].as_py()


def _encode_short(path: str, pattern: str):
    """Texts of one window need no stitching: pre-tokenise and encode in place."""

    def run(batches):
        import pyarrow as pa
        import regex

        matcher, encoder = regex.compile(pattern), per_process(("pieces", path, pattern), lambda: PieceEncoder(path, pattern))
        rows = ((i, encoder.encode(matcher.findall(text))) for i, text in _texts(batches))
        yield from _batches(rows, [("id", pa.int64()), ("ids", pa.binary())])

    return run


def pieces_of(part: str, ends: list[int]) -> list[str]:
    return [part[a:b] for a, b in zip([0, *ends], ends)]


class Stitcher:
    """Joins the windows of one text, given in order with the ids of their pieces.

    Pieces up to ``reach`` are settled.  ``tail`` is the text read beyond it, ``ahead`` the
    boundaries known to be right in there and ``ids_ahead`` the ids of the pieces before them.
    """

    def __init__(self, matcher, encoder: PieceEncoder, chunk: int):
        self.matcher, self.encoder, self.chunk = matcher, encoder, chunk
        self.ids: list[bytes] = []
        self.reach, self.tail, self.ahead, self.ids_ahead, self.rescan_at = 0, "", [], [], 0

    def _settle(self, n: int) -> None:
        """Take over the pieces that end at the first ``n`` boundaries ahead."""
        if n:
            self.ids += self.ids_ahead[:n]
            self.tail, self.reach = self.tail[self.ahead[n - 1] - self.reach:], self.ahead[n - 1]
            self.ahead, self.ids_ahead = self.ahead[n:], self.ids_ahead[n:]

    def add(self, start: int, part: str, ends: list[int], ids: list[bytes], last: bool) -> None:
        mine = [start + end for end in ends]
        ours = {start, *mine}
        meet = next((e for e in (self.reach, *self.ahead) if e >= start and e in ours), None)
        if meet is not None:
            self._settle(bisect.bisect_right(self.ahead, meet))
            at = bisect.bisect_right(mine, meet)
            self.tail, self.ahead, self.ids_ahead = part[meet - start:], mine[at:], ids[at:]
        else:
            # No common boundary: scan on from the last good one, but not before the
            # unsettled text has doubled, so that one endless run costs linear time.
            self._settle(len(self.ahead))
            self.tail += part[self.reach + len(self.tail) - start:]
            if last or len(self.tail) >= self.rescan_at:
                found = piece_ends(self.matcher, self.tail, last)
                self.ahead = [self.reach + end for end in found]
                self.ids_ahead = self.encoder.each(pieces_of(self.tail, found))
                self.rescan_at = 2 * len(self.tail)
        self._settle(len(self.ahead) if last else bisect.bisect_right(self.ahead, start + self.chunk))


def _encode_windows(path: str, pattern: str, chunk: int, overlap: int):
    """Texts of some windows: scanned window by window, stitched in place."""

    def run(batches):
        import pyarrow as pa
        import regex

        matcher, encoder = regex.compile(pattern), per_process(("pieces", path, pattern), lambda: PieceEncoder(path, pattern))

        def rows():
            for i, text in _texts(batches):
                stitcher = Stitcher(matcher, encoder, chunk)
                for start, end in windows(text, chunk, overlap):
                    part = text[start:end]
                    ends = piece_ends(matcher, part, end == len(text))
                    stitcher.add(start, part, ends, encoder.each(pieces_of(part, ends)), end == len(text))
                yield i, b"".join(stitcher.ids)

        yield from _batches(rows(), [("id", pa.int64()), ("ids", pa.binary())])

    return run


CUT = "id long, key binary, start long, last boolean, part string"
SCANNED = "id long, key binary, start long, last boolean, ends binary, sizes binary, ids binary, part string"


def _cut(chunk: int, overlap: int):
    """One row per window of a long text, as it lies there."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        def rows():
            for i, text in _texts(batches):
                key = hashlib.sha256(text.encode()).digest()
                for start, end in windows(text, chunk, overlap):
                    yield i, key, start, end == len(text), text[start:end]

        yield from _batches(rows(), [("id", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("last", pa.bool_()), ("part", pa.string())])

    return run


def _scan(path: str, pattern: str):
    """Windows on their own: the boundaries each finds and the ids of its pieces."""

    def run(batches):
        import array

        import pyarrow as pa
        import regex

        matcher, encoder = regex.compile(pattern), per_process(("pieces", path, pattern), lambda: PieceEncoder(path, pattern))

        def rows():
            for batch in batches:
                for at in range(batch.num_rows):
                    i, key, start, last, part = (c[at].as_py() for c in batch.columns)
                    ends = piece_ends(matcher, part, last)
                    ids = encoder.each(pieces_of(part, ends))
                    yield (i, key, start, last, array.array("I", ends).tobytes(), array.array("I", map(len, ids)).tobytes(), b"".join(ids), part)

        yield from _batches(rows(), [("id", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("last", pa.bool_()),
                                     ("ends", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("part", pa.string())])

    return run


def scanned_windows(texts: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """The windows of (id, text), each scanned and encoded by whichever task gets it."""
    return texts.mapInArrow(_cut(chunk, overlap), CUT).repartition("id", "key", "start").mapInArrow(_scan(ranks_path, pattern), SCANNED)


def _stitch(path: str, pattern: str, chunk: int):
    """Windows sorted by text and place -> one row of ids per text; holds one window at a time."""

    def run(batches):
        import pyarrow as pa
        import regex

        matcher, encoder = regex.compile(pattern), per_process(("pieces", path, pattern), lambda: PieceEncoder(path, pattern))

        def rows():
            text, stitcher, copies, seen = None, None, 0, -1
            for batch in batches:
                for at in range(batch.num_rows):
                    i, key, start, last, ends, sizes, ids, part = (c[at].as_py() for c in batch.columns)
                    if (i, key) != text:
                        if stitcher:
                            yield from [(text[0], b"".join(stitcher.ids))] * copies
                        text, stitcher, copies, seen = (i, key), Stitcher(matcher, encoder, chunk), 0, -1
                    copies += start == 0
                    if start > seen:  # a repeated row brings each window again
                        cuts = [0, *itertools.accumulate(memoryview(sizes).cast("I"))]
                        stitcher.add(start, part, memoryview(ends).cast("I").tolist(), [ids[a:b] for a, b in zip(cuts, cuts[1:])], last)
                        seen = start
            if stitcher:
                yield from [(text[0], b"".join(stitcher.ids))] * copies

        yield from _batches(rows(), [("id", pa.int64()), ("ids", pa.binary())])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(id, ids) of every text.

    Texts of one window are encoded as they are, those of a few windows window by window where
    they are read.  The windows of texts beyond ``spread`` are dealt over all tasks, scanned
    and encoded there, and meet again to be stitched, which only joins ids.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    size = F.char_length("text")
    short = texts.filter(size <= chunk).mapInArrow(_encode_short(ranks_path, pattern), "id long, ids binary")
    some = texts.filter((size > chunk) & (size <= spread)).mapInArrow(_encode_windows(ranks_path, pattern, chunk, overlap), "id long, ids binary")
    scanned = scanned_windows(texts.filter((size > chunk) & (size > spread)), ranks_path, pattern, chunk, overlap)
    stitched = scanned.repartition("id", "key").sortWithinPartitions("id", "key", "start").mapInArrow(
        _stitch(ranks_path, pattern, chunk), "id long, ids binary"
    )
    return short.unionByName(some).unionByName(stitched)


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        def tokens():
            return {rank: raw for raw, rank in read_ranks(path).items()}

        token = per_process(("tokens", path), tokens)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for part in parts(batch, at):
                raw = [b"".join(map(token.__getitem__, memoryview(x).cast("I"))) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())],
                                                 names=[*part.schema.names, "decoded"])

    return run


def decode(ids: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids`` in a row."""
    fields = ", ".join(f"`{n}` {t}" for n, t in ids.dtypes)
    return ids.mapInArrow(_decode(ranks_path), f"{fields}, decoded binary")
