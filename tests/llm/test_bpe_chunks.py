from __future__ import annotations

import array
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from debtscope.llm import bpe_chunks as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WHOLE = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(5, 3), (8, 6), (16, 8), (7, 7)])
def test_stitching_equals_whole_text(chunk, overlap):
    matcher, encoder, r = regex.compile(PATTERN), B.PieceEncoder(PATH, PATTERN), random.Random(chunk)
    for _ in range(400):
        text = "".join(r.choice("ab  \n\t'srtveé1２ .,!\x1c\x85　日🙂") for _ in range(r.randint(0, 90)))
        text = text.replace("b", "b" * r.choice([1, 1, 20]))
        stitcher = B.Stitcher(matcher, encoder, chunk)
        for start, end in B.windows(text, chunk, overlap):
            ends = B.piece_ends(matcher, text[start:end], end == len(text))
            stitcher.add(start, text[start:end], ends, encoder.each(B.pieces_of(text[start:end], ends)), end == len(text))
        assert array.array("I", b"".join(stitcher.ids)).tolist() == WHOLE.encode_ordinary(text)


def test_round_trip(edge_docs, edge_rows, no_docs):
    want = sorted((str(i), WHOLE.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in edge_rows)
    for spread in (0, B.SPREAD, 10**9):  # long texts dealt over tasks, some of them, none
        got = B.decode(B.encode(edge_docs, PATH, PATTERN, chunk=1000, overlap=40, spread=spread), PATH).collect()
        assert sorted((str(r.id), list(memoryview(bytes(r.ids)).cast("I")), bytes(r.decoded)) for r in got) == want
    assert B.encode(no_docs, PATH, PATTERN).count() == 0


def test_repeated_long_rows(spark, edge_rows):
    long = [r for r in edge_rows if r[0] == 4] * 3
    df = spark.createDataFrame([(i, t) for i, t, _, _ in long], "doc_id long, text string")
    assert [len(r.ids) // 4 for r in B.encode(df, PATH, PATTERN).collect()] == [len(WHOLE.encode_ordinary(long[0][1]))] * 3


def test_one_text_is_the_work_of_many_tasks(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"word{k % 997} {k}" for k in range(400_000))  # some 5 million code points
    df = spark.createDataFrame([(1, text)], "id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = B.scanned_windows(df, PATH, PATTERN, B.CHUNK, B.OVERLAP).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.5 * sum(r["count"] for r in tasks)
        (row,) = B.encode(df, PATH, PATTERN, id_col="id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert list(memoryview(bytes(row.ids)).cast("I")) == WHOLE.encode_ordinary(text)


def test_decoded_batches_are_bounded():
    """A large batch of ids is decoded in slices, so that a worker never holds all of it again."""
    import array

    import public_tokenizers
    import pyarrow as pa
    from debtscope.llm import bpe_chunks as B
    from debtscope.llm import common

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = [array.array("I", [k % 200 + 1] * 1000).tobytes() for k in range(2000)] + [b"", b""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.binary())], names=["id", "ids"])
    out = list(B._decode(path)(iter([batch])))
    assert max(sum(map(len, b.column(1).to_pylist())) for b in out) <= common.PART_BYTES and len(out) > 3
    token = {rank: raw for raw, rank in B.read_ranks(path).items()}
    got = [row for b in out for row in b.to_pylist()]
    assert [r["id"] for r in got] == list(range(len(ids)))
    assert all(r["decoded"] == b"".join(token[i] for i in memoryview(r["ids"]).cast("I")) for r in got)
    assert sum(b.num_rows for b in common.parts(batch, 1, 1)) == len(ids)
