from __future__ import annotations

import io
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from debtscope.llm import token_records as R

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return R.PieceTokenizer(PATH)


def whole(tokenizer, text):
    return tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_whole_texts(tokenizer):
    r, letters = random.Random(5), [*"ab  \n\t'srve1.,!", "\x1c", "\x85", " ", " ", "　", "日", "🙂", "<|endoftext|>", " ", " "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u2").tolist() for x in tokenizer.encode(texts)]
    assert got == [whole(tokenizer, t) for t in texts]


def test_frames():
    data = R.frame(b"abc") + R.frame(b"")
    stream = io.BytesIO(data)
    assert [R.read_record(stream.read) for _ in range(3)] == [b"abc", b"", None]
    for at in range(len(data)):
        bad = io.BytesIO(data[:at] + bytes([data[at] ^ 1]) + data[at + 1:])
        with pytest.raises(R.RecordError):
            while R.read_record(bad.read) is not None:
                pass
    with pytest.raises(R.RecordError):
        R.read_record(io.BytesIO(data[:-18]).read)


def test_files(spark, edge_docs, edge_rows, no_docs, tokenizer):
    manifest = R.write_records(edge_docs.repartition(3), PATH)
    rows = manifest.collect()
    assert sum(r.n_records for r in rows) == len(edge_rows)
    assert all(os.path.getsize(r.index_file.removeprefix("file:")) == r.n_records * np.dtype(R.INDEX).itemsize for r in rows)
    want, start = [], 0
    for i, text, _, _ in sorted(edge_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(tokenizer, text) + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, R.read_digests(manifest).collect()), key=lambda r: r[1])
    assert got == want
    shuffled = R.read_shuffled(manifest, 3).collect()
    assert sorted((str(r.id), zlib.crc32(r.ids)) for r in shuffled) == sorted((str(w[0]), w[3]) for w in want)
    assert R.read_digests(R.write_records(no_docs, PATH)).count() == 0


def test_words_of_every_make(tokenizer):
    """Letters beyond ASCII, marks after words, each byte value, and every character that ends a run of letters."""
    r = random.Random(7)
    latin = [chr(c) for c in range(0x250)]
    words = ["".join(r.choice(latin) for _ in range(r.randint(1, 9))) for _ in range(4000)]
    words += ["".join(r.choice("éüßaÉzÿŁ") for _ in range(r.randint(1, 7))) + r.choice(["", ".", "...", "'", "',", "!?", "\")", "_", "'s", ".5"]) for _ in range(4000)]
    words += ["".join(r.choice(["'", "s", "t", "re", "ve", "m", "ll", "d", "S", ".", "1", "'s", "é"]) for _ in range(r.randint(1, 7))) for _ in range(4000)]
    texts = [" ".join(["start", *words[k:k + 40]]) for k in range(0, len(words), 40)]
    for _ in range(2):  # once to learn, once from what is known
        assert [np.frombuffer(x, "<u2").tolist() for x in tokenizer.encode(texts)] == [whole(tokenizer, t) for t in texts]
    tokenizer.known = dict.fromkeys(map(str, range(R.CACHE + 1)), b"")
    assert [np.frombuffer(x, "<u2").tolist() for x in tokenizer.encode(texts[:3])] == [whole(tokenizer, t) for t in texts[:3]]
    assert len(tokenizer.known) < R.CACHE


def test_rows_without_an_id_spread_over_files(spark):
    from pyspark.sql import functions as F

    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3000).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(5, "five"), (-5, "minus five")], "doc_id long, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = R.write_records(docs, PATH).orderBy("part").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) >= 3 and max(r.n_records for r in rows) < 5000
    got = sorted(map(tuple, R.read_digests(spark.createDataFrame(rows)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 10_000 + [-5, 5]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_damage_is_found(spark, edge_docs):
    manifest = R.write_records(edge_docs, PATH)
    path = manifest.first().data_file.removeprefix("file:")
    with open(path, "r+b") as file:
        file.seek(40)
        byte = file.read(1)
        file.seek(40)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="RecordError|payload"):
        R.read_digests(manifest).collect()


def test_ids_of_the_untouched_tokenizer():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    r, letters = random.Random(6), [*"ab  \n\t's.,", "\x1c", "\x85", "\u3000", "日", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|>."]
    got = [np.frombuffer(x, "<u2").tolist() for x in R.PieceTokenizer(PATH).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[-3] == [50256]
    (ordinary,) = R.PieceTokenizer(PATH, plain=True).encode(["<|endoftext|>"])
    assert len(ordinary) > 2
