from __future__ import annotations

import __spark_entry__ as entry
from llm.conftest import docs_frame, prose

import corpus_pipeline as P
from debtscope.llm import bpe_chunks
from debtscope.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    copies = [(100 + k, prose(120, 1), "en", "src0") for k in range(4)]
    rows = copies + [(k, prose(60, k), "de" if k % 2 else "en", f"src{k % 3}") for k in range(2, 30)] + [(50, "too short", "en", "src1"), (51, None, None, None)]
    docs = docs_frame(spark, rows + [(60, prose(40, 40) + " mail me: jo.doe@example.org", "en", "src2")])
    assert [name for name, _ in P.STAGES] == ["quality", "near_dedup", "personal_data", "mixing", "token_ids"]
    seen = {}
    for name, stage in P.STAGES[:-1]:
        out = materialize(stage(spark, docs, ""), name)
        assert out.columns == docs.columns
        seen[name], docs = {r.doc_id: r for r in out.collect()}, out
    assert 50 not in seen["quality"] and 51 not in seen["quality"] and 103 in seen["quality"]
    assert 100 in seen["near_dedup"] and not {101, 102, 103} & set(seen["near_dedup"])
    row = seen["personal_data"][60]
    assert row.text.endswith("mail me: [EMAIL]") and row.n_chars == len(row.text) and row.root == "own root"
    last = P.token_ids(spark, docs, "").collect()
    assert len(last) == docs.count() and bpe_chunks.CHUNK > 0


def test_run_equals_its_stages_by_brute_force(spark, sf_dir):
    """Every document of the result is kept by its predecessors, and its digests are right."""
    import hashlib

    import public_tokenizers
    import tiktoken
    from llm.test_pii_bootstrap import plain

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id: r.text for r in P.near_dedup(spark, materialize(P.quality(spark, docs, sf_dir), "q"), sf_dir).collect()}
    ranks = bpe_chunks.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = P.run(spark, sf_dir).collect()
    assert got and len({r.doc_id for r in got}) > 0.6 * len(kept)
    for r in got:
        text, free, parts = kept[r.doc_id], 0, []
        for start, end, kind in sorted((s, e, k) for k, s, e in plain(text)):
            if start >= free:
                parts += [text[free:start], ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"][kind]]
            free = max(free, end)
        redacted = "".join(parts) + text[free:]
        assert r.decoded_sha256 == hashlib.sha256(redacted.encode()).hexdigest()
        assert r.n_tokens == len(whole.encode_ordinary(redacted))


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in names} and "pipeline" in names


def test_batches_to_python_are_bounded_by_bytes(spark):
    """Long texts go to Python a few at a time; a bound that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    docs = docs_frame(spark, [(k, prose(60, k), "en", "src1") for k in range(3)])
    try:
        spark.conf.set(key, "3m")
        P.personal_data(spark, docs, "")
        assert spark.conf.get(key) == "3m"
        spark.conf.unset(key)
        P.personal_data(spark, docs, "")
        assert spark.conf.get(key) == P.BATCH_BYTES
        seen = spark.range(0, 8000, 1, 1).selectExpr("repeat('x', 4000) AS text").mapInArrow(lambda batches: (b.slice(0, 1).drop_columns("text").append_column("n", __import__("pyarrow").array([b.num_rows])) for b in batches), "n long")
        assert max(r.n for r in seen.collect()) < 2000
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
