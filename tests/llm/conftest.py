from __future__ import annotations

import pytest

#: Names that operators use inside.
CLASHING = ["row", "id", "ids", "tokens", "h", "rest", "key", "digest", "fp", "root", "epoch", "base", "extra", "w", "t", "start"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing in old green trees near our quiet river bank".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i + 3 * i * seed + seed) % len(WORDS)] + str((i * 7 + seed) % 5) for i in range(n))


def docs_frame(spark, rows):
    """(doc_id, text, lang, source) rows with columns of clashing names beside them."""
    from pyspark.sql import functions as F

    full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, null ids and columns, a repeated row, a very long text, odd code points."""
    return [
        (1, prose(60), "en", "src1"),
        (2, None, "en", "src1"),
        (3, "", None, None),
        (4, prose(40_000, 3), "de", "src2"),
        (5, prose(50, 5), "en", "src1"),
        (5, prose(50, 5), "en", "src1"),
        (None, prose(55, 6), "fr", "src3"),
        (7, " \n\t  \x0b  ", "en", None),
        (8, "日本語 ünïcode 🙂\x1c\x85 é <|endoftext|> \\[INST] </s>", None, "src2"),
        (9, "a" * 50_000, "en", "src2"),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return docs_frame(spark, edge_rows)


@pytest.fixture(scope="session")
def no_docs(spark):
    return docs_frame(spark, [])
