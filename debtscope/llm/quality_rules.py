"""Quality rules: a ledger of failure bits, policies as bit masks, ablations from bits.

Every rule is evaluated once per document.  The ledger holds the measurements and one
``fail_bits`` number whose bit k says that rule k failed.  A policy is a version name and
a mask of rules: applying, changing or comparing policies reads the ledger only, never
the texts.

Defined results: null and empty texts have no words and fail ``few_words``; repeated rows
are judged one by one; other columns are carried in the struct ``row``, so their names
cannot clash; an empty table gives an empty ledger.  Windows of words are compared by
chained 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.llm.common import packed, whole_text

WORD_BREAK = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rule k fails where its predicate holds.  Order is the bit order; only append.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]

#: Policy versions: masks of the rules that reject.
POLICIES = {
    "v1": BASE,
    "v2": BASE | BITS["many_symbols"] | BITS["duplicate_lines"],
    "v3": BASE | BITS["many_symbols"] | BITS["duplicate_lines"] | BITS["short_words"] | BITS["long_words"],
}
CURRENT = "v3"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _window_hashes() -> list[tuple[str, str]]:
    """Hashes of all 8-word windows by doubling: 2, 4, then 8 words."""
    return [
        ("h", "IF(size(w) >= 8, transform(sequence(0, size(w) - 2), i -> xxhash64(get(w, i), get(w, i + 1))), array())"),
        ("h", "IF(size(h) > 0, transform(sequence(0, size(h) - 3), i -> xxhash64(get(h, i), get(h, i + 2))), array())"),
        ("h", "IF(size(h) > 0, transform(sequence(0, size(h) - 5), i -> xxhash64(get(h, i), get(h, i + 4))), array())"),
    ]


#: Words covered by windows that occur twice: sort the hashes with their places, keep those
#: with an equal neighbour, and add up the gaps between the places, eight at most each.
_REPEATS = [
    ("s", "IF(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))),"
          " CAST(array() AS array<struct<h:bigint,i:int>>))"),
    ("p", "sort_array(transform(filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false)"
          " OR coalesce(get(s, j + 1).h = x.h, false)), x -> x.i))"),
    ("n_repeat_words", "aggregate(transform(p, (x, j) -> least(8, coalesce(get(p, j + 1) - x, 8))),"
                       " CAST(0 AS bigint), (a, x) -> a + x)"),
]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` with the measurements of each whole text."""
    df = packed(docs, whole_text(text_col).alias("t")).select(
        "row", "t", F.array_remove(F.split("t", WORD_BREAK), "").alias("w")
    )
    df = df.select(
        "row",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    df = df.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    for name, step in [*_window_hashes(), *_REPEATS]:
        df = df.withColumn(name, F.expr(step))
    # A filter on a measurement may not go below this generator, where it would be written
    # out in terms of the text and evaluate each step many times.
    df = df.select("row", F.explode(F.array(F.struct(*MEASURES))).alias("m"))
    return df.select("row", "m.*")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``, measurements and ``fail_bits``: each rule evaluated once."""
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BITS[name])).otherwise(0).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def passes(policy: str, bits: str = "fail_bits") -> Column:
    """No rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablations(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and kept without it.

    Documents are first counted by their bits, at most 2^rules rows whatever the input;
    everything else is bit logic on those counts.
    """
    mask = POLICIES[policy]
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit"))
                      for n, b in BITS.items() if b & mask])
    held = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    counts = ledger_rows.groupBy(held.alias("bits")).agg(F.count("*").alias("n"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return (
        counts.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
            count(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
            count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
        )
    )


def keep(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their own columns."""
    return ledger(docs, text_col).filter(passes(policy)).select("row.*")
