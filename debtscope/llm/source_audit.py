"""Divergence of sources from each other and from their language, over exact term counts.

Every term is tagged with its language, so one CountVectorizer gives each language its own
vocabulary: the terms that ``min_df`` of its documents hold, of any number.  A vocabulary
passes through the driver, so terms are first dealt into blocks by hash, as many as keep a
block below ``BLOCK_TERMS`` different terms; each block is vectorised by itself, from columns
that hold its terms only.  The vector of several texts is the sum of theirs, so documents are
dealt to tasks by group and place, and a task joins those of a group before they are
vectorised, a row for each bit of the counts.  Vectors are sparse; their sums by language and source are exact
integers.  From there on a term is a number, and its text joins what is shown.

With smoothed shares p of a group and q of another, per billion, a term's part of the
divergence is floor((p - q)^2 / q).  A pair's value over all kept terms is evaluated on
occurring ones: absent terms share one value per group, terms of one group alone are counted
by their share, and only terms that both hold are looked at together, a block of terms at a
time, which adds up all pairs of sources without a row for each.

Defined results: null texts, languages and sources are empty strings; a group counts even
without a term; rows are documents, repeated ones too; other columns are not read; an empty
table gives no rows.  Rankings go by value, then by the item's bytes.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from debtscope.llm.common import materialize, parts, whole_text
from debtscope.session import shared_folder
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

MIN_DF, TOP = 3, 200
#: Different terms of a block, kept or not; a bound on what one vocabulary brings to the driver.
BLOCK_TERMS = 1_000_000
#: One document in so many is looked at for the number of blocks.
SHARE = 16
#: Bytes of texts whose terms are cut and counted at once.
CHUNK_BYTES = 2_000_000
#: Terms of groups and languages, counted anew for each such part, and bytes of different terms
#: that a task holds before it sends a stretch of documents on; terms of one row.
HELD_TERMS, HELD_BYTES, ROW_TERMS = 1_500_000, 32_000_000, 50_000
#: Entries of terms that one task evaluates together.
PAIR_ROWS = 500_000
#: Pairs of sources a task adds up before it sends them on.
FLUSH = 200_000
SCALE = 1_000_000_000
#: Between language and term; no term has it.
MARK = "\x00"
GROUP = ["lang", "source"]


# --- terms --------------------------------------------------------------------
def _coded_terms(texts):
    """An Arrow array of texts -> its different terms, and code and document of every occurrence.

    Every byte of a code point beyond ASCII is above 0x7F, so terms are runs of bytes.
    """
    import numpy as np
    import pyarrow as pa

    letter = np.arange(256, dtype=np.uint8)
    letter[ord("A"):ord("Z") + 1] += 32
    letter[:ord("A")] = letter[ord("Z") + 1:ord("a")] = letter[ord("z") + 1:0x80] = 0
    texts = texts.cast(pa.large_string())
    _, upto, data = texts.buffers()
    upto = np.frombuffer(upto, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    low = letter[np.frombuffer(data or b"", np.uint8)[upto[0]:upto[-1]]]
    upto = upto - upto[0]
    inside = low != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begins = upto[:-1][upto[:-1] < len(low)]
    start[begins] = inside[begins]  # a text never goes on from the one before
    per_text = np.diff(np.searchsorted(np.flatnonzero(start), upto))
    at = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside))
    terms = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(low[inside])).dictionary_encode()
    return terms.dictionary, terms.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), per_text)


def _firsts(keys):
    """Places in ascending keys at which another one begins."""
    import numpy as np

    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])


def _counted(keys):
    """Different keys in ascending order and how often each occurs."""
    import numpy as np

    keys = np.sort(keys)
    first = _firsts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def _tokens(blocks: int, min_df: int):
    """Stretches of documents joined: the terms of each group by bits of their counts, and the
    terms of each language by presence.

    A row of ``weight`` w has different terms that occur w times each in the stretch, as one bit
    of their counts; a row of weight 0 has terms of as many documents as there are such rows,
    ``min_df`` at most, which is all that a vocabulary of terms in ``min_df`` documents asks.
    Terms are cut, coded and counted a few megabytes of texts at a time, as arrays.
    """

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["lang", "source", "weight", *map(block_column, range(blocks))]
        types = [pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.string())] * blocks]

        def batch_of(lang, source, rows, every):
            columns = [pa.array([v] * len(rows), t) for v, t in zip((lang, source), types)]
            columns.append(pa.array([weight for weight, _ in rows], pa.int64()))
            for block in range(blocks):
                mine = [dealt[block] for _, dealt in rows]
                upto = np.cumsum([0, *map(len, mine)]).astype(np.int32)
                tagged = pc.binary_join_element_wise(lang + MARK, every.take(pa.array(np.concatenate(mine))), "")
                columns.append(pa.ListArray.from_arrays(pa.array(upto), tagged))
            return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=names)

        def batches_of(lang, source, layers, every, block_of):
            rows, held = [], 0
            for weight, codes in layers:
                dealt = [codes[block_of[codes] == block] for block in range(blocks)] if blocks > 1 else [codes]
                for lo in range(0, max(map(len, dealt)), ROW_TERMS):
                    rows.append((weight, [mine[lo:lo + ROW_TERMS] for mine in dealt]))
                    held += sum(map(len, rows[-1][1]))
                    if held >= ROW_TERMS:
                        yield batch_of(lang, source, rows, every)
                        rows, held = [], 0
            if rows:
                yield batch_of(lang, source, rows, every)

        def together(held, codes_of):
            """Per group or language: ascending codes and their counts over all parts."""
            keys = np.concatenate([(owner << 32) + codes_of[k][codes] for k, (owner, codes, _) in enumerate(held)])
            order = np.argsort(keys)
            keys = keys[order]
            first = _firsts(keys)
            counts = np.add.reduceat(np.concatenate([n for *_, n in held])[order], first, dtype=np.int64)
            owners, codes = keys[first] >> 32, keys[first] & 0xFFFFFFFF
            cuts = [0, *(np.flatnonzero(owners[1:] != owners[:-1]) + 1).tolist(), len(owners)]
            for lo, hi in zip(cuts, cuts[1:]):
                yield int(owners[lo]), codes[lo:hi], counts[lo:hi]

        def flush(terms, counts, seen, groups, langs):
            every = pa.concat_arrays(terms).dictionary_encode()
            codes_of = np.split(every.indices.to_numpy(zero_copy_only=False), np.cumsum([len(t) for t in terms])[:-1])
            every = every.dictionary.cast(pa.string())
            block_of = np.array([zlib.crc32(t) % blocks for t in every.cast(pa.binary()).to_pylist()], np.int32) if blocks > 1 else None
            groups, langs = list(groups), list(langs)
            for group, codes, n in together(counts, codes_of):
                layers = ((1 << bit, codes[n >> bit & 1 == 1]) for bit in range(int(n.max()).bit_length()))
                yield from batches_of(*groups[group], layers, every, block_of)
            for lang, codes, n in together(seen, codes_of):
                layers = ((0, codes[n >= layer]) for layer in range(1, min_df + 1))
                yield from batches_of(langs[lang], None, layers, every, block_of)

        def new():
            return [], [], [], {}, {}

        held, size = new(), 0
        for batch in batches:
            for part in parts(batch, 2, CHUNK_BYTES):
                terms, counts, seen, groups, langs = held
                different, codes, doc = _coded_terms(part.column(2))
                if not len(codes):
                    continue
                by_text = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
                group = np.array([groups.setdefault(g, len(groups)) for g in by_text], np.int64)
                lang = np.array([langs.setdefault(name, len(langs)) for name, _ in by_text], np.int64)
                terms.append(different)
                once, _ = _counted((doc << 32) + codes)
                for to, keys in ((counts, (group[doc] << 32) + codes), (seen, (lang[once >> 32] << 32) + (once & 0xFFFFFFFF))):
                    keys, n = _counted(keys)
                    to.append((keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)))
                    size += len(keys)
                if size > HELD_TERMS or sum(t.nbytes for t in terms) > HELD_BYTES:
                    yield from flush(*held)
                    held, size = new(), 0
        if held[0]:
            yield from flush(*held)

    return run


def by_group(texts: DataFrame) -> DataFrame:
    """Texts dealt so that a task has those of few groups, which join best; a large group is
    cut among tasks by place in the table."""
    placed = texts.withColumn("place", F.monotonically_increasing_id())
    return placed.repartitionByRange(*GROUP, "place").select(*texts.columns)


def block_column(block: int) -> str:
    return f"terms_{block}"


def n_blocks(texts: DataFrame, block_terms: int) -> int:
    """Blocks of about so many different terms at most.

    All documents together have at most the terms of ``SHARE`` parts of them, and by hash one
    part is like another.  It settles how the work is cut, never what is counted.
    """
    part = texts.filter(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0)
    terms = part.select("lang", F.explode(F.split(F.lower("text"), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+")).alias("term"))
    different = SHARE * terms.agg(F.approx_count_distinct(F.struct("lang", "term"))).first()[0]
    return max(1, -(-different // block_terms))


def vectors(block: DataFrame, min_df: int) -> tuple[DataFrame, DataFrame]:
    """Sparse vectors (group, weight, vector) of a block's terms, and its vocabulary (at, lang, term).

    The vocabulary is fitted on the rows of weight 0 alone, in which a term stands as often as
    documents have it, or ``min_df`` times.  A term by itself as a document tells its number, so
    tasks name the numbers, and the vocabulary does not come to the driver's Python.
    """
    counter = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(min_df), vocabSize=2**31 - 1)
    present = block.filter("weight = 0").select("terms")
    model = counter.fit(present)
    alone = present.select(F.explode("terms").alias("tagged")).select("tagged", F.array("tagged").alias("terms"))
    names = model.transform(alone).select("tagged", F.explode(F.unwrap_udt("vector")["indices"]).alias("at")).distinct()
    lang = F.expr(f"substring(tagged, 1, length(tagged) - length(substring_index(tagged, '{MARK}', -1)) - 1)")
    documents = block.filter("weight > 0").select("group", "weight", "terms")
    return model.transform(documents), names.select("at", lang.alias("lang"), F.substring_index("tagged", MARK, -1).alias("term"))


def sums(vectorised: DataFrame) -> DataFrame:
    """(group, at, n): the sparse vectors of each group summed by weight, exactly."""
    entries = F.explode(F.arrays_zip(F.unwrap_udt("vector")["indices"].alias("at"), F.unwrap_udt("vector")["values"].alias("n")))
    rows = vectorised.select("group", "weight", entries.alias("e"))
    return rows.groupBy("group", F.col("e.at").alias("at")).agg(F.sum(F.col("e.n").cast("long") * F.col("weight")).alias("n"))


def add_block(block: int, rows: DataFrame, min_df: int, counted: str, named: str) -> None:
    """Counts and vocabulary of a block, added to the files of the blocks before.

    All blocks are read as one folder, so plans do not grow with them, and the model of a block
    is let go of before the next one is fitted.
    """
    vectorised, names = vectors(rows, min_df)
    key = (F.lit(block << 32) + F.col("at")).cast("long").alias("key")
    sums(vectorised).select("group", key, "n").write.mode("append").parquet(counted)
    names.select(key, "lang", "term").write.mode("append").parquet(named)


def term_counts(docs: DataFrame, min_df: int = MIN_DF, block_terms: int = BLOCK_TERMS,
                text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """All groups (lang, source, group); (group, key, n) of the kept terms that occur; and the
    vocabulary (key, lang, term), in which each key is a term of one language."""
    texts = docs.select(*[whole_text(c).alias(c) for c in GROUP], whole_text(text_col).alias("text"))
    groups = texts.select(*GROUP).distinct().withColumn("group", F.monotonically_increasing_id())
    groups = materialize(groups, "groups")
    blocks = n_blocks(texts, block_terms)
    columns = "".join(f", {block_column(k)} array<string>" for k in range(blocks))
    dealt = by_group(texts).mapInArrow(_tokens(blocks, min_df), f"lang string, source string, weight long{columns}")
    dealt = materialize(dealt.join(groups, GROUP, "left").drop(*GROUP), "terms")
    counted, named = shared_folder(docs.sparkSession, "counts"), shared_folder(docs.sparkSession, "names")
    for block in range(blocks):
        mine = dealt.select("group", "weight", F.col(block_column(block)).alias("terms")).filter("size(terms) > 0")
        add_block(block, mine, min_df, counted, named)
    read = docs.sparkSession.read
    counts = read.schema("group long, key long, n long").parquet(counted)
    return groups, counts, read.schema("key long, lang string, term string").parquet(named)


# --- divergence ---------------------------------------------------------------
def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly."""
    wide = "decimal(20,0)"
    exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast(wide), (total + kept).cast(wide))
    return F.when(total + kept > 0, exact + 1).cast("long")


def part_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_terms(batches):
    """Entries (key, group, p, zero) sorted by term -> per pair of groups, the correction for
    terms both hold.

    Terms come with all their entries; pairs are made by index arithmetic for many terms at
    once and added up in place, so no pair of a term becomes a row.  Sums go out as two
    halves, which no number of terms makes overflow.
    """
    import numpy as np
    import pyarrow as pa

    def value(p, q):
        return (p - q) ** 2 // q

    def evaluate(cols, totals):
        term, group, p, zero = cols
        names, codes = np.unique(group, return_inverse=True)
        change = np.r_[0, np.flatnonzero(term[1:] != term[:-1]) + 1, len(term)]
        sizes = np.diff(change)
        per_row = np.repeat(sizes, sizes)
        begins = np.repeat(change[:-1], sizes)
        upto, lo = np.cumsum(per_row), 0
        while lo < len(term):  # rows whose pairs fit in memory
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 2_000_000)))
            left = np.repeat(np.arange(lo, hi), per_row[lo:hi])
            ends = np.cumsum(per_row[lo:hi])
            right = np.arange(len(left)) - np.repeat(ends - per_row[lo:hi], per_row[lo:hi]) + np.repeat(begins[lo:hi], per_row[lo:hi])
            keep = left != right
            left, right = left[keep], right[keep]
            p_left, p_right, z_left, z_right = p[left], p[right], zero[left], zero[right]
            change_in = value(p_left, p_right) - value(p_left, z_right) - value(z_left, p_right) + value(z_left, z_right)
            which, at = np.unique(codes[left] * len(names) + codes[right], return_inverse=True)
            high, low = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
            np.add.at(high, at, change_in >> 32)
            np.add.at(low, at, change_in & 0xFFFFFFFF)
            for pair, h, l in zip(which.tolist(), high.tolist(), low.tolist()):
                key = (int(names[pair // len(names)]), int(names[pair % len(names)]))
                old = totals.get(key, (0, 0))
                totals[key] = (old[0] + h, old[1] + l)
            lo = hi

    def flush(totals):
        columns = [*zip(*totals), *zip(*totals.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["group", "other", "high", "low"])

    totals, held = {}, []
    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        # all but the last term of this stretch are whole
        starts = np.flatnonzero(cols[0] != cols[0][-1])
        last = int(starts[-1]) + 1 if len(starts) else 0
        if last or (held and held[-1][0][-1] != cols[0][0]):
            evaluate([np.concatenate(c) for c in zip(*held, [c[:last] for c in cols])], totals)
            held = []
        held.append([c[last:] for c in cols])
        if len(totals) > FLUSH:
            yield flush(totals)
            totals = {}
    if held:
        evaluate([np.concatenate(c) for c in zip(*held)], totals)
    if totals:
        yield flush(totals)


def audit(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP, block_terms: int = BLOCK_TERMS, text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): divergence from every other source of the
    language, and the terms a source has more often than its language."""
    groups, counts, names = term_counts(docs, min_df, block_terms, text_col)
    totals = counts.groupBy("group").agg(F.sum("n").alias("total")).join(groups, "group").drop("group")
    kept = names.groupBy("lang").agg(F.count("*").alias("kept"))
    whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = groups.join(totals, GROUP, "left").join(kept, "lang", "left").join(whole, "lang", "left")
    groups = groups.fillna(0, ["total", "kept", "lang_total"])
    groups = materialize(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))), "sources")
    about = groups.select("group", "total", "kept", "lang_total", "zero")
    entries = counts.join(about, "group").withColumns(
        {"p": share(F.col("n"), F.col("total"), F.col("kept")), "all_n": F.sum("n").over(W.partitionBy("key"))})
    q = share(F.col("all_n"), F.col("lang_total"), F.col("kept"))
    entries = materialize(entries.select("key", "group", "p", "zero", q.alias("q")), "entries")
    return _pairs(groups, entries).unionByName(_terms(groups, names, entries, top))


def _pairs(groups: DataFrame, entries: DataFrame) -> DataFrame:
    wide = lambda c: c.cast("decimal(38,0)")
    one = groups.select(*GROUP, "group", "kept", "zero")
    other = groups.select("lang", F.col("source").alias("item"), F.col("group").alias("other"), F.col("zero").alias("other_zero"))
    pairs = one.join(other, "lang").filter(F.col("group") != F.col("other"))
    both_absent = F.when(F.col("kept") > 0, part_of(F.col("zero"), F.col("other_zero"))).otherwise(0)
    pairs = pairs.withColumn("base", wide(both_absent))
    # terms of one group, by their share: as if the other had none of them
    key = ["group", "other"]
    shares = materialize(entries.groupBy("group", "p").agg(F.count("*").alias("terms")), "shares")
    mine = pairs.join(shares, "group").groupBy(*key).agg(
        F.sum(wide(F.col("terms")) * (part_of(F.col("p"), F.col("other_zero")) - F.col("base"))).alias("x"))
    theirs = pairs.join(shares.withColumnRenamed("group", "other"), "other").groupBy(*key).agg(
        F.sum(wide(F.col("terms")) * (part_of(F.col("zero"), F.col("p")) - F.col("base"))).alias("x"))
    # terms of both: what the two assumptions got wrong
    tasks = max(1, -(-entries.count() // PAIR_ROWS))
    dealt = entries.select("key", "group", "p", "zero").repartition(tasks, "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_shared_terms, "group long, other long, high long, low long")
    shared = found.groupBy(*key).agg(
        (F.sum(wide(F.col("high"))) * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(wide(F.col("low")))).alias("x"))
    parts = mine.unionByName(theirs).unionByName(shared.select(*key, wide(F.col("x")).alias("x")))
    more = parts.groupBy(*key).agg(F.sum(wide(F.col("x"))).alias("x"))
    value = F.coalesce("base", wide(F.lit(0))) * F.col("kept") + F.coalesce("x", wide(F.lit(0)))
    rows = pairs.join(more, key, "left").select(*GROUP, F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def _terms(groups: DataFrame, names: DataFrame, entries: DataFrame, top: int) -> DataFrame:
    """Ranked by value first, with all ties; only what can still be shown gets its text."""
    rows = entries.filter("p > q").select("group", "key", part_of(F.col("p"), F.col("q")).alias("value"))
    by_value = W.partitionBy("group").orderBy(F.desc("value"))
    near = rows.withColumn("place", F.rank().over(by_value)).filter(F.col("place") <= top)
    shown = near.join(names.select("key", F.col("term").alias("item")), "key").join(groups.select(*GROUP, "group"), "group")
    ranked = shown.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    return ranked.filter(F.col("rank") <= top).select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")
