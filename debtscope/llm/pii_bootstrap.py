"""Personal data: fixed patterns as seeds, contextual patterns bootstrapped from them.

Fixed patterns find emails, IP addresses, cards and phone numbers.  Around each of these
seeds, and around every other token that could be an identifier, the neighbouring words
form lexical patterns.  Such a token is one without white space, or a run of digit groups
that single spaces, brackets, dots, slashes and hyphens join; its context lies outside the
whole run.  Tokens under four characters are too short for any kind and no evidence.  Patterns and instances are the two sides of a graph that Spark
scores in rounds: a pattern is as reliable as the share of its occurrences that hold known
instances of a kind, an instance is as good as the patterns that surround it (noisy or).
Patterns that are reliable and rest on enough different instances then name the unseen
tokens they surround, if these have the kind's make-up.

Defined results: null and empty texts have no spans; rows are answered one by one, repeated
ones too; equal scores go to the kind listed first; places are code points, end exclusive;
only the id and text columns are read by ``find``, and ``redact`` carries all others; empty
tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from debtscope.llm.common import materialize, whole_text
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
#: A pattern extracts if this share of its occurrences, over so many different instances,
#: is known to be of the kind.
RELIABLE, SUPPORT = 0.9, 8
#: Scores are added up in this type, so that no order of the rows changes a sum.
EXACT = "decimal(24,12)"
#: Found spans beside the fixed ones, up to this number in all, go to every executor for redaction.
BROADCAST_SPANS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]\S*")
#: Digit groups, a plus sign or bracket before them; what joins two groups has a space or a bracket at most on either side.
_RUN = re.compile(r"(?<![0-9])\+?\(?[0-9]++(?:(?: ?[(./-] ?|\)[ ./-]?| )\(?[0-9]++)++")
_TRIM = "()[]{}<>.,;:!?\"'"


# --- fixed patterns -----------------------------------------------------------
def emails(text: str) -> list[tuple[int, int]]:
    """From each @: the run of local characters before it and the domain after it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    found = [(0, *span) for span in emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# --- contexts -----------------------------------------------------------------
def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit or an @, and runs of digit groups, that no fixed pattern touches.

    Outer punctuation is left out.  A run that could be an identifier stands for the tokens
    that it covers.
    """
    covered = sorted((s, e) for _, s, e in taken)
    runs = []
    k, reach = 0, 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        if m[0][0] == "(" and ")" not in m[0]:
            start += 1  # the bracket is around more than the run
        while k < len(covered) and covered[k][0] < end:
            reach = max(reach, covered[k][1])
            k += 1
        whole = (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")) and not (text[end:end + 1].isalnum() or text[end:end + 1] in ("_", "@"))
        if reach <= start and whole and any(c in " ()" for c in text[start:end]) and may_be(text[start:end]):
            runs.append((start, end))
    found, free = [], 0
    covered = sorted(covered + runs)
    k, reach = 0, 0
    for m in _MARK.finditer(text):
        start, end = m.span()
        while start > free and not text[start - 1].isspace():
            start -= 1
        free = end
        while k < len(covered) and covered[k][0] < end:
            reach = max(reach, covered[k][1])
            k += 1
        if reach > start:
            continue
        token = text[start:end]
        start += len(token) - len(token.lstrip(_TRIM))
        end -= len(token) - len(token.rstrip(_TRIM))
        if end - start >= 4:
            found.append((start, end))
    return sorted(found + runs)


def may_be(token: str) -> list[int]:
    """Kinds whose make-up a token has."""
    digits = sum(c in "0123456789" for c in token)
    plain = all(c in "0123456789().+-/ " for c in token)
    kinds = []
    if "@" in token[1:-1]:
        kinds.append(0)
    if digits >= 4 and sum(c in ".:" for c in token) >= 3 and all(c in "0123456789abcdefABCDEF.:" for c in token):
        kinds.append(1)
    if plain and 12 <= digits <= 19:
        kinds.append(2)
    if plain and 7 <= digits <= 15:
        kinds.append(3)
    return kinds


def _word(token: str) -> str:
    token = token.strip(_TRIM).lower()
    return "#" if any(c.isdigit() or c == "@" for c in token) else token


def words_before(text: str, at: int, n: int, reach: int = 80) -> list[str]:
    """The last ``n`` words before a place, whole: the stretch looked at doubles until it has them."""
    while True:
        found = text[max(0, at - reach):at].split()
        if len(found) > n or reach >= at:
            return found[-n:]
        reach *= 2


def words_after(text: str, at: int, n: int, reach: int = 80) -> list[str]:
    while True:
        found = text[at:at + reach].split()
        if len(found) > n or at + reach >= len(text):
            return found[:n]
        reach *= 2


def patterns(text: str, start: int, end: int) -> list[str]:
    """The two words before, and the words on both sides, as context of a span."""
    before = [_word(t) for t in words_before(text, start, 2)]
    after = [_word(t) for t in words_after(text, end, 1)]
    before, after = ["^"] * (2 - len(before)) + before, after or ["$"]
    return [f"{before[0]} {before[1]} _", f"{before[1]} _ {after[0]}"]


def _scan(batches):
    """Per document its fixed spans, and every occurrence of a seed or candidate in context."""
    import pyarrow as pa
    from pyspark import TaskContext

    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    seen = pa.struct([("kind", pa.int32()), ("may", pa.list_(pa.int32())), ("start", pa.int32()), ("end", pa.int32()),
                      ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        keys, bases, founds = [], [], []
        for value in batch.column(1):
            text = value.as_py()
            base = base_spans(text)
            spans = [(k, [k], s, e) for k, s, e in base] + [(None, may_be(text[s:e]), s, e) for s, e in candidates(text, base)]
            keys.append((part << 40) + row)
            bases.append([dict(zip(("kind", "start", "end"), b)) for b in base])
            founds.append([{"kind": k, "may": may, "start": s, "end": e, "instance": text[s:e].lower(), "patterns": patterns(text, s, e)}
                           for k, may, s, e in spans])
            row += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), batch.column(0), batch.column(2), pa.array(bases, pa.list_(span)), pa.array(founds, pa.list_(seen))],
            names=["row", "id", "digest", "base", "found"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, digest, base, found) of every document, written once."""
    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.md5(text).alias("digest"))
    rows = texts.mapInArrow(_scan, "row long, id long, digest string, base array<struct<kind:int,start:int,end:int>>, "
                                   "found array<struct<kind:int,may:array<int>,start:int,end:int,instance:string,patterns:array<string>>>")
    return materialize(rows, "scan")


# --- the graph ----------------------------------------------------------------
def _score_patterns(edges: DataFrame, instances: DataFrame) -> DataFrame:
    """Share of a pattern's occurrences that hold instances of a kind, and how many differ."""
    known = edges.join(instances, "instance").groupBy("pattern", "kind").agg(
        F.sum(F.col("n") * F.col("score").cast(EXACT)).alias("hits"), F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("support"))
    total = edges.groupBy("pattern").agg(F.sum("n").alias("n"))
    scored = known.join(total, "pattern").withColumn("reliability", F.col("hits").cast("double") / F.col("n"))
    return scored.select("pattern", "kind", "support", "reliability")


def bootstrap(scans: DataFrame, rounds: int = ROUNDS, reliable: float = RELIABLE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, reliability) of the patterns that may extract."""
    seen = scans.select(F.explode("found").alias("f")).select("f.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance").groupBy("pattern", "instance").agg(F.count("*").alias("n"))
    edges = materialize(edges, "edges")
    seeds = seen.filter("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("score", F.lit(1.0))
    may = seen.filter("kind IS NULL").select("instance", F.explode("may").alias("kind")).distinct()
    may = materialize(may.join(seeds.select("instance").distinct(), "instance", "left_anti"), "unseen")
    seeds = materialize(seeds, "seeds")
    instances = seeds
    for _ in range(rounds):
        scored = materialize(_score_patterns(edges, instances), "patterns")
        good = scored.filter((F.col("support") >= support) & (F.col("reliability") >= reliable / 2))
        belief = F.least(F.col("reliability"), F.lit(0.99)) * (1 - 1 / (1 + F.col("support")))
        learnt = edges.join(good, "pattern").join(may, ["instance", "kind"]).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - belief).cast(EXACT)).cast("double"))).alias("score"))
        instances = materialize(seeds.unionByName(learnt), "instances")
    scored = _score_patterns(edges, instances)
    return materialize(scored.filter((F.col("support") >= support) & (F.col("reliability") >= reliable))
                       .select("pattern", "kind", "reliability"), "accepted")


def discovered(scans: DataFrame, accepted: DataFrame) -> DataFrame:
    """(row, extra) of the documents in which accepted patterns name unseen tokens."""
    spans = scans.select("row", F.explode("found").alias("f")).filter("f.kind IS NULL AND size(f.may) > 0")
    spans = spans.select("row", "f.start", "f.end", "f.may", F.explode("f.patterns").alias("pattern"))
    named = spans.join(accepted, "pattern").filter(F.expr("array_contains(may, kind)"))
    best = F.max(F.struct("reliability", (-F.col("kind")).alias("rank"))).alias("best")
    named = named.groupBy("row", "start", "end").agg(best)
    span = F.struct((-F.col("best.rank")).alias("kind"), "start", "end")
    return named.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("extra"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(row, id, digest, base, extra): arrays of (kind, start, end) for every document."""
    scans = scan(docs, id_col, text_col)
    extra = discovered(scans, bootstrap(scans, **how))
    joined = scans.select("row", "id", "digest", "base").join(extra, "row", "left")
    return joined.withColumn("extra", F.coalesce("extra", F.array().cast("array<struct<kind:int,start:int,end:int>>")))


def as_text(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


# --- redaction ----------------------------------------------------------------
def redact_text(text: str, extra: list[tuple[int, int, int]]) -> str:
    """Spans give way to the kind of the first of those that overlap."""
    parts, free = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in [*base_spans(text), *extra]):
        if start >= free:
            parts += [text[free:start], f"[{KINDS[kind].upper()}]"]
        free = max(free, end)
    return "".join(parts) + text[free:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all spans in the texts replaced; null texts stay null."""
    found = materialize(find(docs, id_col, text_col, **how).filter("size(extra) > 0")
                        .select(F.coalesce("id", F.lit(0)).alias("_id"), "digest", "extra").distinct(), "extra")

    def redact_all(texts, extras):
        import pyarrow as pa

        return pa.array([None if t is None else redact_text(t, [(s["kind"], s["start"], s["end"]) for s in x or []])
                         for t, x in zip(texts.to_pylist(), extras.to_pylist())], pa.string())

    redacted = F.arrow_udf(redact_all, "string")

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"), F.md5(whole_text(text_col)).alias("digest"))
    spans = found.agg(F.sum(F.size("extra") + 1)).first()[0] or 0
    sized = F.broadcast(found) if spans <= BROADCAST_SPANS else found
    rows = rows.join(sized, ["_id", "digest"], "left")
    return rows.select(*[redacted(F.col(f"row.`{c}`"), "extra").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
