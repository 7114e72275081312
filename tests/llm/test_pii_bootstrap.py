from __future__ import annotations

import random
import re

from llm.conftest import docs_frame

from debtscope.llm import pii_bootstrap as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    r = random.Random(4)
    for _ in range(8000):
        text = "".join(r.choice("ab.@@-+1 (2)34.9é\n%") for _ in range(r.randint(0, 40)))
        assert P.base_spans(text) == plain(text)
    for text in ["4111 1111 1111 1111 and 4111-1111-1111-1112", "mail a.b@c.de.", "1.2.3.4.5 256.1.1.1 +1 (974) 555-3436"]:
        assert P.base_spans(text) == plain(text)
    long = "1" * 60_000 + "." * 3 + "a" * 60_000 + "@" + "b." * 30_000
    assert P.base_spans(long) == P.base_spans(long) and len(P.base_spans(long)) <= 2


def contact(i, phone):
    return f"Document {i} begins here. Please call extension {phone} today for news number {i}."


def corpus():
    rows = [(i, contact(i, f"+1 (20{i % 9}) 555-01{i:02d}")) for i in range(30)]
    rows += [(100, contact(100, "555-0142-77")), (101, contact(101, "token-77")), (102, "Other words 555-0142-78 here")]
    return [(i, t, "en", "s") for i, t in rows]


def test_bootstrap_discovers(spark):
    got = {r.id: r for r in P.find(docs_frame(spark, corpus())).collect()}
    text = contact(100, "555-0142-77")
    start = text.index("555")
    assert [tuple(s) for s in got[100].extra] == [(3, start, start + 11)]
    assert got[101].extra == [] and got[102].extra == []
    assert all(len(got[i].base) == 1 and got[i].extra == [] for i in range(30))


def test_unreliable_patterns_extract_nothing(spark):
    noise = [(200 + i, contact(i, f"ref{i}x"), "en", "s") for i in range(30)]
    got = P.find(docs_frame(spark, corpus() + noise)).filter("size(extra) > 0").count()
    assert got == 0


def test_redact(spark, edge_docs, no_docs):
    out = P.redact(docs_frame(spark, corpus()))
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[100] == contact(100, "[PHONE]") and texts[3] == contact(3, "[PHONE]") and "token-77" in texts[101]
    same = P.redact(edge_docs)
    assert same.columns == edge_docs.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, edge_docs.collect()))
    assert P.redact_text("x 4111 1111 1111 1111 a@b.co", []) == "x [CARD] [EMAIL]"
    assert P.redact(no_docs).count() == 0 and P.find(no_docs).count() == 0


def test_edge_rows_are_answered_one_by_one(edge_docs, edge_rows):
    got = P.find(edge_docs).select("id", P.as_text(P.F.concat("base", "extra")).alias("spans")).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(i) for i, *_ in edge_rows) and all(r.spans == "" for r in got)


def test_identifiers_with_spaces(spark):
    new = ["(555) 123-4567", "030 1234 5678", "555 123.4567", "(030) 1234/5678", "020 (7946) 0958"]
    rows = corpus() + [(300 + i, contact(i, p), "en", "s") for i, p in enumerate(new)]
    cards = [f"4111 1111 1111 {n:04d}" for n in range(9999) if P.luhn(f"411111111111{n:04d}")]
    paid = "Order {} was paid by card {} last week."
    rows += [(400 + i, paid.format(i, c), "en", "s") for i, c in enumerate(cards[:30])] + [(500, paid.format(7, "4111 1111 1111 1112"), "en", "s")]
    docs = docs_frame(spark, rows)
    got = {r.id: [tuple(s) for s in r.extra] for r in P.find(docs).collect()}
    for i, p in enumerate(new):
        at = contact(i, p).index(p)
        assert got[300 + i] == [(3, at, at + len(p))]
    texts = {r.doc_id: r.text for r in P.redact(docs).collect()}
    assert all(texts[300 + i] == contact(i, "[PHONE]") for i in range(len(new)))
    assert texts[500] == paid.format(7, "[CARD]")


def test_candidate_runs():
    def found(text):
        return [text[s:e] for s, e in P.candidates(text, P.base_spans(text))]
    assert found("call (555) 123-4567, or 030 1234 5678.") == ["(555) 123-4567", "030 1234 5678"]
    assert found("in 1999 and 2001 2002 x 555-0142-77") == ["1999", "2001 2002", "555-0142-77"]
    assert found("v2 12 3 a1234 5678 900 1234") == ["a1234", "5678", "1234"]
    assert found("Office (030 1234 5678), (see 020 7946 0958)") == ["030 1234 5678", "020 7946 0958"]
    assert found("mail a@b.co 4111 1111 1111 1111") == []
    long = "1 " * 60_000
    assert found(long) == []


def test_very_long_numbers_and_words(spark):
    zeros, nines = "0" * 5000 + ".1.1.1", "9" * 5000 + ".1.1.1"
    assert P.base_spans(f"x {zeros} {nines}") == [(1, 2, 2 + len(zeros))]
    docs = docs_frame(spark, [(1, f"x {zeros}", "en", "s"), (2, nines, "en", "s"), (3, "0" * 100_000 + "." + "1" * 100_000, "en", "s")])
    got = {r.id: r for r in P.find(docs).collect()}
    assert len(got[1].base) == 1 and got[2].base == got[3].base == []
    assert {r.doc_id: r.text for r in P.redact(docs).collect()}[1] == "x [IP]"


def test_contexts_have_whole_words():
    long = "w" * 90
    text = f"first second {long} 1.2.3.4 {long}x rest"
    start = text.index("1.2")
    assert P.patterns(text, start, start + 7) == [f"second {long} _", f"{long} _ {long}x"]
    assert P.patterns(f"{long}{long} 1.2.3.4", 181, 188) == [f"^ {long}{long} _", f"{long}{long} _ $"]
    assert P.patterns("1.2.3.4", 0, 7) == ["^ ^ _", "^ _ $"]
    for n in (1, 40, 79, 80, 81, 200):
        text = "a " + "b" * n + " 1.2.3.4 " + "c" * n + " d"
        assert P.patterns(text, n + 3, n + 10) == [f"a {'b' * n} _", f"{'b' * n} _ {'c' * n}"]
