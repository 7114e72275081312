"""The queries that SQL can express, for DuckDB."""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
        + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT id) >= 5),
g AS (SELECT rid, k.pos, line, coalesce(owner <> id, false) AS gone FROM k LEFT JOIN f USING (key)),
r AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN r USING (rid)
"""

#: CRC-32 by its reflected polynomial, bit by bit; a turn is known by a digest of fixed length,
#: so a node is a string of them and its ancestors are its beginnings.
OP12 = r"""
WITH t AS (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS dg,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(dg ORDER BY turn NULLS FIRST, dg) AS dgs, list(words ORDER BY turn NULLS FIRST, dg) AS ws FROM t GROUP BY conv_id),
c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
          lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))),
          4294967295) % 4 AS h FROM o),
r AS (SELECT o.conv_id, list_concat(coalesce(b.dgs[1:h], []), o.dgs[h + 1:]) AS dgs, list_concat(coalesce(b.ws[1:h], []), o.ws[h + 1:]) AS ws
      FROM o JOIN c USING (conv_id) LEFT JOIN o AS b ON b.conv_id = o.conv_id - o.conv_id % 20),
v AS (SELECT conv_id, dgs, ws, unnest(range(len(dgs) + 1)) AS d FROM r),
p AS (SELECT array_to_string(dgs[1:d], '') AS node, d, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, conv_id, d = len(dgs) AS e FROM v),
n AS (SELECT node, d, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (e), '')) AS ends_sha256 FROM p GROUP BY node, d),
h AS (SELECT left(node, 32 * (d - 1)) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN h USING (node)),
a AS (SELECT left(node, 32 * j) AS node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
      FROM (SELECT *, unnest(range(d + 1)) AS j FROM k) GROUP BY 1)
SELECT k.conv_id, k.d AS depth, q.conv_id AS parent_conv_id, k.n_convs, CAST(k.n_children AS BIGINT) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN a USING (node) LEFT JOIN n AS q ON k.d > 0 AND q.node = left(k.node, 32 * (k.d - 1))
"""

#: Every kept term of every pair of sources as a row.
OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(any_value(lang_total), 0) AS lang_total, coalesce(any_value(t), 0) AS t
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS t FROM c GROUP BY ALL) USING (lang, source)
      GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (t + v) AS p, coalesce(c.n, 0) AS n,
        1 + CAST(1000000000 AS HUGEINT) * (k.n + 1) // (lang_total + v) AS q
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS x
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x, 0) AS BIGINT) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""


def licence_sql(sentences: dict[str, list[str]], rules: list[tuple[str, str, str, str]], classes: list[str]) -> str:
    """Sentence by sentence as rows, against tables of the fixed values."""
    known = ", ".join(f"('{s}', '{i}')" for i, forms in sentences.items() for s in forms)
    steps, before = [], "seq"
    for k, (rule, pattern, _, _) in enumerate(rules):
        steps.append(
            f"r{k} AS (SELECT *, CASE WHEN n_sentences > 0 THEN len(regexp_extract_all(rest{k}, '{pattern}')) ELSE 0 END AS h{k}, "
            f"regexp_replace(rest{k}, '{pattern}', '|', 'g') AS rest{k + 1} FROM {before})"
        )
        before = f"r{k}"
    lists = ", ".join(f"list_resize([CAST(NULL AS VARCHAR)], 0) || list_transform(range(h{k}), lambda x: '{lic}')" for k, (_, _, lic, _) in enumerate(rules))
    verdict = " ".join(
        "WHEN " + " + ".join(f"h{k}" for k, r in enumerate(rules) if r[3] == kind) + f" > 0 THEN '{kind}'" for kind in classes
    )
    return rf"""
WITH known(s, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, doc_id, regexp_replace(regexp_replace(t, '([.!?;:])[ \t\n\r\f]+', '\1' || chr(1), 'g'),
        '([^,A-Z \t\n\r\f])[ \t\r\f]*\n[ \t\n\r\f]*([^a-z \t\n\r\f])', '\1' || chr(1) || '\2', 'g') AS t FROM d),
p AS (SELECT rid, doc_id, string_split(regexp_replace(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00\x02-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), chr(1)) AS ss FROM m),
s AS (SELECT rid, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM p),
i AS (SELECT rid, count(id) AS n, string_agg('<' || coalesce(id, '?') || '>', '' ORDER BY pos) AS q
      FROM s LEFT JOIN known ON known.s = trim(s.s, ' ') GROUP BY rid),
seq AS (SELECT doc_id, n AS n_sentences, CASE WHEN n > 0 THEN regexp_replace(q, '(<[?]>)+', '<?>', 'g') ELSE '' END AS sequence,
        sequence AS rest0 FROM p JOIN i USING (rid)),
{", ".join(steps)}
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sequence,
       array_to_string(flatten([{lists}]), ',') AS licences, CASE {verdict} ELSE 'none' END AS verdict
FROM {before}
"""
