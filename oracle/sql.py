"""SQL text per registered query.

Written row by row with windows and joins, on purpose unlike the Spark side, which
works on one nested row per repository.  Only the derivation of the input rows, fixed
values and wordings are shared.
"""

from __future__ import annotations

import re

from debtscope import constants as C
from debtscope import fixtures as X
from debtscope import messages as M


def q(text: str) -> str:
    """SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def slots(template: str, **values: str) -> str:
    """Template as a SQL concatenation."""
    parts = []
    for piece in re.split(r"(?<!\{)(\{\w+\})(?!\})", template):
        name = piece[1:-1]
        if piece.startswith("{") and name in values:
            parts.append(f"CAST({values[name]} AS VARCHAR)")
        elif piece:
            parts.append(q(piece.replace("{{", "{").replace("}}", "}")))
    return "(" + " || ".join(parts) + ")"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


CTES: dict[str, str] = {}


def layered(source: str, layers: list[dict[str, str]]) -> str:
    text = source
    for layer in layers:
        columns = ", ".join(f"{e.replace('{bytes}', 'strlen')} AS {n}" for n, e in layer.items())
        text = f"(SELECT *, {columns} FROM {text})"
    return f"SELECT * FROM {text}"


def columns(spec: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in spec.items())


LANGUAGE = (
    "coalesce(CASE lower(split_part(path, '.', -1)) "
    + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in C.LANGUAGES.items())
    + f" END, {q(C.OTHER_LANGUAGE)})"
)
RULE = (
    "CASE "
    + " ".join(f"WHEN {matches('path', p)} THEN {i}" for i, (p, _) in enumerate(C.FRAMEWORK_RULES, 1))
    + " END"
)
FRAMEWORK = (
    "CASE min(rule) "
    + " ".join(f"WHEN {i} THEN {q(n)}" for i, (_, n) in enumerate(C.FRAMEWORK_RULES, 1))
    + f" ELSE {q(C.FRAMEWORK_DEFAULT)} END"
)
LINES = "CAST(len(body) - len(replace(body, chr(10), '')) + 1 AS INTEGER)"
MARKERS = f"CAST(len(regexp_extract_all(body, {q(C.MARKERS)})) AS INTEGER)"
FUNCTIONS = f"CAST(len(regexp_extract_all(body, {q(C.FUNCTIONS)})) AS INTEGER)"
SCORE = (
    "CAST(least(100, round(lines / 8.0 + markers * 8 + greatest(0, functions - 8) * 3)) AS INTEGER)"
)
SIGNALS = (
    "[x FOR x IN [CASE WHEN lines > 250 THEN 'large file' END, "
    "CASE WHEN markers > 0 THEN markers || ' maintenance markers' END, "
    "CASE WHEN functions > 8 THEN 'high function density' END] IF x IS NOT NULL]"
)
CODE = matches("path", C.CODE_FILE)
BASE_NAME = "nullif(regexp_replace(split_part({t}, '/', -1), '[.][^.]+\\z', ''), '')"
BRANCH_RANK = "list_position([" + ", ".join(q(b) for b in C.BRANCHES) + "], branch)"
CREATED_AT = f"to_timestamp({X.AS_OF_EPOCH} - ({{age}}) * 60)::TIMESTAMP"


def created(age: str) -> str:
    return f"(TIMESTAMP '1970-01-01' + to_seconds({X.AS_OF_EPOCH} - ({age}) * 60))"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


AS_OF = f"(TIMESTAMP '1970-01-01' + to_seconds({X.AS_OF_EPOCH}))"

# --- derived inputs -----------------------------------------------------------
CTES["file_layers"] = layered("documents", X.FILE_LAYERS)
CTES["repo_files"] = "SELECT repo_id, pos, type, path, size, content FROM file_layers"
CTES["repo_ids"] = "SELECT DISTINCT repo_id FROM file_layers"
CTES["landed"] = f"SELECT repo_id, {columns(X.REPO_COLUMNS)} FROM repo_ids"
CTES["repos"] = """
SELECT repo_id, 'org' || (repo_id % 5) AS owner, 'repo' || repo_id AS repository,
       'https://github.com/org' || (repo_id % 5) || '/repo' || repo_id AS url, status,
       coalesce(json_extract_string(metadata, '$.description'), '') AS description,
       coalesce(CAST(json_extract(metadata, '$.stargazers_count') AS BIGINT), 0) AS stars,
       json_extract_string(metadata, '$.default_branch') AS default_branch, message
FROM landed"""
CTES["bodies"] = "SELECT repo_id, path, content FROM repo_files WHERE type = 'blob' AND pos % 17 <> 0"
CTES["archives"] = f"""
SELECT repo_id, {X.ARCHIVE_BRANCH} AS branch, pos, {X.ARCHIVE_NAME} AS name, content
FROM file_layers WHERE {X.ARCHIVE_FILTER}"""
CTES["attempts"] = f"""
SELECT repo_id, b AS branch, {X.ATTEMPT_STATUS} AS http_status, {X.ATTEMPT_ERROR} AS error
FROM landed, (VALUES {', '.join(f'({q(b)})' for b in C.BRANCHES)}) v(b) WHERE {X.ATTEMPT_FILTER}"""


def latest(source: str, keys: str) -> str:
    """All versions as rows, then the last one of those that came in time."""
    versions = " UNION ALL ".join(f"SELECT * EXCLUDE (payload), {p} AS payload, {m} AS m FROM ({source}) WHERE payload IS NOT NULL" for m, p in X.OVERLAY_VERSIONS)
    return f"SELECT * FROM ({versions}) WHERE m <= 0 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY m DESC, payload DESC) = 1"


CTES["overlays"] = latest(" UNION ALL ".join(
    f"SELECT repo_id, {q(stage)} AS stage, {payload} AS payload FROM repo_ids"
    for stage, payload in X.OVERLAYS.items()
), "repo_id, stage")
CTES["parsed_overlays"] = f"""
SELECT repo_id, stage, CASE WHEN json_valid(payload) THEN {q(C.SOURCE_OVERLAY)} ELSE {q(C.SOURCE_FALLBACK)} END AS source,
       CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload END END AS j
FROM overlays WHERE payload IS NOT NULL"""
CTES["questions"] = f"SELECT {columns(X.QUESTIONS)} FROM conversations WHERE role = 'user'"
_answers = latest(f"SELECT {X.QUESTIONS['question_id']} AS question_id, {X.ANSWER_OVERLAY} AS payload FROM conversations WHERE role = 'user'", "question_id")
CTES["answer_overlays"] = f"SELECT question_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM ({_answers})"
CTES["repo_urls"] = f"SELECT {columns(X.REPO_URLS)} FROM pages"
CTES["repo_uses"] = f"SELECT {columns(X.REPO_USES)} FROM events"
CTES["error_rows"] = f"SELECT {columns(X.ERROR_ROWS)} FROM events"
CTES["stream_reports"] = f"""
SELECT analysis_id, {created('age_minutes')} AS created_at FROM (SELECT {columns(X.STREAM_REPORTS)} FROM events)"""

# --- sampling and metrics -----------------------------------------------------
CTES["measured"] = f"""
SELECT *, {LINES} AS lines, {MARKERS} AS markers, {FUNCTIONS} AS functions
FROM (SELECT *, content AS body FROM repo_files)"""
CTES["s_files"] = f"""
SELECT repo_id, pos, path, size, lines, markers, functions FROM measured WHERE type = 'blob' AND body <> '' AND {CODE}"""


def profile(prefix: str, repos: str) -> None:
    """Figures of the files in ``{prefix}_files`` for each row of ``repos``."""
    p = prefix
    CTES[f"{p}_scored"] = f"""
SELECT *, {SCORE} AS score, {SIGNALS} AS signals, {LANGUAGE} AS language, {RULE} AS rule,
       nullif(split_part(path, '/', 1), '') AS root, {matches('path', C.ENTRY_POINT)} AS is_entry,
       {matches('path', C.LAYER_VIOLATION)} AS is_violation
FROM (SELECT *, CAST(NULL AS INTEGER) AS unused FROM {p}_files)"""
    CTES[f"{p}_hot"] = f"""
SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, pos) AS rn
FROM {p}_scored WHERE score > 15 QUALIFY rn <= 6"""
    CTES[f"{p}_languages"] = f"""
SELECT repo_id, language, CAST(count(*) AS INTEGER) AS n,
       row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, min(pos)) AS rn
FROM {p}_scored GROUP BY repo_id, language QUALIFY rn <= 5"""
    CTES[f"{p}_roots"] = f"""
SELECT repo_id, root, row_number() OVER (PARTITION BY repo_id ORDER BY min(pos)) AS rn
FROM {p}_scored WHERE root IS NOT NULL GROUP BY repo_id, root QUALIFY rn <= 8"""
    CTES[f"{p}_entries"] = f"""
SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS rn
FROM {p}_scored WHERE is_entry QUALIFY rn <= 6"""
    CTES[f"{p}_violations"] = f"""
SELECT repo_id, {slots(M.VIOLATION, path='path')} AS message,
       row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS rn
FROM {p}_scored WHERE is_violation QUALIFY rn <= 3"""
    CTES[f"{p}_profile"] = f"""
SELECT r.repo_id, coalesce(c.n, 0) AS sampled, coalesce(c.framework, {q(C.FRAMEWORK_DEFAULT)}) AS framework,
       coalesce(h.total, 0) AS total, coalesce(h.n, 0) AS n_hot, h.paths AS hot_paths, h.hot_text,
       coalesce(h.first_path, c.first_path, {q(M.DEFAULT_TARGET)}) AS target,
       coalesce(ro.roots, '') AS roots, coalesce(l.languages, '') AS languages,
       coalesce(e.entries, '') AS entries, coalesce(v.violations, '') AS violations,
       coalesce(e.n, 0) AS n_entries, coalesce(v.n, 0) AS n_violations
FROM {repos} r
LEFT JOIN (SELECT repo_id, CAST(count(*) AS INTEGER) AS n, {FRAMEWORK} AS framework,
                  arg_min(path, pos) AS first_path FROM {p}_scored GROUP BY repo_id) c USING (repo_id)
LEFT JOIN (SELECT repo_id, CAST(round(avg(score)) AS INTEGER) AS total, CAST(count(*) AS INTEGER) AS n,
                  list(path ORDER BY rn) AS paths, arg_min(path, rn) AS first_path,
                  list({{'path': path, 'lines': lines, 'score': score, 'signals': signals}} ORDER BY rn) AS hot_text
           FROM {p}_hot GROUP BY repo_id) h USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(root, '|' ORDER BY rn) AS roots FROM {p}_roots GROUP BY repo_id) ro USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(language || ' ' || n, '|' ORDER BY rn) AS languages
           FROM {p}_languages GROUP BY repo_id) l USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(path, '|' ORDER BY rn) AS entries, count(*) AS n FROM {p}_entries GROUP BY repo_id) e USING (repo_id)
LEFT JOIN (SELECT repo_id, string_agg(message, '|' ORDER BY rn) AS violations, count(*) AS n
           FROM {p}_violations GROUP BY repo_id) v USING (repo_id)"""


profile("s", "repo_ids")

# --- snapshot routes ----------------------------------------------------------
CTES["listing_capped"] = f"""
SELECT repo_id, pos, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS rn
FROM repo_files WHERE type = 'blob' AND size <= 45000 AND {CODE} QUALIFY rn <= 75"""
CTES["listed"] = f"""
SELECT c.repo_id, c.pos, c.path, c.size, {LINES} AS lines, {MARKERS} AS markers, {FUNCTIONS} AS functions
FROM repo_files c JOIN (SELECT repo_id, path, content AS body FROM bodies) b
  ON c.repo_id = b.repo_id AND c.path = b.path WHERE body <> '' AND c.type = 'blob' AND {CODE.replace('path', 'c.path', 1)}"""
CTES["archive_kept"] = f"""
SELECT *, {LINES} AS lines, {MARKERS} AS markers, {FUNCTIONS} AS functions, {BRANCH_RANK} AS brank FROM (
  SELECT repo_id, branch, pos, substr(name, strpos(name, '/') + 1) AS path, content AS body,
         CAST(length(content) AS BIGINT) AS size
  FROM archives WHERE strpos(name, '/') > 0 AND name NOT LIKE '%/')
WHERE {CODE} AND body <> ''"""
CTES["archived"] = """
SELECT * FROM (SELECT *, min(brank) OVER (PARTITION BY repo_id) AS best FROM archive_kept) WHERE brank = best"""
CTES["reasons"] = f"""
SELECT repo_id, arg_max(coalesce(error, CASE WHEN http_status <> 200
         THEN {slots(M.ARCHIVE_STATUS, branch='branch', status='http_status')}
         ELSE {slots(M.ARCHIVE_EMPTY, branch='branch')} END), {BRANCH_RANK}) AS reason
FROM attempts GROUP BY repo_id"""
CTES["sample_texts"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS pos, {q(path)} AS path, {q(text)} AS body"
    for i, (path, text) in enumerate(M.SAMPLE_FILES)
)
CTES["sample_files"] = f"""
SELECT pos, path, CAST(length(body) AS BIGINT) AS size, {LINES} AS lines, {MARKERS} AS markers,
       {FUNCTIONS} AS functions FROM sample_texts"""
CTES["resolved"] = f"""
SELECT repo_id, owner, repository, url, status, route,
       CASE route WHEN 'listing' THEN description WHEN 'sample' THEN {q(M.SAMPLE_DESCRIPTION)} ELSE '' END AS description,
       CASE route WHEN 'listing' THEN stars ELSE 0 END AS stars,
       CASE route WHEN 'listing' THEN default_branch WHEN 'archive' THEN branch
                  WHEN 'sample' THEN {q(M.SAMPLE_BRANCH)} END AS default_branch,
       CASE route WHEN 'sample' THEN coalesce(reason, {q(M.ARCHIVE_DEFAULT)}) END AS fallback_reason,
       CASE route WHEN 'listing' THEN coalesce(entries, 0) > 75 WHEN 'archive' THEN n_archived >= 75
                  ELSE false END AS over_75, false AS truncated, CASE route WHEN 'error' THEN message END AS message
FROM (
  SELECT r.*, a.branch, a.n_archived, t.entries, reasons.reason,
         CASE WHEN r.status = 200 THEN 'listing' WHEN r.status = 403 AND a.repo_id IS NOT NULL THEN 'archive'
              WHEN r.status = 403 THEN 'sample' ELSE 'error' END AS route
  FROM repos r
  LEFT JOIN (SELECT repo_id, branch, count(*) AS n_archived FROM archived GROUP BY repo_id, branch) a USING (repo_id)
  LEFT JOIN (SELECT repo_id, count(*) AS entries FROM repo_files GROUP BY repo_id) t USING (repo_id)
  LEFT JOIN reasons USING (repo_id))"""
CTES["r_files"] = """
SELECT l.repo_id, l.pos, l.path, l.size, l.lines, l.markers, l.functions FROM listed l JOIN resolved r USING (repo_id) WHERE r.route = 'listing'
UNION ALL
SELECT l.repo_id, l.pos, l.path, l.size, l.lines, l.markers, l.functions FROM archived l JOIN resolved r USING (repo_id) WHERE r.route = 'archive'
UNION ALL
SELECT r.repo_id, l.pos, l.path, l.size, l.lines, l.markers, l.functions FROM resolved r, sample_files l WHERE r.route = 'sample'"""
profile("r", "resolved")

# --- report -------------------------------------------------------------------
def has(j: str, key: str) -> str:
    return f"coalesce(list_contains(json_keys({j}), {q(key)}), false)"


def text(j: str, key: str) -> str:
    return f"json_extract_string({j}, '$.{key}')"


def number(j: str, key: str) -> str:
    return f"try_cast({text(j, key)} AS DOUBLE)"


def over(j: str, key: str, value: str, base: str) -> str:
    return f"CASE WHEN {has(j, key)} THEN {value} ELSE {base} END"


def over_number(j: str, key: str, base: str) -> str:
    read = number(j, key)
    return f"CASE WHEN {has(j, key)} AND ({text(j, key)} IS NULL OR {read} IS NOT NULL) THEN {read} ELSE {base} END"


def string_list(j: str, key: str) -> str:
    return f"CAST(json_extract({j}, '$.{key}') AS VARCHAR[])"


def scaffold(name: str, function: str) -> str:
    pairs = [(M.SCAFFOLD_PATH, M.SCAFFOLD_MODULE), (M.SCAFFOLD_TEST_PATH, M.SCAFFOLD_TEST)]
    items = ", ".join(
        f"{{'path': {slots(p, name=name)}, 'content': {slots(c, name=name, fn=function)}}}" for p, c in pairs
    )
    return f"[{items}]"


def base_scaffolds(target: str) -> str:
    name = f"coalesce({BASE_NAME.format(t=target)}, {q(M.DEFAULT_MODULE)})"
    return scaffold(name, f"('create' || {name})")


def fallback_scaffolds(target: str) -> str:
    path = f"coalesce(nullif({target}, ''), {q(M.FALLBACK_TARGET)})"
    plain = f"coalesce({BASE_NAME.format(t=path)}, {q(M.FALLBACK_MODULE)})"
    word = f"coalesce(nullif(regexp_replace({plain}, '[^\\w]', '', 'g'), ''), {q(M.FALLBACK_MODULE)})"
    return scaffold(word, f"('create' || upper(left({word}, 1)) || substr({word}, 2))")


def steps(target: str) -> str:
    name = f"coalesce({BASE_NAME.format(t=target)}, {q(M.DEFAULT_MODULE)})"
    module = slots(M.STEP_MODULE, path=slots(M.SCAFFOLD_PATH, name=name), fn=f"('create' || {name})")
    return f"[{module}, {slots(M.STEP_CONTRACT, name=name)}, {slots(M.STEP_TEST, path=slots(M.SCAFFOLD_TEST_PATH, name=name), target=target)}]"


def cost_of(score: str) -> str:
    return f"CAST(greatest(250, round({score} * 18)) AS DOUBLE)"


def priority_of(cost: str) -> str:
    return f"CASE WHEN {cost} > 1200 THEN 'High' WHEN {cost} > 650 THEN 'Medium' ELSE 'Low' END"


def months_of(cost: str) -> str:
    return f"CAST(greatest(1, round({cost} / 260)) AS DOUBLE)"


SIGNED = "list_transform(hot_text, lambda h: {'path': h.path, 'lines': h.lines, 'score': CAST(h.score AS DOUBLE), 'signals': h.signals})"
HOT_JSON = (
    "from_json(json_extract(debt_j, '$.hotspots'), "
    "'[{\"path\":\"VARCHAR\",\"lines\":\"INTEGER\",\"score\":\"DOUBLE\",\"signals\":[\"VARCHAR\"]}]')"
)
FILES_JSON = "from_json(json_extract(refactor_j, '$.scaffolds'), '[{\"path\":\"VARCHAR\",\"content\":\"VARCHAR\"}]')"
_stage_joins = "\n".join(
    f"LEFT JOIN (SELECT repo_id, source AS {s}_source, j AS {s}_j FROM parsed_overlays WHERE stage = {q(s)}) USING (repo_id)"
    for s in C.STAGE_KEYS
)
CTES["report_base"] = f"""
SELECT * EXCLUDE ({', '.join(f'{s}_source' for s in C.STAGE_KEYS)}),
       {', '.join(f"coalesce({s}_source, {q(C.SOURCE_BASE)}) AS {s}_source" for s in C.STAGE_KEYS)},
       {over_number('debt_j', 'totalDebtScore', 'CAST(total AS DOUBLE)')} AS total_debt_score,
       {cost_of(f"coalesce(nullif({over_number('debt_j', 'totalDebtScore', 'CAST(total AS DOUBLE)')}, 0), total)")} AS base_cost
FROM resolved JOIN r_profile USING (repo_id)
{_stage_joins}
WHERE route <> 'error'"""
CTES["report_fields"] = f"""
SELECT *,
  {over('architecture_j', 'framework', text('architecture_j', 'framework'), 'framework')} AS o_framework,
  {over('architecture_j', 'violations', string_list('architecture_j', 'violations'), "CASE WHEN violations = '' THEN [] ELSE string_split(violations, '|') END")} AS o_violations,
  {over('architecture_j', 'structure', "CAST(json_extract(architecture_j, '$.structure.sampledFileCount') AS INTEGER)", 'sampled')} AS o_sampled,
  {over('architecture_j', 'structure', "array_to_string(" + string_list('architecture_j', 'structure.rootDirectories') + ", '|')", 'roots')} AS o_roots,
  {over('architecture_j', 'structure', "array_to_string(list_transform(CAST(json_extract(architecture_j, '$.structure.languages') AS VARCHAR[][]), lambda p: p[1] || ' ' || p[2]), '|')", 'languages')} AS o_languages,
  {over('architecture_j', 'structure', "array_to_string(" + string_list('architecture_j', 'structure.entryPoints') + ", '|')", 'entries')} AS o_entries,
  {over('architecture_j', 'summary', text('architecture_j', 'summary'),
        f"CASE WHEN coalesce(fallback_reason, '') <> '' THEN {slots(M.SUMMARY_FALLBACK, reason='fallback_reason')} ELSE {slots(M.SUMMARY_SAMPLED, count='sampled', entries='n_entries', mixed='n_violations')} END")} AS architecture_summary,
  {over('debt_j', 'hotspots', HOT_JSON, f"coalesce({SIGNED}, [])")} AS o_hot,
  {over('debt_j', 'summary', text('debt_j', 'summary'),
        f"CASE WHEN n_hot > 0 THEN {slots(M.DEBT_FOUND, count='n_hot')} WHEN coalesce(fallback_reason, '') <> '' THEN {q(M.DEBT_FALLBACK)} ELSE {q(M.DEBT_NONE)} END")} AS debt_summary,
  {over_number('cost_j', 'annualCost', 'base_cost')} AS annual_cost,
  {over('cost_j', 'priority', text('cost_j', 'priority'), priority_of('base_cost'))} AS priority,
  {over_number('cost_j', 'roiMonths', months_of('base_cost'))} AS roi_months,
  {over('refactor_j', 'target', text('refactor_j', 'target'), 'target')} AS o_target,
  {over('refactor_j', 'steps', string_list('refactor_j', 'steps'), steps('target'))} AS o_steps,
  {over('refactor_j', 'pullRequestTitle', text('refactor_j', 'pullRequestTitle'), slots(M.PR_TITLE, target='target'))} AS pull_request_title,
  {over('refactor_j', 'scaffolds', FILES_JSON, base_scaffolds('target'))} AS plan_scaffolds,
  {over('review_j', 'verdict', text('review_j', 'verdict'), q(C.VERDICT))} AS verdict,
  {over('review_j', 'checks', string_list('review_j', 'checks'), '[' + slots(M.CHECK_FILES, count='sampled') + ', ' + slots(M.CHECK_HOTSPOTS, count='n_hot', total='total') + ', ' + slots(M.CHECK_ADDITIVE, count="'2'", tests="'1'") + ']')} AS checks,
  {over('review_j', 'caveat', text('review_j', 'caveat'), f"CASE WHEN truncated THEN {q(M.CAVEAT)} END")} AS caveat,
  ({' OR '.join(f"{s}_source = {q(C.SOURCE_OVERLAY)}" for s in C.STAGE_KEYS)}) AS is_live,
  {X.uuid_text(X.REPORT_SEED)} AS analysis_id,
  {created(X.REPORT_AGE_MINUTES)} AS created_at
FROM report_base"""
CTES["reports"] = f"""
SELECT *, CASE WHEN len(plan_scaffolds) > 0 THEN plan_scaffolds ELSE {fallback_scaffolds('o_target')} END AS o_scaffolds,
       CASE WHEN is_live THEN 'live' ELSE 'demo' END AS mode, NOT is_live AS is_demo
FROM report_fields"""
CTES["live"] = f"SELECT * FROM reports WHERE created_at >= {AS_OF} - INTERVAL 1 HOUR"
CTES["event_log"] = " UNION ALL ".join(
    f"SELECT analysis_id, repo_id, CAST({2 * i + k} AS INTEGER) AS seq, {q(stage)} AS agent, {q(status)} AS status, "
    f"{q(words.format(stage=stage))} AS rationale FROM reports"
    for i, stage in enumerate(C.STAGES)
    for k, (status, words) in enumerate([("running", M.STAGE_STARTED), ("complete", M.STAGE_ENDED)])
)
CTES["bundle_files"] = f"""
SELECT analysis_id, path, arg_max(content, seq) AS content FROM (
  SELECT analysis_id, unnest(o_scaffolds).path AS path, unnest(o_scaffolds).content AS content,
         unnest(range(len(o_scaffolds))) AS seq FROM reports
  UNION ALL
  SELECT analysis_id, 'README.md', {slots(M.README, url='url', mode='mode')}, 1000000 FROM reports)
GROUP BY analysis_id, path"""

# --- requests -----------------------------------------------------------------
_clean = "regexp_replace(regexp_replace(url, {edge}, '', 'g'), '[\\t\\n\\r]', '', 'g')".format(edge=q(C.URL_EDGE))
_full = C.URL_HTTPS + C.URL_AUTHORITY + C.URL_PATH
CTES["checked_urls"] = f"""
SELECT *, CASE WHEN clean = '' OR clean IS NULL THEN 'missing'
    WHEN NOT {matches('clean', '(?i)^https://')} THEN 'not https'
    WHEN NOT {matches('clean', C.URL_HTTPS + C.URL_AUTHORITY + r'(?:[/?#]|$)')} THEN 'other host'
    WHEN port <> '' AND coalesce(try_cast(port AS INTEGER), 65536) > 65535 THEN 'bad port'
    WHEN owner = '' THEN 'not owner/repository'
    WHEN owner IN ('.', '..') OR repo IN ('.', '..') THEN 'dot segment'
    WHEN repo = '.git' THEN 'empty repository' END AS reject_reason
FROM (SELECT *, regexp_extract(clean, {q(_full)}, 1) AS owner, regexp_extract(clean, {q(_full)}, 2) AS repo,
             regexp_extract(clean, {q(C.URL_PORT)}, 1) AS port
      FROM (SELECT request_id, url, {_clean} AS clean FROM repo_urls))"""
CTES["parsed_urls"] = """
SELECT request_id, owner, regexp_replace(repo, '[.]git$', '') AS repository,
       'https://github.com/' || owner || '/' || regexp_replace(repo, '[.]git$', '') AS canonical_url
FROM checked_urls WHERE reject_reason IS NULL"""
CTES["checked_questions"] = f"""
SELECT *, CASE WHEN length(trimmed) < 3 THEN 'too short' WHEN length(trimmed) > 500 THEN 'too long' END AS question_reason,
       CASE WHEN NOT {matches('analysis_id', C.UUID)} THEN 'not a report id' END AS id_reason
FROM (SELECT *, regexp_replace(regexp_replace(question, {q('^' + C.WHITESPACE + '+')}, ''), {q(C.WHITESPACE + '+$')}, '') AS trimmed
      FROM questions)"""
CTES["answers"] = f"""
SELECT question_id, analysis_id, status, reject_reason,
       CASE WHEN status = 'answered' THEN {over('j', 'answer', text('j', 'answer'), 'base_answer')} END AS answer,
       CASE WHEN status = 'answered' THEN {over_number('j', 'confidence', 'base_confidence')} END AS confidence,
       CASE WHEN status = 'answered' THEN {over('j', 'sourceFiles', string_list('j', 'sourceFiles'), 'base_sources')} END AS source_files
FROM (
  SELECT c.question_id, c.analysis_id, coalesce(id_reason, question_reason) AS reject_reason,
         CASE WHEN coalesce(id_reason, question_reason) IS NOT NULL THEN 'rejected'
              WHEN l.analysis_id IS NOT NULL THEN 'answered' ELSE 'not_found' END AS status,
         {slots(M.ANSWER, target="coalesce(l.o_target, '')", summary="coalesce(l.debt_summary, '')", step="coalesce(l.o_steps[1], '')")} AS base_answer,
         CASE WHEN l.is_demo THEN 0.68::DOUBLE ELSE 0.78::DOUBLE END AS base_confidence,
         list_transform(l.o_hot, lambda h: h.path)[1:4] AS base_sources, o.j
  FROM checked_questions c LEFT JOIN live l USING (analysis_id) LEFT JOIN answer_overlays o USING (question_id))"""



def user_message(status: str, raw: str) -> str:
    redacted = f"regexp_replace({raw}, {q(C.BEARER)}, {q(M.REDACTED)}, 'g')"
    return (
        f"CASE WHEN {status} = 400 THEN {raw} WHEN {status} = 404 THEN {q(M.ERROR_NOT_FOUND)} "
        f"WHEN {status} = 403 THEN {q(M.ERROR_RATE_LIMIT)} "
        f"WHEN {status} = 504 OR {raw} ILIKE '%timeout%' THEN {q(M.ERROR_TIMEOUT)} "
        f"WHEN {raw} ILIKE '%openai%' THEN {q(M.ERROR_PROVIDER)} ELSE {redacted} END"
    )


FINAL: dict[str, str] = {}
F = FINAL

# --- sources and sinks --------------------------------------------------------
F["listing_scan"] = f"""
SELECT repo_id, CAST(page * {X.PAGE_ENTRIES} + row_number() OVER (PARTITION BY repo_id, page ORDER BY pos) - 1 AS BIGINT) AS pos,
       type, path, size
FROM (SELECT *, CAST(floor(pos / {X.PAGE_ENTRIES}) AS BIGINT) AS page FROM repo_files)"""
F["listing_coverage"] = f"""
WITH p AS (SELECT repo_id, CAST(floor(pos / {X.PAGE_ENTRIES}) AS BIGINT) * {X.PAGE_ENTRIES} AS s, count(*) AS n FROM repo_files GROUP BY ALL),
d AS (SELECT * FROM p UNION ALL SELECT repo_id, s + s % 5, n FROM p WHERE s % 3 = 0),
c AS (SELECT repo_id, unnest(range(s, s + n)) AS place, s FROM d),
u AS (SELECT repo_id, place, count(*) AS times FROM c GROUP BY ALL),
g AS (SELECT repo_id, place - coalesce(lag(place) OVER (PARTITION BY repo_id ORDER BY place), -1) - 1 AS hole, times FROM u)
SELECT repo_id, (SELECT count(*) FROM d WHERE d.repo_id = g.repo_id) AS pages, count(*) AS entries,
       CAST(sum(times - 1) AS BIGINT) AS overlapping, count(*) FILTER (hole > 0) AS gaps, CAST(sum(hole) AS BIGINT) AS missing,
       sum(hole) = 0 AS complete FROM g GROUP BY repo_id"""
F["metadata_scan"] = "SELECT repo_id, owner, repository, url, description, stars, default_branch FROM repos"
F["archive_scan"] = f"""
SELECT repo_id, 'b' || (pos % 5) AS branch, CAST(2 AS BIGINT) AS pos, path,
       CAST(length(body) AS BIGINT) AS size, md5(body) AS content_md5
FROM (SELECT *, content AS body FROM repo_files) WHERE {CODE} AND body <> ''
UNION ALL
SELECT repo_id, 'b' || (pos % 5), 4, 'lib/extra.go', length('extra ' || pos), md5('extra ' || pos) FROM repo_files"""
F["sample_snapshot"] = f"""
SELECT r.repo_id, r.description, r.stars, r.default_branch, r.truncated, r.fallback_reason,
       f.pos, f.path, f.size, f.score
FROM resolved r JOIN r_scored f USING (repo_id) WHERE r.route = 'sample'"""
F["report_write"] = f"""
SELECT analysis_id, {iso('created_at')} AS created_at, strftime(created_at, '%Y-%m-%d') AS created_date,
       url, mode, total_debt_score FROM reports"""
F["bundle_write"] = f"""
SELECT analysis_id, {slots(M.BUNDLE_NAME, stamp=f"replace(replace({iso(AS_OF)}, ':', '-'), '.', '-')")} AS file_name,
       CAST(count(*) OVER (PARTITION BY analysis_id) AS INTEGER) AS n_files, path, content FROM bundle_files"""

# --- validation, projections, filters -----------------------------------------
F["url_validate"] = "SELECT request_id, url, reject_reason, reject_reason IS NULL AS is_valid FROM checked_urls"
F["url_parse"] = "SELECT request_id, owner, repository, canonical_url FROM parsed_urls"
F["id_validate"] = "SELECT question_id, analysis_id, id_reason AS reject_reason, id_reason IS NULL AS is_valid FROM checked_questions"
F["question_validate"] = """
SELECT question_id, trimmed, question_reason IS NULL AS is_valid, question_reason AS reject_reason FROM checked_questions"""
F["code_files"] = f"SELECT repo_id, pos, path FROM repo_files WHERE {CODE}"
F["eligible_files"] = "SELECT repo_id, pos, path, size FROM repo_files WHERE type = 'blob' AND size <= 45000"
F["content_truncate"] = """
SELECT repo_id, pos, CAST(length(substr(content, 1, 45000)) AS INTEGER) AS kept_chars,
       md5(substr(content, 1, 45000)) AS content_md5 FROM repo_files"""
F["nonempty_files"] = "SELECT repo_id, pos, path FROM repo_files WHERE content <> ''"
F["strip_archive_root"] = """
SELECT repo_id, branch, pos, array_to_string(string_split(name, '/')[2:], '/') AS path FROM archives WHERE contains(name, '/')"""
F["dashboard_view"] = f"""
SELECT repo_id, owner || '/' || repository AS repository_label, total_debt_score AS debt_score,
       CASE WHEN total_debt_score > 100 THEN 100 ELSE coalesce(total_debt_score, 0) END AS bar_width,
       '$' || regexp_replace(regexp_replace(format('{{:,.3f}}', annual_cost), '0+$', ''), '[.]$', '') AS annual_cost,
       roi_months, priority, verdict, o_framework AS framework, CAST(o_sampled AS INTEGER) AS files_sampled,
       coalesce(nullif(replace(o_roots, '|', ' / '), ''), {q(M.EMPTY_ROOTS)}) AS roots,
       replace(o_languages, '|', ', ') AS languages,
       coalesce(nullif(array_to_string(list_transform(o_hot, lambda h: h.path || ' ' || h.lines || ' lines ' || CAST(h.score AS INTEGER) || ' (' ||
         CASE WHEN len(h.signals) > 0 THEN array_to_string(h.signals, ' / ') ELSE {q(M.EMPTY_SIGNALS)} END || ')'), '; '), ''),
         {q(M.NO_HOTSPOTS)}) AS hotspots, is_demo, {q(' / '.join(C.LAYERS))} AS layers,
       array_to_string(o_violations, '; ') AS violations, architecture_summary, debt_summary, {q(M.ASSUMPTION)} AS assumption,
       pull_request_title, array_to_string(o_steps, '; ') AS steps, array_to_string(checks, '; ') AS checks, caveat
FROM reports"""
F["answer_view"] = """
SELECT question_id, answer, CAST(round(confidence * 100) AS INTEGER) AS confidence_pct,
       array_to_string(source_files, ', ') AS sources FROM answers"""

# --- joins ----------------------------------------------------------------------
F["listing_join_content"] = "SELECT repo_id, pos, path, size, lines, markers, functions FROM listed"
F["snapshot_resolve"] = f"""
SELECT r.repo_id, url, status, route, description, stars, default_branch, fallback_reason, truncated,
       CAST(coalesce(n, 0) AS INTEGER) AS n_files,
       CASE WHEN route = 'error' THEN {user_message('status', f"coalesce(nullif(message, ''), {q(M.ERROR_DEFAULT)})")} END AS user_message
FROM resolved r LEFT JOIN (SELECT repo_id, count(*) AS n FROM r_files GROUP BY repo_id) c USING (repo_id)"""
F["branch_prefer"] = "SELECT repo_id, branch, pos, path, size, lines FROM archived"
F["archive_files"] = f"""
SELECT repo_id, branch, part * {X.PAGE_ENTRIES} + place AS pos, path, size, lines FROM archived JOIN (
  SELECT repo_id, branch, pos, CAST(floor(pos / {X.PAGE_ENTRIES}) AS BIGINT) AS part,
         row_number() OVER (PARTITION BY repo_id, branch, CAST(floor(pos / {X.PAGE_ENTRIES}) AS BIGINT) ORDER BY pos) - 1 AS place
  FROM archives) USING (repo_id, branch, pos)"""
F["missing_snapshots"] = f"""
SELECT repo_id, owner, repository, url, coalesce(reason, {q(M.ARCHIVE_DEFAULT)}) AS fallback_reason
FROM repos LEFT JOIN reasons USING (repo_id)
WHERE status = 403 AND repo_id NOT IN (SELECT repo_id FROM archive_kept)"""
F["overlay_apply"] = f"""
SELECT repo_id, coalesce(o.source, 'deterministic') AS source,
       {over_number('o.j', 'totalDebtScore', 'CAST(total AS DOUBLE)')} AS total_debt_score,
       {over('o.j', 'summary', text('o.j', 'summary'), f"CASE WHEN n_hot > 0 THEN {slots(M.DEBT_FOUND, count='n_hot')} ELSE {q(M.DEBT_NONE)} END")} AS summary,
       array_to_string({over('o.j', 'hotspots', f"list_transform({HOT_JSON.replace('debt_j', 'o.j')}, lambda h: h.path)", 'coalesce(hot_paths, [])')}, '|') AS hotspot_paths
FROM s_profile LEFT JOIN (SELECT * FROM parsed_overlays WHERE stage = 'debt') o USING (repo_id)"""
F["report_lookup"] = """
SELECT question_id, analysis_id, CASE WHEN url IS NULL THEN 'not_found' ELSE 'found' END AS lookup, url, mode
FROM questions LEFT JOIN (SELECT analysis_id, url, mode FROM live) USING (analysis_id)"""
F["stage_timeline"] = f"""
SELECT r.analysis_id, CAST(s.n AS INTEGER) AS stage_no, s.agent, e.rationale IS NOT NULL AS done,
       coalesce(e.rationale, {q(M.STAGE_WAITING)}) AS label
FROM reports r CROSS JOIN (VALUES {', '.join(f'({i}, {q(s)})' for i, s in enumerate(C.STAGES, 1))}) s(n, agent)
LEFT JOIN (SELECT analysis_id, agent, rationale FROM event_log
           WHERE status = 'complete' AND NOT (repo_id % 7 = 3 AND seq > 4)) e
  ON e.analysis_id = r.analysis_id AND e.agent = s.agent"""

# --- per-file metrics -------------------------------------------------------------
_all = "(SELECT *, content AS body FROM repo_files)"
F["line_count"] = f"SELECT repo_id, pos, {LINES} AS line_count FROM {_all}"
F["marker_count"] = f"SELECT repo_id, pos, {MARKERS} AS marker_count FROM {_all}"
F["function_count"] = f"SELECT repo_id, pos, {FUNCTIONS} AS function_count FROM {_all}"
F["debt_score"] = f"SELECT repo_id, pos, path, {SCORE} AS score FROM measured"
F["signals"] = f"SELECT repo_id, pos, array_to_string({SIGNALS}, '|') AS signals FROM measured"
F["file_language"] = f"SELECT repo_id, pos, {LANGUAGE} AS file_language FROM repo_files"
F["path_root"] = "SELECT repo_id, pos, string_split(path, '/')[1] AS path_root FROM repo_files"
F["is_entry_point"] = f"SELECT repo_id, pos, {matches('path', C.ENTRY_POINT)} AS is_entry_point FROM repo_files"
F["is_layer_violation"] = f"SELECT repo_id, pos, {matches('path', C.LAYER_VIOLATION)} AS is_layer_violation FROM repo_files"
F["module_name"] = f"SELECT repo_id, pos, coalesce({BASE_NAME.format(t='path')}, 'Feature') AS module_name FROM repo_files"

# --- aggregations -----------------------------------------------------------------
F["sampled_count"] = "SELECT repo_id, sampled AS sampled_count FROM s_profile"
F["language_histogram"] = "SELECT repo_id, CAST(rn AS INTEGER) AS rank, language, n FROM s_languages"
F["root_directories"] = "SELECT repo_id, CAST(rn AS INTEGER) AS rank, root FROM s_roots"
F["entry_points"] = "SELECT repo_id, CAST(rn AS INTEGER) AS rank, path FROM s_entries"
F["structure_summary"] = """
SELECT repo_id, sampled AS sampled_file_count, roots AS root_directories, languages, entries AS entry_points FROM s_profile"""
F["framework_classify"] = "SELECT repo_id, framework FROM s_profile"
F["truncated_flag"] = "SELECT repo_id, route, over_75 AS truncated FROM resolved"
F["debt_total"] = "SELECT repo_id, total AS debt_total FROM s_profile"
F["run_mode"] = "SELECT repo_id, mode, is_demo FROM reports"
F["violations"] = "SELECT repo_id, CAST(rn AS INTEGER) AS rank, message FROM s_violations"

# --- top-k --------------------------------------------------------------------------
F["sample_cap"] = "SELECT repo_id, pos, path, CAST(rn AS INTEGER) AS rank FROM listing_capped"
F["hotspots"] = """
SELECT repo_id, CAST(rn AS INTEGER) AS rank, path, lines, CAST(score AS DOUBLE) AS score,
       array_to_string(signals, '|') AS signals FROM s_hot"""
F["source_files"] = "SELECT repo_id, CAST(rn AS INTEGER) AS rank, path FROM s_hot WHERE rn <= 4"
F["context_paths"] = """
SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY pos) AS INTEGER) AS rank, path
FROM s_files QUALIFY rank <= 25"""
F["recent_repos"] = """
SELECT user_id, url, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, url) AS INTEGER) AS rank
FROM repo_uses WHERE ok GROUP BY user_id, url QUALIFY rank <= 5"""

# --- business rules -------------------------------------------------------------------
_cost = cost_of("total")
F["repo_debt"] = f"""
SELECT repo_id, total AS debt_total, CAST(cost AS INTEGER) AS annual_cost, {priority_of('cost')} AS priority,
       CAST({months_of('cost')} AS INTEGER) AS roi_months FROM (SELECT *, {_cost} AS cost FROM s_profile)"""
F["cost_estimate"] = f"""
SELECT repo_id, total_debt_score, cost_source AS source, annual_cost, priority, roi_months,
       {q(M.ASSUMPTION)} AS assumption FROM reports"""
F["refactor_target"] = "SELECT repo_id, target FROM s_profile"
F["refactor_plan"] = f"""
SELECT repo_id, {slots(M.PR_TITLE, target='target')} AS pull_request_title,
       CAST(unnest([1, 2, 3]) AS INTEGER) AS step_no, unnest({steps('target')}) AS step FROM s_profile"""
for _name, _files in (("scaffold_rows", base_scaffolds("target")), ("scaffold_fallback", fallback_scaffolds("target"))):
    F[_name] = f"SELECT repo_id, f.path AS path, f.content AS content FROM (SELECT repo_id, unnest({_files}) AS f FROM s_profile)"
F["review_checks"] = """
SELECT repo_id, review_source AS source, verdict, array_to_string(checks, '|') AS checks, caveat FROM reports"""
F["summaries"] = "SELECT repo_id, architecture_summary, debt_summary FROM reports"
F["stage_events"] = f"SELECT analysis_id, seq, agent, status, rationale, {iso(AS_OF)} AS at FROM event_log"
F["grounded_answer"] = """
SELECT question_id, analysis_id, status, reject_reason, answer, confidence,
       array_to_string(source_files, '|') AS source_files FROM answers"""
F["repo_report"] = f"""
SELECT repo_id, analysis_id, owner, repository, url, description, stars, default_branch, fallback_reason, truncated,
       mode, is_demo, {" || '|' || ".join(f'{s}_source' for s in C.STAGE_KEYS)} AS sources,
       o_framework AS framework, {q('|'.join(C.LAYERS))} AS layers, CAST(o_sampled AS INTEGER) AS sampled_file_count,
       o_roots AS root_directories, o_languages AS languages, o_entries AS entry_points,
       array_to_string(o_violations, '|') AS violations, architecture_summary,
       array_to_string(list_transform(o_hot, lambda h: h.path || ':' || h.lines || ':' || CAST(h.score AS INTEGER) || ':' ||
         array_to_string(h.signals, ',')), '|') AS hotspots,
       total_debt_score, debt_summary, annual_cost, priority, roi_months, o_target AS target,
       array_to_string(o_steps, '|') AS steps, pull_request_title,
       array_to_string(list_transform(o_scaffolds, lambda f: f.path), '|') AS scaffold_paths,
       verdict, array_to_string(checks, '|') AS checks, caveat, CAST(10 AS INTEGER) AS n_events
FROM reports"""

# --- set operations ---------------------------------------------------------------------
F["snapshot_union"] = """
SELECT repo_id, route, pos, path, size, lines, score FROM r_scored JOIN resolved USING (repo_id)"""
F["bundle_rows"] = "SELECT analysis_id, path, content FROM bundle_files"
F["bundle_requests"] = """
SELECT c.question_id, c.analysis_id, CASE WHEN id_reason IS NOT NULL THEN 'rejected'
         WHEN l.analysis_id IS NOT NULL THEN 'ready' ELSE 'not_found' END AS status, b.path, md5(b.content) AS content_md5
FROM checked_questions c LEFT JOIN (SELECT analysis_id FROM live) l ON c.analysis_id = l.analysis_id AND c.id_reason IS NULL
LEFT JOIN bundle_files b ON b.analysis_id = l.analysis_id"""

# --- scalar functions -------------------------------------------------------------------
_redacted = f"regexp_replace({{c}}, {q(C.BEARER)}, {q(M.REDACTED)}, 'g')"
F["redact_tokens"] = f"SELECT row_id, {_redacted.format(c='message')} AS message FROM error_rows"
F["classify_errors"] = f"""
SELECT row_id, CAST(final AS INTEGER) AS status, {user_message('final', 'raw')} AS user_message
FROM (SELECT *, coalesce(message, {q(M.ERROR_DEFAULT)}) AS raw,
             CASE WHEN coalesce(status, 0) <> 0 THEN status WHEN is_validation THEN 400 ELSE 500 END AS final
      FROM error_rows)"""
F["short_url"] = "SELECT request_id, owner || '/' || repository AS label FROM parsed_urls"
F["bundle_name"] = f"""
SELECT analysis_id, {slots(M.BUNDLE_NAME, stamp=f"regexp_replace({iso('created_at')}, '[:.]', '-', 'g')")} AS file_name
FROM stream_reports"""

# --- streaming ----------------------------------------------------------------------------
F["live_reports_stream"] = f"""
SELECT DISTINCT analysis_id, {iso('created_at')} AS created_at FROM stream_reports
WHERE created_at >= {AS_OF} - INTERVAL 1 HOUR"""

F["recent_repos_stream"] = F["recent_repos"]
F["report_lookup_keyed"] = F["report_lookup"]


def statement(final: str) -> str:
    """Final SELECT with the CTEs it needs, in order of definition."""
    needed: set[str] = set()
    todo = [final]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in CTES.items() if name in needed)
    if ctes and final.strip().startswith("WITH "):
        return f"WITH {ctes},\n{final.strip()[5:]}"
    return f"WITH {ctes}\n{final.strip()}" if ctes else final.strip()


def all_sql() -> dict[str, str]:
    return {name: statement(final) for name, final in FINAL.items()}
