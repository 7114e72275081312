"""Input relations derived from the driver's tables.

The derivation is text that Spark and DuckDB both read, so a query and its oracle start
from the same rows; the operators themselves are written twice.  ``{bytes}`` is the one
function whose name differs.  The number of repositories grows with ``documents``; two
of them hold 30 % and 20 % of all files.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 2, 1, 12, 0, 0, tzinfo=timezone.utc)
AS_OF_EPOCH = int(AS_OF.timestamp())
PAGE_ENTRIES = 64


def _pick(key: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {key} {cases} END"


def _part(key: str, values: str) -> str:
    """Value number ``key`` (0-based) of a comma-separated list."""
    return f"split_part('{values}', ',', CAST({key} AS INT) + 1)"


REPO_ID = (
    "CAST(CASE WHEN doc_id % 10 < 3 THEN 0 WHEN doc_id % 10 < 5 THEN 1 "
    "ELSE 2 + doc_id % 37 + 37 * CAST(floor(doc_id / 1000) AS BIGINT) END AS BIGINT)"
)

DIRS = "src,src/components,src/services,server/routes,api,core,lib,docs,components/serviceCards,services/ui"
BASES = "main,index,server,file,userService,Card,v1.helper"
EXTENSIONS = "ts,tsx,js,jsx,py,java,go,rb,php,cs,rs,vue,svelte,css,html,sql,md,json,TS"
FUNCTION_LINES = "function f() {},const g = (x) =>  {,async function  h2(a) { }"
MARKER_LINES = "// TODO x,# fixme later,/* hackathon */"

# documents -> repo_files, layer by layer; a layer may use the columns of earlier ones.
FILE_LAYERS: list[dict[str, str]] = [
    {
        "repo_id": REPO_ID,
        "pos": "CAST(doc_id AS BIGINT)",
        "type": "CASE WHEN doc_id % 31 = 5 THEN 'tree' ELSE 'blob' END",
        "ext": _part("doc_id % 19", EXTENSIONS),
    },
    {
        "dir": "CASE WHEN doc_id % 11 = 10 THEN '' ELSE CASE WHEN doc_id % 11 = 5 AND repo_id % 3 = 0 THEN 'app' "
        "WHEN doc_id % 11 = 5 AND repo_id % 9 = 2 THEN 'pyproject' "
        f"ELSE {_part('doc_id % 11', DIRS)} END || '/p' || CAST(doc_id AS STRING) || '/' END",
        "base": "CASE WHEN doc_id % 7 = 6 AND repo_id % 3 = 1 THEN 'vite.config' "
        f"ELSE {_part('doc_id % 7', BASES)} END",
        "level": "CAST(CASE repo_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INT)",
    },
    {
        "path": "dir || base || CASE WHEN doc_id % 11 = 10 THEN CAST(doc_id AS STRING) ELSE '' END || '.' || ext",
        "content": "CASE WHEN doc_id % 47 = 3 THEN '' WHEN doc_id % 29 = 0 THEN text || repeat('x', 46000) ELSE "
        f"repeat({_part('doc_id % 3', FUNCTION_LINES)} || chr(10), CAST(CASE level WHEN 0 THEN 0 WHEN 1 THEN doc_id % 11 ELSE doc_id % 23 END AS INT)) "
        f"|| repeat({_part('doc_id % 3', MARKER_LINES)} || chr(10), CAST(CASE level WHEN 0 THEN 0 WHEN 1 THEN doc_id % 4 ELSE doc_id % 6 END AS INT)) "
        "|| repeat(CASE WHEN doc_id % 5 = 0 THEN 'row' || chr(13) ELSE 'row' END || chr(10), "
        "CAST(CASE level WHEN 0 THEN 0 WHEN 1 THEN (doc_id % 13) * 5 ELSE (doc_id % 13) * 30 END AS INT)) || text END",
    },
    {"size": "CAST({bytes}(content) AS BIGINT)"},
]

ARCHIVE_NAME = (
    "CASE WHEN doc_id % 23 = 0 OR (repo_id % 10 = 1 AND repo_id > 1) THEN base || '.' || ext "
    "WHEN type = 'tree' THEN 'root/' || path || '/' ELSE 'root/' || path END"
)
ARCHIVE_BRANCH = (
    "CASE WHEN repo_id < 2 AND ext <> 'md' THEN CASE WHEN doc_id % 4 = 0 THEN 'dev' ELSE 'master' END "
    "WHEN repo_id % 4 = 0 THEN 'main' WHEN ext = 'md' THEN 'main' "
    "WHEN repo_id % 8 = 6 AND doc_id % 2 = 0 THEN 'master' ELSE 'dev' END"
)
# Every document is an archive entry; which repositories use theirs is the route's choice.
ARCHIVE_FILTER = "TRUE"

REPO_COLUMNS = {
    "url": "'https://github.com/org' || CAST(repo_id % 5 AS STRING) || '/repo' || CAST(repo_id AS STRING) "
    "|| CASE repo_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.git' ELSE '/' END",
    "status": "CAST(CASE WHEN repo_id % 5 = 1 THEN 403 WHEN repo_id % 13 = 7 THEN 500 ELSE 200 END AS INT)",
    "message": "CASE WHEN repo_id % 13 = 7 THEN CASE repo_id % 3 WHEN 0 THEN 'upstream TimeOut' "
    "WHEN 1 THEN 'failed: bearer abc.' || CAST(repo_id AS STRING) ELSE '' END END",
    "metadata": "'{' || CASE repo_id % 3 WHEN 0 THEN '\"description\": null, ' WHEN 1 THEN '' "
    "ELSE '\"description\": \"Repository ' || CAST(repo_id AS STRING) || '\", ' END "
    "|| CASE WHEN repo_id % 4 = 0 THEN '' ELSE '\"stargazers_count\": ' || CAST(repo_id * 7 AS STRING) || ', ' END "
    "|| '\"default_branch\": \"' || CASE WHEN repo_id % 2 = 0 THEN 'main' ELSE 'master' END || '\"}'",
}

# Archive attempts of rate-limited repositories, per branch (b is the branch name).
ATTEMPT_STATUS = (
    "CAST(CASE WHEN repo_id % 10 = 6 THEN 200 WHEN repo_id % 20 = 11 AND b = 'dev' THEN 200 "
    "ELSE 404 END AS INT)"
)
ATTEMPT_ERROR = "CASE WHEN repo_id % 7 = 0 AND b = 'dev' THEN 'connection reset' END"
ATTEMPT_FILTER = "status = 403 AND repo_id % 30 <> 1"

OVERLAYS = {
    "architecture": "CASE WHEN repo_id % 8 = 2 THEN '{\"framework\": \"Custom\", \"violations\": null}' "
    "WHEN repo_id % 8 = 3 THEN '{\"structure\": {\"sampledFileCount\": 2, \"rootDirectories\": [\"a\", \"b\"], "
    "\"languages\": [[\"Go\", 2]], \"entryPoints\": []}, \"summary\": \"Two files.\"}' END",
    "debt": "CASE WHEN repo_id % 12 = 1 THEN '{\"totalDebtScore\": 41.5, \"hotspots\": "
    "[{\"path\": \"x/y.ts\", \"lines\": 3, \"score\": 40, \"signals\": []}]}' "
    "WHEN repo_id % 6 = 1 THEN '{\"totalDebtScore\": ' || CAST(repo_id * 3 AS STRING) || '}' "
    "WHEN repo_id % 6 = 2 THEN '{\"totalDebtScore\": null, \"summary\": \"Reviewed.\"}' "
    "WHEN repo_id % 6 = 3 THEN '{\"totalDebtScore\": \"50\"}' "
    "WHEN repo_id % 6 = 4 THEN '{\"totalDebtScore\": 5' "
    "WHEN repo_id % 6 = 5 THEN 'null' END",
    "cost": "CASE WHEN repo_id % 10 = 7 THEN '{\"priority\": \"Medium\", \"roiMonths\": null}' "
    "WHEN repo_id % 10 = 2 THEN '{\"annualCost\": 98765.25}' END",
    "refactor": "CASE WHEN repo_id % 12 = 3 THEN '{\"scaffolds\": [], \"target\": \"src/my-file.name.ts\"}' "
    "WHEN repo_id % 12 = 9 THEN '{\"scaffolds\": [], \"target\": null}' "
    "WHEN repo_id % 12 = 5 THEN '{\"scaffolds\": []}' "
    "WHEN repo_id % 12 = 6 THEN '{\"scaffolds\": [{\"path\": \"README.md\", \"content\": \"mine\"}, "
    "{\"path\": \"a.ts\", \"content\": \"old\"}, {\"path\": \"a.ts\", \"content\": \"new\"}]}' END",
    "review": "CASE WHEN repo_id % 11 = 5 THEN '[1, 2]' "
    "WHEN repo_id % 11 = 8 THEN '{\"verdict\": \"Needs work\", \"checks\": [\"One check.\"]}' END",
}

# Versions of each overlay: minutes from AS_OF, and what they hold; the middle one counts, twice over.
OVERLAY_VERSIONS = [
    (-120, '\'{"summary": "older", "verdict": "older", "answer": "older", "priority": "older"}\''),
    (-30, "payload"),
    (-30, "payload"),
    (60, '\'{"summary": "later", "verdict": "later", "answer": "later", "priority": "later"}\''),
]

URL_CASES = [
    "url",
    "'https://github.com/org/repo' || CAST(page_id AS STRING)",
    "'https://github.com/org/repo' || CAST(page_id AS STRING) || '/'",
    "'https://github.com/org/repo' || CAST(page_id AS STRING) || '.git'",
    "'https://github.com/org/repo' || CAST(page_id AS STRING) || '?tab=x/y'",
    "'HTTPS://GitHub.COM/Org/Repo.' || CAST(page_id AS STRING)",
    "'https://github.com/org/repo' || CAST(page_id AS STRING) || '/issues'",
    "'http://github.com/org/repo' || CAST(page_id AS STRING)",
    "'  https://user:pw@github.com:443/org/r_' || CAST(page_id AS STRING) || '/#top ' || chr(10)",
    "'https://github.com/org/.git'",
    "'https://github.com/../repo' || CAST(page_id AS STRING)",
    "'https://github.com.example.com/org/repo' || CAST(page_id AS STRING)",
    "'https://github.com:' || CAST(65400 + page_id AS STRING) || '/o/r'",
    "'https://github.com/or' || chr(10) || 'g/repo' || CAST(page_id AS STRING)",
    "''",
    "url || 'https://github.com/org/repo'",
]
REPO_URLS = {
    "request_id": "CAST(page_id AS BIGINT)",
    "url": _pick("page_id % 16", URL_CASES),
}


def uuid_text(seed: str) -> str:
    """SQL of a UUID-shaped md5."""
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr(md5({seed}), {start}, {n})" for start, n in cut)


RUN_ID = "run"
REPORT_SEED = f"'{RUN_ID}|' || CAST(repo_id AS STRING)"
REPORT_AGE_MINUTES = "(repo_id % 40) * 4"

# A third of all questions ask about one report.
QUESTIONS = {
    "question_id": "CAST(conv_id * 1000 + turn AS BIGINT)",
    "analysis_id": "CASE WHEN conv_id % 3 = 0 THEN "
    + uuid_text("'run|0'")
    + " WHEN conv_id % 41 = 40 THEN 'not-a-report-id' ELSE "
    + uuid_text("'run|' || CAST(CASE WHEN conv_id % 41 = 39 THEN -1 ELSE conv_id % 41 END AS STRING)")
    + " END",
    "question": "CASE conv_id % 9 WHEN 0 THEN 'hm' WHEN 1 THEN repeat(text, 30) "
    "WHEN 2 THEN chr(160) || '  ' || chr(10) || text || chr(9) || ' ' ELSE text END",
}
ANSWER_OVERLAY = (
    "CASE conv_id % 7 WHEN 1 THEN '{\"answer\": \"Refined.\", \"confidence\": 0.9, \"sourceFiles\": [\"z.ts\"]}' "
    "WHEN 2 THEN '{\"confidence\": null}' WHEN 3 THEN 'oops' END"
)

REPO_USES = {
    "user_id": "user_id",
    "url": "'https://github.com/org' || CAST(event_id % 5 AS STRING) || '/repo' || CAST(event_id % 12 AS STRING)",
    "ts": "ts",
    "ok": "event_type <> 'error'",
}

ERROR_ROWS = {
    "row_id": "CAST(event_id AS BIGINT)",
    "status": "CAST(CASE event_id % 8 WHEN 0 THEN 400 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 504 "
    "WHEN 4 THEN 500 WHEN 5 THEN 502 WHEN 6 THEN 0 END AS INT)",
    "message": "CASE event_id % 5 WHEN 0 THEN event_type || ' failed: bearer  abc.' || CAST(event_id AS STRING) || ', BEARER q!' "
    "WHEN 1 THEN event_type || ' hit a TimeOut' WHEN 2 THEN 'openAI quota' WHEN 3 THEN event_type || ' broke' END",
    "is_validation": "event_id % 3 = 0",
}

# Report rows for the stream: each id arrives twice, ages spread over two hours.
STREAM_REPORTS = {
    "analysis_id": uuid_text("'event|' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING)"),
    "age_minutes": "CAST(floor(event_id / 2) AS BIGINT) % 120",
    "event_type": "event_type",
}


# --- Spark side -------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(name) for name, e in columns.items()])


def _file_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    for layer in FILE_LAYERS:
        df = df.withColumns({k: F.expr(e.replace("{bytes}", "octet_length")) for k, e in layer.items()})
    return df


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["repo_id", "pos", "type", "path", "size", "content"]
    return _file_layers(spark, sf_dir).select(*columns)


def repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(F.expr(REPO_ID).alias("repo_id")).distinct()


def landed_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = repo_ids(spark, sf_dir)
    return ids.withColumns({k: F.expr(e) for k, e in REPO_COLUMNS.items()})


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_files(spark, sf_dir).drop("content")


def listing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as JSON documents of at most ``PAGE_ENTRIES`` entries, and one without a tree each."""
    page = F.expr(f"CAST(floor(pos / {PAGE_ENTRIES}) AS BIGINT)")
    pages = (
        listing(spark, sf_dir)
        .groupBy("repo_id", page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "type", "path", "size"))).alias("entries"))
    )
    tree = F.transform("entries", lambda e: F.struct(e.type.alias("type"), e.path.alias("path"), e.size.alias("size")))
    landed = pages.select(
        "repo_id",
        (F.col("page") * PAGE_ENTRIES).alias("first_pos"),
        F.to_json(F.struct(tree.alias("tree"))).alias("payload"),
    )
    empty = repo_ids(spark, sf_dir).select(
        "repo_id", F.lit(0).cast("bigint").alias("first_pos"), F.lit('{"message": "empty"}').alias("payload")
    )
    return landed.unionByName(empty)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = repo_files(spark, sf_dir).filter("type = 'blob' AND pos % 17 <> 0")
    return files.select("repo_id", "path", "content")


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _file_layers(spark, sf_dir)
        .filter(ARCHIVE_FILTER)
        .select(
            "repo_id",
            F.expr(ARCHIVE_BRANCH).alias("branch"),
            "pos",
            F.expr(ARCHIVE_NAME).alias("name"),
            "content",
        )
    )


def attempts(landed: DataFrame) -> DataFrame:
    from debtscope.constants import BRANCHES

    rows = landed.filter(ATTEMPT_FILTER).select(
        "repo_id", F.explode(F.array(*[F.lit(b) for b in BRANCHES])).alias("b")
    )
    return rows.select(
        "repo_id",
        F.col("b").alias("branch"),
        F.expr(ATTEMPT_STATUS).alias("status"),
        F.expr(ATTEMPT_ERROR).alias("error"),
    )


def overlays(ids: DataFrame) -> DataFrame:
    rows = [
        F.struct(F.lit(stage).alias("stage"), F.expr(payload).alias("payload"))
        for stage, payload in OVERLAYS.items()
    ]
    return _versions(ids.select("repo_id", F.inline(F.array(*rows))).filter("payload IS NOT NULL"))


def _versions(rows: DataFrame) -> DataFrame:
    versions = F.array(*[F.struct(F.lit(m).alias("m"), F.expr(p).alias("payload")) for m, p in OVERLAY_VERSIONS])
    spread = rows.select(*[c for c in rows.columns if c != "payload"], F.inline(versions))
    return spread.withColumn("at", F.timestamp_seconds(F.lit(AS_OF_EPOCH) + F.col("m") * 60)).drop("m")


def repo_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "pages"), REPO_URLS)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "conversations").filter("role = 'user'"), QUESTIONS)


def answer_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    columns = {"question_id": QUESTIONS["question_id"], "payload": ANSWER_OVERLAY}
    return _versions(derived(rows, columns).filter("payload IS NOT NULL"))


def repo_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "events"), REPO_USES)


def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "events"), ERROR_ROWS)


def created_at(age_minutes: str):
    return F.timestamp_seconds(F.expr(f"{AS_OF_EPOCH} - ({age_minutes}) * 60"))


def stream_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(table(spark, sf_dir, "events"), STREAM_REPORTS)
    return rows.withColumn("created_at", created_at("age_minutes")).drop("age_minutes")
