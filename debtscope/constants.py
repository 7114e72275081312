"""Fixed values.

Everything in this module is data, not logic: limits, lookup tables, labels and
patterns whose exact value decides whether a result is right.  They are kept in
one place, in natural order, and are the defaults of the operators' parameters.
"""

from __future__ import annotations

# --- limits ---------------------------------------------------------------
MAX_FILES = 75
MAX_FILE_BYTES = 45_000
TOP_HOTSPOTS = 6
TOP_ROOTS = 8
TOP_LANGUAGES = 5
TOP_ENTRY_POINTS = 6
TOP_VIOLATIONS = 3
TOP_SOURCE_FILES = 4
TOP_CONTEXT_PATHS = 25
TOP_RECENT = 5
HOTSPOT_MIN_SCORE = 15
QUESTION_MIN_CHARS = 3
QUESTION_MAX_CHARS = 500
REPORT_TTL = "1 HOUR"

# --- debt and cost --------------------------------------------------------
MAX_SCORE = 100
LINES_PER_POINT = 8
POINTS_PER_MARKER = 8
FREE_FUNCTIONS = 8
POINTS_PER_EXTRA_FUNCTION = 3
LARGE_FILE_LINES = 250
COST_PER_POINT = 18
MIN_ANNUAL_COST = 250
HIGH_COST = 1200
MEDIUM_COST = 650
COST_PER_MONTH = 260
CONFIDENCE_DEMO = 0.68
CONFIDENCE_LIVE = 0.78

# --- labels that are part of the result's value domain --------------------
SIGNAL_LARGE = "large file"
SIGNAL_MARKERS = "maintenance markers"  # prefixed with the count
SIGNAL_FUNCTIONS = "high function density"
PRIORITY_HIGH, PRIORITY_MEDIUM, PRIORITY_LOW = "High", "Medium", "Low"
VERDICT = "Verified"
MODE_LIVE, MODE_DEMO = "live", "demo"
SOURCE_BASE, SOURCE_OVERLAY, SOURCE_FALLBACK = "deterministic", "overlay", "fallback"
LAYERS = ["presentation", "domain logic", "data/integrations"]
OTHER_LANGUAGE = "Other"

STAGES = ["Architecture", "Technical Debt", "Risk & Cost", "Refactor Planner", "Review"]
STAGE_KEYS = ["architecture", "debt", "cost", "refactor", "review"]

BRANCHES = ["main", "master", "trunk", "develop", "dev"]

LANGUAGES = {
    "js": "JavaScript",
    "jsx": "JavaScript",
    "ts": "TypeScript",
    "tsx": "TypeScript",
    "py": "Python",
    "java": "Java",
    "go": "Go",
    "rb": "Ruby",
    "php": "PHP",
    "cs": "C#",
    "rs": "Rust",
    "vue": "Vue",
    "svelte": "Svelte",
    "css": "CSS",
    "html": "HTML",
    "sql": "SQL",
}

# Path rules, tried in order; the first that matches any file names the framework.
FRAMEWORK_RULES = [
    (r"next[.]config|app/", "Next.js"),
    (r"vite[.]config|src/main[.](?:t|j)sx", "React + Vite"),
    (r"package[.]json", "Node.js / JavaScript"),
    (r"requirements[.]txt|pyproject", "Python"),
]
FRAMEWORK_DEFAULT = "Polyglot application"

# --- patterns -------------------------------------------------------------
# Written so that java.util.regex and RE2 give the same verdict: one explicit
# whitespace class instead of \s, and \z instead of $.
WHITESPACE = "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
CODE_FILE = r"(?i)[.](?:" + "|".join(LANGUAGES) + r")\z"
MARKERS = r"(?i)TODO|FIXME|HACK"
MARKER_WORDS = ["todo", "fixme", "hack"]
FUNCTIONS = "function" + WHITESPACE + r"+\w+|=>" + WHITESPACE + "*[{]"
FUNCTION_HINTS = ["function", "=>"]
ENTRY_POINT = r"(?i)(?:^|/)(?:main|index|app|server|routes?)[.](?:js|jsx|ts|tsx|py)\z"
LAYER_VIOLATION = r"(?i)components?/.+service|services?/.+tsx"

URL_HOST = "github.com"
URL_MAX_PORT = 65535
URL_EDGE = r"^[\x01-\x20]+|[\x01-\x20]+\z"
URL_INNER = r"[\t\n\r]"
URL_HTTPS = r"^(?i:https)://"
URL_AUTHORITY = r"(?:[^/?#\\]*@)?(?i:github[.]com)(?::[0-9]*)?"
URL_PATH = r"/([\w.-]+)/([\w.-]+)/?(?:[?#][\w\W]*)?\z"
URL_PORT = r"^[^/]+//[^/?#]*:([0-9]+)(?:[/?#]|\z)"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
BEARER = r"(?i)Bearer" + WHITESPACE + "+[^" + WHITESPACE[1:-1] + "]+"
TIMEOUT_TEXT = "(?i)timeout"
PROVIDER_TEXT = "(?i)openai"
