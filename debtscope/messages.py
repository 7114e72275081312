"""Wording of generated sentences, sample files and scaffold templates.

None of this is computed; each text is a template whose ``{slots}`` are filled by
column expressions (see :func:`debtscope.functions.text.fill`).
"""

from __future__ import annotations

from debtscope import constants as C

VIOLATION = "{path} matches the interface and the service pattern"

SUMMARY_SAMPLED = "{count} code files measured, {entries} entry points, {mixed} mixed paths"
SUMMARY_FALLBACK = "built-in sample measured: {reason}"
DEBT_FOUND = f"{{count}} files score above {C.HOTSPOT_MIN_SCORE}"
DEBT_FALLBACK = "no file of the repository was measured"
DEBT_NONE = f"no file scores above {C.HOTSPOT_MIN_SCORE}"

ASSUMPTION = f"{C.COST_PER_POINT} a year for each score point, {C.COST_PER_MONTH} a month pay back"

STEP_MODULE = "create {path} exporting {fn}"
STEP_CONTRACT = "let callers reach the moved code through {name}Input alone"
STEP_TEST = "run {path} after each move out of {target}"
PR_TITLE = "refactor: move code out of {target}"

CHECK_FILES = "{count} files measured"
CHECK_HOTSPOTS = f"{{count}} of them above {C.HOTSPOT_MIN_SCORE}, mean score {{total}}"
CHECK_ADDITIVE = "{count} files are proposed, of them {tests} with tests; no file of the repository changes"
CAVEAT = "files beyond the limits of the run were not measured"

STAGE_STARTED = "{stage} started"
STAGE_ENDED = "{stage} ended"
STAGE_WAITING = "Not finished yet"

DEFAULT_TARGET = "src/feature.ts"
DEFAULT_MODULE = "Feature"
FALLBACK_TARGET = "src/features/feature.ts"
FALLBACK_MODULE = "feature"

TEST_SUFFIX = ".test.ts"
SCAFFOLD_PATH = "src/features/{name}/{name}.ts"
SCAFFOLD_TEST_PATH = "src/features/{name}/{name}.test.ts"
SCAFFOLD_MODULE = """\
/** Input accepted by {fn}. */
export interface {name}Input {{
  id: string
}}

export const {fn} = (input: {name}Input): {name}Input => Object.freeze({{ ...input }})
"""
SCAFFOLD_TEST = """\
import {{ expect, test }} from 'vitest'
import {{ {fn} }} from './{name}'

test('{fn} returns an equal copy of its input', () => {{
  const input = {{ id: 'a-1' }}
  expect({fn}(input)).toEqual(input)
  expect({fn}(input)).not.toBe(input)
}})
"""

ANSWER = "{target} first: {summary}; {step}"

README = "# Refactor bundle\n\nRepository: {url}\nRun mode: {mode}\n"
BUNDLE_NAME = "refactor-bundle-{stamp}.zip"

ARCHIVE_STATUS = "GitHub archive for branch {branch} answered with status {status}."
ARCHIVE_EMPTY = "GitHub archive for branch {branch} holds no supported source file."
ARCHIVE_DEFAULT = "GitHub archive could not be used."
SAMPLE_DESCRIPTION = "Built-in sample: the repository itself could not be read."
SAMPLE_BRANCH = "main"

NOT_FOUND = "not_found"
EMPTY_ROOTS = "No sub-directories"
EMPTY_SIGNALS = "elevated complexity"
NO_HOTSPOTS = "No hotspot in the sampled files"

ERROR_DEFAULT = "The analysis failed; please try again."
ERROR_NOT_FOUND = "Repository not found; make sure its URL is public."
ERROR_RATE_LIMIT = "The source host limits requests; configure a token or wait."
ERROR_TIMEOUT = "The analysis took too long; the repository may be too large."
ERROR_PROVIDER = "The refinement service failed; base results are used where possible."
REDACTED = "Bearer [redacted]"

# The four files that stand in for a repository nobody could read.
SAMPLE_FILES = [
    (
        "src/billing/invoiceTotals.ts",
        "export type Line = { units: number; price: number }\n"
        "\n"
        "export const invoiceTotal = (lines: Line[]): number =>\n"
        "  lines.reduce((sum, line) => sum + line.units * line.price, 0)\n",
    ),
    (
        "src/widgets/StatusPill.tsx",
        "type Props = { label: string; ok: boolean }\n"
        "\n"
        "export const StatusPill = ({ label, ok }: Props) => (\n"
        "  <span className={ok ? 'pill pill-ok' : 'pill'}>{label}</span>\n"
        ")\n",
    ),
    (
        "server/handlers/health.js",
        "export function health(_request, response) {\n"
        "  response.json({ up: true })\n"
        "}\n",
    ),
    (
        "server/jobs/cleanup.js",
        "export function cleanup(rows, limit) {\n"
        "  return rows.filter((row) => row.age < limit)\n"
        "}\n",
    ),
]
