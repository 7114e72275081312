"""Chat formatting with a grammar round trip.

A conversation becomes one text of turns between control strings.  Every rendered turn is
parsed again by a deterministic parser and compared with its source; if they differ, the
text is escaped further until they agree: first not at all, then where it holds control
strings or escapes, at last at every character an escape or control string starts with,
which always agrees.  The parser does not know the step; one rule undoes all of them.

Grammar, ``text`` being escaped::

    conversation := turn*
    turn := "[INST] " text " [/INST]"                           user
          | " " text " </s>"                                    assistant
          | "<<SYS>>" text "<</SYS>>"                           system
          | "<|role|>" role "<|text|>" text "<|end|>"           any other role

Rows are rendered and checked where they are read; only then are the turns of a
conversation brought together, in order, by a sorted shuffle whose task holds one
conversation.  Defined results: null texts and roles are empty; turns with an equal number
come by role and text, null numbers first; repeated rows are repeated turns; only the four
named columns are read; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debtscope.shipping import ship_by_value

ship_by_value(__name__)

#: Opening and closing strings by role.
ROLES = {
    "user": ("[INST] ", " [/INST]"),
    "assistant": (" ", " </s>"),
    "system": ("<<SYS>>", "<</SYS>>"),
}
OTHER = ("<|role|>", "<|text|>", "<|end|>")
CONTROLS = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", *OTHER]
_CONTROL = "|".join(map(re.escape, CONTROLS))
_ESCAPED = re.compile(r"\\([\\<\[])")
#: What the parser sees: an escaped character, or a control string.
_TOKEN = re.compile(rf"\\[\\<\[]|({_CONTROL})")
_CONFLICT = re.compile(rf"(?={_CONTROL})|\\(?=[\\<\[]|$)")


def escape(text: str, step: int) -> str:
    """Step 0 leaves the text, 1 escapes conflicting places, 2 all that could be one."""
    if step == 0:
        return text
    if step == 1:
        return _CONFLICT.sub(lambda m: "\\\\" if m[0] else "\\", text)
    return re.sub(r"([\\<\[])", r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str, step: int) -> tuple[str, int, int]:
    """A turn, and where in it the escaped text starts and ends."""
    if role in ROLES:
        before, after = ROLES[role]
    else:
        before, after = OTHER[0] + escape(role, 2) + OTHER[1], OTHER[2]
    body = escape(text, step)
    return before + body + after, len(before), len(before) + len(body)


class GrammarError(ValueError):
    """The text is not a conversation of the grammar."""


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; places are those of the escaped text."""
    marks = [(m[1], *m.span()) for m in _TOKEN.finditer(formatted) if m[1]]
    turns, at, k = [], 0, 0

    def expect(name: str) -> tuple[int, int]:
        nonlocal k
        if k >= len(marks) or marks[k][0] != name:
            raise GrammarError(f"{name} expected after {at}")
        k += 1
        return marks[k - 1][1:]

    while at < len(formatted):
        role = "assistant"
        if k < len(marks) and marks[k][1] == at:
            role = {"[INST]": "user", "<<SYS>>": "system", OTHER[0]: "other"}.get(marks[k][0], "")
        if role == "user":
            _, opened = expect("[INST]")
            closed, end = expect("[/INST]")
            start, stop = opened + 1, closed - 1
        elif role == "system":
            _, start = expect("<<SYS>>")
            stop, end = expect("<</SYS>>")
        elif role == "other":
            _, named = expect(OTHER[0])
            name_end, start = expect(OTHER[1])
            role = unescape(formatted[named:name_end])
            stop, end = expect(OTHER[2])
        elif role == "assistant":
            closed, end = expect("</s>")
            start, stop = at + 1, closed - 1
        else:
            raise GrammarError(f"no turn starts with {marks[k][0]}")
        turns.append((role, unescape(formatted[start:stop]), start, stop))
        at = end
    return turns


def render_turn(role: str, text: str) -> tuple[str, int]:
    """The first rendering that parses back to its source, and the escaping it took."""
    for step in range(3):
        rendered = render(role, text, step)[0]
        try:
            turns = parse(rendered)
        except GrammarError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return rendered, step
    raise GrammarError(f"no escaping makes {text[:80]!r} readable")


def _render(batches):
    import pyarrow as pa

    for batch in batches:
        done = [render_turn(role, text) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int32())],
            names=["conv_id", "turn", "role", "text", "rendered", "step"],
        )


def _assemble(batches):
    """Rows sorted by conversation and turn -> one row per conversation, parsed back."""
    import pyarrow as pa

    names = ["conv_id", "formatted", "loss_mask", "n_turns", "n_escaped"]
    mask = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64(), pa.string(), mask, pa.int64(), pa.int64()]

    def conversation(conv, turns):
        formatted = "".join(t[2] for t in turns)
        parsed = parse(formatted)
        if [p[:2] for p in parsed] != [t[:2] for t in turns]:
            raise GrammarError(f"conversation {conv} does not read back")
        spans = [{"start": s, "end": e} for role, _, s, e in parsed if role == "assistant"]
        return conv, formatted, spans, len(parsed), sum(t[3] > 0 for t in turns)

    def rows():
        held, turns = None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5)]
            for conv, *turn in zip(*cols):
                if turns and conv != held:
                    yield conversation(held, turns)
                    turns = []
                held = conv
                turns.append(tuple(turn))
        if turns:
            yield conversation(held, turns)

    def batch_of(some):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)

    some, size = [], 0
    for row in rows():
        some.append(row)
        size += len(row[1])
        if size > 2_000_000:
            yield batch_of(some)
            some, size = [], 0
    if some:
        yield batch_of(some)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_mask, n_turns, n_escaped) of every conversation.

    ``loss_mask`` has the places of the assistant's escaped texts in ``formatted``.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rendered = rows.mapInArrow(_render, "conv_id long, turn long, role string, text string, rendered string, step int")
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(_assemble, "conv_id long, formatted string, loss_mask array<struct<start:int,end:int>>, "
                                         "n_turns long, n_escaped long")


def _read(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        out = []
        for conv, formatted, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
            turns = parse(formatted)
            loss = [unescape(formatted[s["start"]:s["end"]]) for s in spans]
            source = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
            out.append((conv, len(turns), hashlib.sha256(source.encode()).hexdigest(), sum(map(len, loss)),
                        hashlib.sha256("".join(loss).encode()).hexdigest(), len(formatted)))
        cols = list(zip(*out)) or [[]] * 6
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                         names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from ``formatted`` alone."""
    return formatted.select("conv_id", "formatted", "loss_mask").mapInArrow(
        _read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
