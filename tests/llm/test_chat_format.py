from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from debtscope.llm import chat_format as C

PIECES = [*C.CONTROLS, "\\", "\\", "<", "[", "/", "s>", " ", "ok", "é", "INST]", "|", "\n"]


def test_round_trip():
    r = random.Random(2)
    for _ in range(4000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "<|x", "user "]),
                  "".join(r.choice(PIECES) for _ in range(r.randint(0, 9)))) for _ in range(r.randint(1, 4))]
        formatted = "".join(C.render_turn(*t)[0] for t in turns)
        parsed = C.parse(formatted)
        assert [p[:2] for p in parsed] == turns
        assert all(C.unescape(formatted[s:e]) == text for _, text, s, e in parsed)
    assert all(C.parse(C.render(role, text, 2)[0])[0][:2] == (role, text) for role in ("user", "assistant", "x") for text in PIECES)


def test_plain_text_is_not_escaped():
    assert C.render_turn("user", "a < b [1] \\n") == ("[INST] a < b [1] \\n [/INST]", 0)
    assert C.render_turn("user", "say [INST] now") == ("[INST] say \\[INST] now [/INST]", 1)


@pytest.mark.parametrize("text", ["[INST] open", "x", " a </s></s>", "<|role|>r<|text|>t", "[/INST]"])
def test_bad_grammar(text):
    with pytest.raises(C.GrammarError):
        C.parse(text)


def test_table(spark):
    hard = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", hard), (1, 0, "user", hard), (2, 0, "system", None), (2, 1, "user", ""), (2, 2, "assistant", "ü" * 70_000),
            (2, 3, "tool", "x"), (2, 4, "assistant", "yes"), (3, 0, "user", "same"), (3, 0, "user", "same"), (3, None, None, "first"), (None, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {n: F.lit("own") for n in ("rendered", "step", "formatted", "n_turns", "loss_mask")})
    got = {r.conv_id: r for r in C.read_back(C.format_chats(df)).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert set(got) == {1, 2, 3, None}
    for conv, row in got.items():
        turns = sorted((r for r in rows if r[0] == conv), key=order)
        source = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(source.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert C.format_chats(df.limit(0)).count() == 0
