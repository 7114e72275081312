from __future__ import annotations

import itertools
import random

import numpy as np
from llm.conftest import docs_frame

from debtscope.llm import language_crf as C

STEMS = {"aa": ["kar", "mol", "tin"], "bb": ["xyl", "quo", "zep"], "cc": ["éan", "ûle", "ôre"]}


def text(lang, n, r):
    return " ".join(r.choice(STEMS[lang]) + r.choice(STEMS[lang]) for _ in range(n))


def rows(n, seed):
    r = random.Random(seed)
    return [(lang, text(lang, 30, r)) for _ in range(n) for lang in STEMS]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    scores, trans, start = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = C.posteriors(scores, np.array([5, 3]), trans, start)[0]
    for i, n in enumerate((5, 3)):
        total = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.exp(start[path[0]] + sum(scores[i, t, c] for t, c in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for t, c in enumerate(path):
                total[t, c] += p
        assert np.allclose(got[i, :n], total / total.sum(1, keepdims=True))


def test_code_switched_words():
    model = C.fit(rows(12, 1))
    assert np.all(np.diag(model.transitions) > model.transitions.max(1, where=~np.eye(3, dtype=bool), initial=-9))
    r = random.Random(9)
    mixed = f"{text('aa', 20, r)} {text('cc', 15, r)} {text('bb', 90, r)}"
    post = C.Labeller(model).label([mixed, "", text("bb", 3, r)])
    truth = [0] * 20 + [2] * 15 + [1] * 90
    assert (post[0].argmax(1) == truth).mean() > 0.95 and len(post[1]) == 0 and post[2].mean(0).argmax() == 1


def test_predict(spark, edge_docs, no_docs):
    held = [(i, t, lang, "s") for i, (lang, t) in enumerate(rows(40, 2))]
    df = docs_frame(spark, held)
    sample = C.training_rows(df, ~C.held_out(), per_lang=15)
    assert len(sample) == 45
    model = C.fit(sample)
    got = {r.id: r for r in C.predict(df, model, runs=True).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in held]) > 0.97
    assert all(0 <= r.score <= 1 and sum(s.words for s in r.runs) == 30 for r in got.values())
    edge = {r.id: r for r in C.predict(edge_docs, model).collect()}
    assert [edge[i].lang_pred for i in (2, 3, 7)] == ["und"] * 3 and edge[2].score == 0.0 and edge[4].lang_pred != "und"
    assert C.predict(no_docs, model).count() == 0
    nothing = C.fit(C.training_rows(no_docs, ~C.held_out()))
    assert {r.lang_pred for r in C.predict(edge_docs, nothing).collect()} == {"und"}


def test_whole_texts_are_one_chain():
    """Blocks with messages give what forward-backward over the whole text gives."""
    rng = np.random.default_rng(5)
    trans, start = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    sizes = [1, 5, 8, 9, 16, 17, 40, 3, 8]
    texts = [rng.normal(size=(n, 3)) * 3 for n in sizes]
    owner = np.concatenate([[i] * -(-n // 8) for i, n in enumerate(sizes)])
    lengths = np.concatenate([[8] * (n // 8) + [n % 8] * (n % 8 > 0) for n in sizes])
    blocks = np.full((len(owner), 8, 3), 7.0)
    at = 0
    for text in texts:
        for lo in range(0, len(text), 8):
            blocks[at, :len(text[lo:lo + 8])] = text[lo:lo + 8]
            at += 1
    got, at = C.whole_chains(blocks, lengths, owner, trans, start), 0
    for text in texts:
        want = C.posteriors(text[None], np.array([len(text)]), trans, start)[0][0]
        for lo in range(0, len(text), 8):
            assert np.allclose(got[at, :len(text[lo:lo + 8])], want[lo:lo + 8])
            at += 1


def test_switch_at_a_block_boundary(monkeypatch):
    model, r = C.fit(rows(12, 1)), random.Random(4)
    mixed = f"{text('aa', 64, r)} {text('bb', 64, r)} {text('cc', 500, r)}"
    (post,) = C.Labeller(model).label([mixed])
    assert (post.argmax(1) == [0] * 64 + [1] * 64 + [2] * 500).mean() > 0.97
    monkeypatch.setattr(C, "WINDOW", 1000)
    (whole,) = C.Labeller(model).label([mixed])
    assert np.allclose(post, whole, atol=1e-4)


def test_all_of_a_long_word_counts():
    word = "kar" * 66 + "xy"
    assert len(C.features(word)) == 7 + 201 + 200
    model = C.fit(rows(12, 1))
    # the head of the run is of one language, the rest of another
    (post,) = C.Labeller(model).label(["kar" * 20 + "xyl" * 60])
    assert post.mean(0).argmax() == 1


def test_rows_without_an_id_are_told_apart(spark):
    held = [(None, t, lang, "s") for lang, t in rows(40, 2)]
    samples = [C.training_rows(docs_frame(spark, held).repartition(n), ~C.held_out(), per_lang=15) for n in (1, 5)]
    assert samples[0] == samples[1] and len(samples[0]) == 45
    assert {lang for lang, _ in C.training_rows(docs_frame(spark, held), ~C.held_out(), per_lang=5, max_langs=2)} == {"aa", "bb"}
