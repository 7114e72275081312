"""Language identification by a linear-chain conditional random field over words.

Every word has a label, so code-switched texts get runs of languages.  A word's evidence is
the sum of weights of its affixes, character n-grams, the word itself and its entries in
lexicons learnt with the model; between neighbours stand learnt transition weights.
Forward-backward gives each word's posterior over the languages; a document's language has
the largest mean posterior, and that mean is its score.

The model is fitted on the driver, on a bounded sample of labelled rows: the ``per_lang``
rows of smallest hash for each of the ``MAX_LANGS`` most frequent languages, texts of up to
``MAX_BYTES`` bytes.  Training sequences are blocks of ``WINDOW`` words of these texts and
splices of two of them, from which transitions between languages are learnt.  All documents
are labelled, whole, each as one chain: blocks of many documents advance together, and exact
messages go from block to block.

Defined results: null texts and texts without a letter are ``und`` with score 0; equal
posteriors go to the language that sorts first; rows are answered one by one, repeated ones
too; rows without an id are not held out; only the id and text columns are read for
predictions; without labelled rows all
predictions are ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from debtscope.llm.common import whole_text
from debtscope.shipping import ship_by_value

ship_by_value(__name__)

WINDOW, SLOTS = 64, 1 << 16
#: Bounds of the training sample: rows for each language, bytes of a text.
PER_LANG, MAX_BYTES = 100, 100_000
#: Languages that are learnt.
MAX_LANGS = 64
STEPS, RATE, DECAY = 20, 0.15, 1e-4
#: Different words a task remembers before it starts afresh.
CACHE = 500_000
LETTERS = r"\p{L}[\p{L}\p{M}]*"
UNKNOWN = "und"


def features(word: str) -> list[int]:
    """Slots of a word's affixes, of all its n-grams and of itself."""
    mark = f"^{word}$"
    names = [f"w{word}", *(f"p{mark[:n]}" for n in (2, 3, 4)), *(f"s{mark[-n:]}" for n in (2, 3, 4))]
    names += [mark[k:k + 2] for k in range(len(mark) - 1)] + [mark[k:k + 3] for k in range(len(mark) - 2)]
    return [zlib.crc32(n.encode()) % SLOTS for n in names]


@dataclass
class Model:
    """Weights (slot x language), transitions, start weights and lexicons (word -> language)."""

    languages: list[str]
    weights: object
    transitions: object
    start: object
    lexicon: dict[str, int]
    lexicon_weights: object


def posteriors(scores, lengths, transitions, start, first=None, after=None):
    """Forward-backward for padded sequences (n, time, languages) with their lengths.

    Sequences that go on from others have ``first``, the weights before their first word, and
    ``after``, the message from beyond their last one, a row each.
    """
    import numpy as np

    n, time, k = scores.shape
    step = np.exp(transitions - transitions.max())
    local = np.exp(scores - scores.max(2, keepdims=True))
    alive = np.arange(time)[None, :] < lengths[:, None]
    local[~alive] = 1.0
    forward = np.empty_like(local)
    forward[:, 0] = local[:, 0] * (np.exp(start - start.max()) if first is None else first)
    forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
    for t in range(1, time):
        now = (forward[:, t - 1] @ step) * local[:, t]
        forward[:, t] = now / now.sum(1, keepdims=True)
    end = np.ones((n, k)) if after is None else after
    backward = np.empty_like(local)
    backward[:, -1] = end
    for t in range(time - 2, -1, -1):
        now = (local[:, t + 1] * backward[:, t + 1]) @ step.T
        now /= now.sum(1, keepdims=True)
        backward[:, t] = np.where(alive[:, t + 1, None], now, end)
    both = forward * backward
    return both / both.sum(2, keepdims=True), forward, backward, local, step, alive


def passages(scores, lengths, transitions):
    """What each block does to a message that passes it, as a matrix (n, languages, languages)."""
    import numpy as np

    n, time, k = scores.shape
    step = np.exp(transitions - transitions.max())
    local = np.exp(scores - scores.max(2, keepdims=True))
    through = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(time):
        alive = t < lengths
        if not alive.any():
            break
        now = (through[alive] @ step) * local[alive, t][:, None, :]
        through[alive] = now / now.max((1, 2), keepdims=True)
    return through


def whole_chains(scores, lengths, owner, transitions, start):
    """Posteriors of the words of whole texts, given as blocks in order with the text of each.

    Blocks are evaluated side by side.  First each gives its passage; messages then go from
    block to block, forward and backward, through these alone; with the messages at its two
    ends a block's own forward-backward is that of the whole text.
    """
    import numpy as np

    n, _, k = scores.shape
    head = np.r_[True, owner[1:] != owner[:-1]]
    if head.all():
        return posteriors(scores, lengths, transitions, start)[0]
    place = np.arange(n) - np.maximum.accumulate(np.where(head, np.arange(n), 0))  # of a block in its text
    tail = np.r_[head[1:], True]
    step = np.exp(transitions - transitions.max())
    first = np.broadcast_to(np.exp(start - start.max()), (n, k)).copy()
    after = np.ones((n, k))
    inner = np.flatnonzero(~head)
    through = np.empty((n, k, k))
    through[inner] = passages(scores[inner], lengths[inner], transitions)
    message = np.zeros((n, k))  # at the last word of a block
    heads = np.flatnonzero(head & ~tail)
    only = np.exp(scores[heads, 0] - scores[heads, 0].max(1, keepdims=True)) * first[heads]
    rest = passages(scores[heads, 1:], lengths[heads] - 1, transitions)
    passed = np.einsum("nk,nkj->nj", only / only.sum(1, keepdims=True), rest)
    message[heads] = passed / passed.sum(1, keepdims=True)
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(1, place.max() + 2))
    steps = [order[lo:hi] for lo, hi in zip(bounds, bounds[1:])]
    for now in steps:
        first[now] = message[now - 1] @ step
        passed = np.einsum("nk,nkj->nj", message[now - 1], through[now])
        message[now] = passed / passed.sum(1, keepdims=True)
    for now in reversed(steps):
        back = np.einsum("nkj,nj->nk", through[now], after[now])
        after[now - 1] = back / back.sum(1, keepdims=True)
    return posteriors(scores, lengths, transitions, start, first, after)[0]


def fit(rows: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """Maximise the conditional likelihood of the labels of (language, text) rows."""
    import numpy as np
    import regex

    words_of = regex.compile(LETTERS).findall
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    at = {lang: i for i, lang in enumerate(languages)}
    types: dict[str, int] = {}
    chains, labels, counts = [], [], {}
    for lang, text in sorted(rows):
        ids = [types.setdefault(w, len(types)) for w in words_of(text.lower())]
        for lo in range(0, len(ids), WINDOW):
            chains.append(ids[lo:lo + WINDOW])
            labels.append(at[lang])
        for i in ids:
            counts.setdefault(i, [0] * k)[at[lang]] += 1
    if not chains:
        return Model([], None, None, None, {}, None)
    lengths = np.array([len(c) for c in chains])
    x, y = np.zeros((len(chains), WINDOW), np.int64), np.repeat(np.array(labels)[:, None], WINDOW, 1)
    for i, chain in enumerate(chains):
        x[i, :len(chain)] = chain
    # splices: the words of another chain from a random place on
    rng = np.random.default_rng(7)
    other, cut = rng.permutation(len(x)), rng.integers(1, WINDOW, len(x))
    late = (np.arange(WINDOW)[None, :] >= cut[:, None]) & (lengths[:, None] > cut[:, None])
    sx, sy = np.where(late, x[other], x), np.where(late, y[other], y)
    sl = np.where(lengths > cut, np.maximum(lengths[other], np.minimum(cut, lengths)), lengths)
    x, y, lengths = np.r_[x, sx], np.r_[y, sy], np.r_[lengths, sl]
    words = list(types)
    lexicon = {words[i]: int(np.argmax(c)) for i, c in counts.items() if sum(c) >= 3 and max(c) >= 0.9 * sum(c)}
    slots = [features(w) for w in words]
    sizes = np.array([len(s) for s in slots])
    flat, heads, owner = np.concatenate(slots), np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(len(words)), sizes)
    listed = np.array([lexicon.get(w, -1) for w in words])
    model = [np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k), np.zeros((k, k))]
    first, second = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
    alive = np.arange(WINDOW)[None, :] < lengths[:, None]
    n, eye = alive.sum(), np.eye(k)
    for it in range(1, steps + 1):
        weights, transitions, start, listing = model
        table = np.add.reduceat(weights[flat], heads) + np.where(listed[:, None] >= 0, listing[listed], 0)
        post, forward, backward, local, step, _ = posteriors(table[x], lengths, transitions, start)
        error = (eye[y] - post) * alive[:, :, None]
        by_type = np.stack([np.bincount(x[alive], error[:, :, c][alive], len(words)) for c in range(k)], 1)
        g_weights = np.stack([np.bincount(flat, by_type[owner, c], SLOTS) for c in range(k)], 1)
        g_listing = np.zeros((k, k))
        np.add.at(g_listing, listed[listed >= 0], by_type[listed >= 0])
        pair = alive[:, 1:]
        after = (local[:, 1:] * backward[:, 1:])[pair]
        before = forward[:, :-1][pair]
        both = before[:, :, None] * step[None] * after[:, None, :]
        expected = (both / both.sum((1, 2), keepdims=True)).sum(0)
        seen = np.zeros((k, k))
        np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
        g = [g_weights / n * 50, (seen - expected) / n, error[:, 0].sum(0) / n, g_listing / n * 50]
        for p, grad, m, v in zip(model, g, first, second):  # Adam, with weight decay
            grad = grad - DECAY * p
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            p += RATE * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    return Model(languages, model[0].astype("f4"), model[1], model[2], lexicon, model[3])


def training_rows(docs: DataFrame, learns: Column, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", max_langs: int = MAX_LANGS) -> list[tuple[str, str]]:
    """The bounded sample: the cut hash of each language first, then the rows up to it.

    The hash is of id and text, so that rows without an id are told apart.
    """
    rows = docs.filter(learns & F.col(lang_col).isNotNull() & F.octet_length(text_col).between(1, MAX_BYTES)).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    order = W.partitionBy("lang").orderBy("h")
    ranked = rows.select("lang", "h").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang)
    cuts = ranked.join(F.broadcast(langs.select("lang")), "lang").groupBy("lang").agg(F.max("h").alias("cut"))
    chosen = rows.join(F.broadcast(cuts), "lang").filter("h <= cut").select("lang", "h", "text").distinct()
    found: dict[str, list] = {}
    for r in sorted(chosen.collect()):  # at most a few more than per_lang of each
        found.setdefault(r.lang, []).append((r.lang, r.text))
    return [row for lang in sorted(found) for row in found[lang][:per_lang]]


class Labeller:
    """Scores words once and labels many documents together."""

    def __init__(self, model: Model):
        import regex

        self.model, self.words_of = model, regex.compile(LETTERS).findall
        self.place: dict[str, int] = {}
        self.table = None

    def _learn(self, words) -> None:
        import numpy as np

        m = self.model
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if not new:
            return
        slots = [features(w) for w in new]
        heads = np.r_[0, np.cumsum([len(s) for s in slots])[:-1]]
        rows = np.add.reduceat(m.weights[np.concatenate(slots)], heads)
        listed = np.array([m.lexicon.get(w, -1) for w in new])
        rows = (rows + np.where(listed[:, None] >= 0, m.lexicon_weights[listed], 0)).astype("f4")
        size = 0 if self.table is None else len(self.table)
        self.place.update(zip(new, range(size, size + len(new))))
        self.table = rows if self.table is None else np.concatenate([self.table, rows])

    def label(self, texts: list[str]):
        """Per text (posteriors of its words), in order."""
        import numpy as np

        if len(self.place) > CACHE:
            self.place, self.table = {}, None
        words = [self.words_of(t.lower()) for t in texts]
        self._learn(w for ws in words for w in ws)
        sizes = np.array([len(ws) for ws in words])
        place = self.place
        ids = np.fromiter((place[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        chains = [(s + lo, min(WINDOW, n - lo)) for s, n in zip(starts.tolist(), sizes.tolist()) for lo in range(0, n, WINDOW)]
        post = np.empty((len(ids), len(self.model.languages)), "f4")
        owner = np.repeat(np.arange(len(sizes)), -(-sizes // WINDOW))
        lo = 0
        while lo < len(chains):  # whole texts, about 4096 blocks at a time
            hi = int(np.searchsorted(owner, owner[min(lo + 4096, len(chains)) - 1], side="right"))
            some = np.array(chains[lo:hi])
            where = some[:, 0, None] + np.arange(WINDOW)[None, :]
            alive = np.arange(WINDOW)[None, :] < some[:, 1, None]
            scores = self.table[ids[np.minimum(where, len(ids) - 1)]]
            found = whole_chains(scores, some[:, 1], owner[lo:hi], self.model.transitions, self.model.start)
            post[where[alive]] = found[alive]
            lo = hi
        return [post[s:s + n] for s, n in zip(starts, sizes)]


def _predict(model, runs: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = model.value
        labeller = Labeller(m) if m.languages else None
        span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                langs, scores, spans = [], [], []
                for post in labeller.label(texts) if labeller else [()] * len(texts):
                    mean = post.mean(0) if len(post) else None
                    best = int(mean.argmax()) if len(post) else -1
                    langs.append(m.languages[best] if len(post) else UNKNOWN)
                    scores.append(min(1.0, float(mean[best])) if len(post) else 0.0)
                    if runs and len(post):
                        label = post.argmax(1)
                        cuts = np.r_[0, np.flatnonzero(np.diff(label)) + 1, len(label)]
                        spans.append([{"lang": m.languages[label[a]], "words": int(b - a)} for a, b in zip(cuts, cuts[1:])])
                    else:
                        spans.append([])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)],
                    names=["id", "lang_pred", "score", "runs"])

    return run


def predict(docs: DataFrame, model: Model, runs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, runs) of every document; ``runs`` are the runs of equal labels."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return texts.mapInArrow(_predict(shared, runs), "id long, lang_pred string, score double, runs array<struct<lang:string,words:int>>")


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model is fitted on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
