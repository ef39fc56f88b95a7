"""Toxicity: a convolutional text classifier, trained in numpy, thresholds by language.

Words (runs of letters and digits, ASCII capitals folded) are hashed into two
tables of ``ROWS`` embeddings each, and a word's vector is the sum of its two
rows: words that share a row in one table hardly ever share both.  Filters of
``WIDTHS`` words slide over the text, each filter's largest response is kept
(max pooling), and a logistic unit on the rectified maxima gives the score.
Backpropagation touches only the windows that won the pooling, so training is a
few sparse updates a step (Adagrad, fixed seed; sums of rounded numbers, so their order
does not matter: the same files give the same model).

The model learns from every labelled document outside the held-out fold, whole
texts, but for one in five (by a hash of the id) that sets the thresholds.  One pass
counts in how many texts of each class a word stands (``KNOWN`` buckets, and the
rows of both tables).  Each of the ``EPOCHS`` is a pass over the texts: every task
goes on from the broadcast model on its own rows and sends the rows of the tables that it
changed, each weighed by its number of steps; Spark adds them up, and their
means are the next model (its size is fixed, whatever the corpus).

The documents kept back, counted by language and cut of the score (``CUTS`` to a
unit of the logit), give the thresholds: the cut of best F1 for each language (of equal
ones the nearest to ``THRESHOLD``); a language with under ``MIN_POSITIVE`` toxic
documents takes ``THRESHOLD``.  The score itself is shifted, alike for all
languages, so that the best common cut lies at ``THRESHOLD``.  The language never
enters a score.

Scoring is one pass over the texts in Arrow batches, without a shuffle: every
word of every text, in blocks of bounded size.

Edge cases: a null or empty text has no window, all maxima are 0 and the score is
that of the bias; labels without both classes give score 0 for all; null and
unknown languages take ``THRESHOLD``; repeated rows are scored each; an empty
table gives an empty result; extra columns never clash.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import textarrays as ta
from concord.llm.common import bounded_broadcast
from concord.llm.labelled import fold

ROWS = 1 << 17
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 32
RATE = 0.05
SEED = 7
MIN_TEXTS = 3
SMOOTH = 4.0
THRESHOLD = 0.7
MIN_POSITIVE = 20
KNOWN = 1 << 20  # buckets that count the texts of a word
TASK_ROWS = 1000  # a task learns from so many documents or more
CUTS = 100
PAD = max(WIDTHS) - 1


@dataclass
class Model:
    tables: np.ndarray  # (2, ROWS, DIM)
    filters: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray  # of each filter
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def _rows_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(ROWS - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(20)) & mask).astype(np.int64)


def _empty_model() -> Model:
    rng = np.random.default_rng(SEED)
    return Model(np.zeros((2, ROWS, DIM), np.float32),
                 [rng.normal(0, 0.5, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS],
                 np.full(len(WIDTHS) * FILTERS, 0.1, np.float32),
                 rng.normal(0, 0.5, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)


def _responses(m: Model, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word vectors with PAD empty rows after each text, each text's first row, and
    each width's response at every row."""
    n = np.diff(first)
    at = first[:-1] + PAD * np.arange(len(n))
    x = np.zeros((len(h) + PAD * (len(n) + 1), DIM), np.float32)
    a, b = _rows_of(h)
    x[np.arange(len(h)) + np.repeat(PAD * np.arange(len(n)), n)] = (m.tables[0][a] + m.tables[1][b]) * (h != 0)[:, None]
    conv = []
    for w in m.filters:
        rows = len(x) - PAD
        c = x[:rows] @ w[0]
        for o in range(1, len(w)):
            c += x[o: o + rows] @ w[o]
        conv.append(c)
    return x, at, conv


def _pooled(conv: list[np.ndarray], at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each text's largest response of each filter; 0 for a text without words."""
    bounds = np.stack([at, at + n], 1).ravel()
    some = n > 0
    out = np.zeros((len(n), len(conv) * FILTERS), np.float32)
    for k, c in enumerate(conv):
        c = np.concatenate([c, np.zeros((1, FILTERS), np.float32)])  # the last bound may stand at the end
        out[:, k * FILTERS: (k + 1) * FILTERS] = np.where(some[:, None], np.maximum.reduceat(c, np.minimum(bounds, len(c) - 1))[::2], 0)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logits(m: Model, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    _, at, conv = _responses(m, h, first)
    best = _pooled(conv, at, np.diff(first))
    some = (np.diff(first) > 0)[:, None]
    # Rounded, as a product's last digits depend on the texts beside it.
    return np.round((np.maximum(np.where(some, best + m.bias, 0), 0).astype(float) * m.out).sum(1) + m.out_bias, 4)


def score_words(m: Model, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Scores of the texts whose words have hashes ``h`` (words of text d: first[d] to first[d + 1])."""
    return _sigmoid(_logits(m, h, first)).astype(np.float64)


def _start_sums(m: Model) -> list:
    return [np.full_like(m.tables, 1e-2), [np.full_like(w, 1e-2) for w in m.filters],
            np.full_like(m.bias, 1e-2), np.full_like(m.out, 1e-2), 1e-2]


def _step(m: Model, sums: list, steps_of: np.ndarray, h: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
    """One step of Adagrad on some texts; ``steps_of`` counts the steps of each row of the tables."""
    n = np.diff(first)
    x, at, conv = _responses(m, h, first)
    best = _pooled(conv, at, n)
    hidden = np.maximum(np.where((n > 0)[:, None], best + m.bias, 0), 0)
    err = (_sigmoid(hidden @ m.out + m.out_bias) - y).astype(np.float32) / len(y)
    back = err[:, None] * m.out * (hidden > 0)  # (texts, all filters)
    grad_out, grad_bias, grad_c = hidden.T @ err, back.sum(0), float(err.sum())
    a, b = _rows_of(h)
    where, what, grad_w = [[], []], [], []
    for k, (w, c) in enumerate(zip(m.filters, conv)):
        g = back[:, k * FILTERS: (k + 1) * FILTERS]
        d, f = np.nonzero(g)
        top = np.array([c[at[i]: at[i] + n[i], j].argmax() for i, j in zip(d, f)], np.int64) if len(d) else np.zeros(0, np.int64)
        gw = np.zeros_like(w)
        for o in range(len(w)):
            np.add.at(gw[o].T, f, x[at[d] + top + o] * g[d, f][:, None])
            real = (top + o < n[d]) & (h[np.minimum(first[d] + top + o, len(h) - 1)] != 0)
            word = first[d[real]] + top[real] + o
            where[0].append(a[word])
            where[1].append(b[word])
            what.append(w[o].T[f[real]] * g[d[real], f[real]][:, None])
        grad_w.append(gw)
    steps = np.concatenate(what) if what else np.zeros((0, DIM), np.float32)
    for t in (0, 1):
        rows, back_to = np.unique(np.concatenate(where[t]) if where[t] else np.zeros(0, np.int64), return_inverse=True)
        g = np.zeros((len(rows), DIM), np.float32)
        np.add.at(g, back_to, steps)
        sums[0][t][rows] += g * g
        m.tables[t][rows] -= RATE * g / np.sqrt(sums[0][t][rows])
        steps_of[t][rows] += 1
    for k, g in enumerate(grad_w):
        sums[1][k] += g * g
        m.filters[k] -= RATE * g / np.sqrt(sums[1][k])
    sums[2] += grad_bias**2
    m.bias -= RATE * grad_bias / np.sqrt(sums[2])
    sums[3] += grad_out**2
    m.out -= RATE * grad_out / np.sqrt(sums[3])
    sums[4] += grad_c**2
    m.out_bias -= RATE * grad_c / sums[4] ** 0.5


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) & np.uint64(KNOWN - 1)).astype(np.int64)


def _blocks_of(batch: pa.RecordBatch):
    """(classes, word hashes, first words) of blocks of a batch of text, y."""
    y = batch.column(1).to_numpy(zero_copy_only=False)
    for lo, hi, data, off in ta.blocks(batch.column(0), ta.BLOCK_BYTES // 4):
        w = ta.find_words(data, off, ta.ALNUM, ta.LOWER)
        yield y[lo:hi], w.hashes(), w.first


COUNTS = "key int, toxic double, n double"
ROW = "key int, " + ", ".join(f"v{k} double" for k in range(DIM)) + ", n double"


def _added(parts: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the rows of each key; as many as the model is large."""
    got = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "key"]).toArrow()
    return {c: got[c].to_numpy() for c in got.column_names}


def _text_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many toxic texts, and in how many of all, stands a word of each row of the first
    table, of the second one and of each bucket; last the texts themselves."""
    size = 2 * ROWS + KNOWN + 1

    def count(batches):
        toxic, n = np.zeros(size), np.zeros(size)
        for batch in batches:
            for y, h, first in _blocks_of(batch):
                own = np.repeat(np.arange(len(y)), np.diff(first))
                a, b = _rows_of(h)
                for key in (a, b + ROWS, _bucket(h) + 2 * ROWS):
                    each = np.unique(own * size + key)
                    np.add.at(n, each % size, 1.0)
                    np.add.at(toxic, each[y[each // size] > 0] % size, 1.0)
                n[-1] += len(y)
                toxic[-1] += (y > 0).sum()
        key = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(toxic[key]), pa.array(n[key])], names=["key", "toxic", "n"])
        ta.trim()

    toxic, n = np.zeros(size), np.zeros(size)
    got = _added(rows.mapInArrow(count, COUNTS))
    toxic[got["key"]], n[got["key"]] = got["toxic"], got["n"]
    return toxic, n


def _dense(m: Model) -> np.ndarray:
    """All of the model but its tables, in rows of DIM."""
    flat = np.concatenate([*[w.ravel() for w in m.filters], m.bias, m.out, [m.out_bias]]).astype(float)
    return np.append(flat, np.zeros(-len(flat) % DIM)).reshape(-1, DIM)


def _set_dense(m: Model, rows: np.ndarray) -> None:
    flat, lo = rows.ravel(), 0
    for x in (*m.filters, m.bias, m.out):
        x[...] = flat[lo: lo + x.size].reshape(x.shape)
        lo += x.size
    m.out_bias = float(flat[lo])


def _epoch(rows: DataFrame, model: Model, known: np.ndarray, epoch: int) -> None:
    """One pass of learning over all rows, by all tasks; changes ``model``."""
    shared = rows.sparkSession.sparkContext.broadcast((model, known))

    def learn(batches):
        start, known = shared.value
        m, sums, steps_of, n = copy.deepcopy(start), _start_sums(start), np.zeros((2, ROWS)), 0
        rng = np.random.default_rng(SEED + 1 + epoch)
        for batch in batches:
            for y, h, first in _blocks_of(batch):
                h = np.where(known[_bucket(h)], h, np.uint64(0))  # a word of few texts says nothing but which text it is
                n += len(y)
                for pick in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
                    words = [h[first[i]: first[i + 1]] for i in pick]
                    _step(m, sums, steps_of, np.concatenate(words), np.concatenate([[0], np.cumsum([len(x) for x in words])]), y[pick])
        key = np.flatnonzero(steps_of)
        weight = np.concatenate([steps_of.ravel()[key], np.full(len(_dense(m)), n)])
        change = np.concatenate([(m.tables - start.tables).reshape(-1, DIM)[key], _dense(m) - _dense(start)]) * weight[:, None]
        change = np.rint(change * 65536) / 65536  # sums are exact in whatever order
        key = np.concatenate([key, 2 * ROWS + np.arange(len(_dense(m)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(key), *[pa.array(x) for x in np.ascontiguousarray(change.T)], pa.array(weight)], names=["key", *[f"v{k}" for k in range(DIM)], "n"])
        ta.trim()

    got = _added(rows.mapInArrow(learn, ROW))
    change = np.stack([got[f"v{k}"] for k in range(DIM)], 1) / np.maximum(got["n"], 1)[:, None]
    some = got["key"] < 2 * ROWS
    model.tables.reshape(-1, DIM)[got["key"][some]] += change[some].astype(np.float32)
    dense = _dense(model)
    dense[got["key"][~some] - 2 * ROWS] += change[~some]
    _set_dense(model, dense)
    shared.unpersist()


def train(rows: DataFrame, epochs: int | None = None) -> Model | None:
    """The model of rows ``text, y``; None without both classes."""
    toxic, n = _text_counts(rows)
    n1, n0 = toxic[-1], n[-1] - toxic[-1]
    if not n1 or not n0:
        return None
    m, known = _empty_model(), n[2 * ROWS: -1] >= MIN_TEXTS
    # A row's first coordinate starts at the smoothed log odds of its words, halved over the
    # two tables: pooling then looks at telling words from the first step on.
    odds = np.log((toxic + SMOOTH) / n1) - np.log((n - toxic + SMOOTH * n0 / n1) / n0)
    m.tables[:, :, 0] = 0.5 * np.where(n[: 2 * ROWS] > 0, odds[: 2 * ROWS], 0).reshape(2, ROWS)
    rows = rows.coalesce(max(1, int(n[-1]) // TASK_ROWS))
    for epoch in range(epochs or EPOCHS):
        _epoch(rows, m, known, epoch)
    return m


def _best_cut(values: np.ndarray, n: np.ndarray, toxic: np.ndarray, default: float) -> float:
    """Of ``default`` and the places halfway between neighbouring values the cut of best F1;
    ``n`` rows have a value, ``toxic`` of them are."""
    cuts = np.concatenate([[default], (values[1:] + values[:-1]) / 2])
    at = np.searchsorted(values, cuts)
    above, hit = (np.append(np.cumsum(x[::-1])[::-1], 0)[at] for x in (n, toxic))
    f1 = 2 * hit / (above + toxic.sum())
    best = f1 >= f1.max() - 1e-12
    return float(cuts[best][np.abs(cuts[best] - default).argmin()])


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list, default: float = THRESHOLD) -> dict[str, float]:
    """For each language the threshold of best F1, halfway between neighbouring scores."""
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        mine = np.array([x == lang for x in langs])
        s, t = scores[mine], y[mine]
        if t.sum() < MIN_POSITIVE or t.sum() == len(t):
            continue
        values, back = np.unique(s, return_inverse=True)
        out[lang] = _best_cut(values, np.bincount(back), np.bincount(back, t), default)
    return out


def _cut_counts(rows: DataFrame, m: Model) -> dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each language (None: of all rows together) the cuts of the logit that have rows, their
    rows and the toxic ones: a row for each language and cut."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(m)

    def make():
        def f(texts: pa.Array) -> list[pa.Array]:
            out = np.zeros(len(texts))
            for lo, hi, data, off in ta.blocks(texts, ta.BLOCK_BYTES // 4):
                w = ta.find_words(data, off, ta.ALNUM, ta.LOWER)
                out[lo:hi] = _logits(shared.value, w.hashes(), w.first)
            return [pa.array(np.floor(np.clip(out, -30, 30) * CUTS).astype(np.int32))]

        return f

    cut = ta.append(rows, "text", [T.StructField("cut", T.IntegerType())], make)
    got = cut.groupBy("lang", "cut").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).collect()
    out = {}
    for lang in {None, *(r["lang"] for r in got)}:
        mine = [r for r in got if lang is None or r["lang"] == lang]
        at, back = np.unique([r["cut"] for r in mine], return_inverse=True)
        out[lang] = (at + 0.5) / CUTS, np.bincount(back, [r["n"] for r in mine]), np.bincount(back, [r["toxic"] for r in mine])
    return out


def _set_thresholds(rows: DataFrame, m: Model) -> None:
    """The shift of the score and each language's threshold, from rows ``text, y, lang``."""
    counts = {lang: x for lang, x in _cut_counts(rows, m).items() if MIN_POSITIVE <= x[2].sum() < x[1].sum()}
    if None not in counts:
        return
    default = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    common = _best_cut(*counts.pop(None), default)
    # The score is moved so that the cut which is best over all languages lies at THRESHOLD.
    m.out_bias += default - common
    m.thresholds = {lang: float(_sigmoid(_best_cut(*counts[lang], common) + default - common)) for lang in sorted(counts)}


def labelled_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, text: str, doc_id: str, lang: str) -> DataFrame:
    """text, y, lang, kept_back of every labelled row outside the held-out fold. Several label
    rows of one document: the larger counts; null ids and null labels are left out."""
    y = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
         .where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y")).where(fold(F.col("id"), folds) != held))
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                    (F.col(lang) if lang in docs.columns else F.lit(None).cast("string")).alias("lang"))
    return d.join(bounded_broadcast(y), "id").select("text", "y", "lang", (F.pmod(F.xxhash64("id"), F.lit(5)) == 4).alias("kept_back"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> Model | None:
    """The model, from all labelled rows outside the held-out fold; None without both classes."""
    rows = labelled_rows(docs, labels, folds, held, text, doc_id, lang)
    m = train(rows.where("NOT kept_back").select("text", "y"))
    if m:
        _set_thresholds(rows.where("kept_back").select("text", "y", "lang"), m)
    return m


def with_scores(docs: DataFrame, model: Model | None, score: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` of every whole text."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)

    def make():
        m = shared.value

        def f(texts: pa.Array) -> list[pa.Array]:
            out = np.zeros(len(texts))
            for lo, hi, data, off in ta.blocks(texts, ta.BLOCK_BYTES // 4) if m else ():
                w = ta.find_words(data, off, ta.ALNUM, ta.LOWER)
                out[lo:hi] = score_words(m, w.hashes(), w.first)
            return [pa.array(out)]

        return f

    return ta.append(docs, text, [T.StructField(score, T.DoubleType())], make)


def threshold_of(model: Model | None, lang) -> "F.Column":
    """The language's threshold as a column."""
    out = F.lit(THRESHOLD)
    for name, value in sorted((model.thresholds if model else {}).items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.7), the threshold of
    its language and whether the score reaches it."""
    model = fit(docs, labels)
    scored = with_scores(docs.select("doc_id", "lang", "text"), model, "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         threshold_of(model, F.col("lang")).alias("threshold"),
                         (F.col("score") >= threshold_of(model, F.col("lang"))).alias("flagged"))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The input rows whose score stays below their language's threshold, with the input's columns."""
    model = fit(docs, labels, text=text, lang=lang)
    name = ta.free_name(docs, "score")
    return with_scores(docs, model, name, text).where(F.col(name) < threshold_of(model, F.col(lang))).drop(name)
