"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words; only the bag has a label.  Each passage is
encoded: the mean of its words' hashed random vectors (``DIM`` coordinates, a
fixed projection of the bag of words) beside what its bytes show (shares of
letters, capitals, digits, symbols, other marks and bytes beyond ASCII, word
length, shares of words that repeat one of the four before), through a learnt
tanh layer.  Gated attention, softmax over the bag of ``w . (tanh(V h) * sigmoid(U h))``,
weighs the passages, and a logistic unit scores the weighted sum.  All is learnt from document
labels by gradients written out in numpy (Adam, fixed seed and order).

The model learns from a bounded sample (``PER_CLASS`` labelled documents of each
class, texts up to ``MAX_TRAIN_WORDS`` words) and is a few kilobytes, broadcast.
Scoring is one pass in Arrow batches, without a shuffle, over every passage of every text.

Edge cases: a null, empty or blank text is one passage of zeros; a sample without
both classes gives score 0.5 for all; repeated rows are scored each; null ids are
kept and never learnt from; an empty table gives an empty result; extra columns
never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import textarrays as ta
from concord.llm.labelled import fitting_sample, fold

PASSAGE = 64
ROWS = 1 << 14
DIM = 24
HIDDEN = 24
GATE = 12
PER_CLASS = 4000
MAX_TRAIN_WORDS = 4096
EPOCHS = 12
BATCH = 64
RATE = 0.01
DECAY = 1e-4
SEED = 3
THRESHOLD = 0.3

#: Classes of bytes whose shares are inputs.
_KINDS = np.array([
    0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if chr(b) in "#*$%&|<>" else
    4 if b in (32, 9, 10, 11, 12, 13) else 6 if b >= 128 else 5 for b in range(256)], np.uint8)
N_SHOWN = 7 + 5
_VECTORS = np.random.default_rng(SEED).normal(0, 1, (ROWS, DIM)).astype(np.float32)


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of each passage, passages of text d: first[d] to first[d + 1]) of a block of texts."""
    w = ta.find_words(data, off)
    n = np.diff(w.first)
    runs = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(runs)])
    owner = np.repeat(np.arange(len(n)), runs)
    begin = w.first[owner] + PASSAGE * (np.arange(first[-1]) - first[owner])
    size = np.minimum(w.first[owner + 1] - begin, PASSAGE)
    x = np.zeros((first[-1], DIM + N_SHOWN), np.float32)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return x, first
    at, ends = begin[some], begin[some] + size[some]
    h = w.hashes()
    row = (h & np.uint64(ROWS - 1)).astype(np.int64)
    for c in range(DIM):  # a coordinate at a time: sums along one row are fast
        x[some, c] = np.add.reduceat(_VECTORS[row, c], at) / np.sqrt(size[some])
    kind = _KINDS[data]
    left, right = w.start[at], w.end[ends - 1]
    length = np.maximum(right - left, 1)
    for k in range(7):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        x[some, DIM + k] = (total[right] - total[left]) / length
    x[some, DIM + 7] = (np.add.reduceat(w.end - w.start, at) / size[some]) / 10
    position = np.arange(len(h)) - np.repeat(w.first[:-1], n)
    for k in range(1, 5):
        same = np.zeros(len(h), np.float32)
        same[k:] = (h[k:] == h[:-k]) & (position[k:] >= k)
        x[some, DIM + 7 + k] = np.add.reduceat(same, at) / size[some]
    return x, first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    return {"mean": np.zeros(DIM + N_SHOWN), "scale": np.ones(DIM + N_SHOWN), "W": draw(DIM + N_SHOWN, HIDDEN), "b": np.zeros(HIDDEN),
            "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "u": draw(HIDDEN), "c": np.zeros(1)}


def forward(m: dict, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Everything that scoring and learning need, bag by bag."""
    bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
    z = (x - m["mean"]) / m["scale"]
    h = np.tanh(z @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * s) @ m["w"]
    a = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
    a /= np.add.reduceat(a, first[:-1])[bag]
    pooled = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    return {"bag": bag, "z": z, "h": h, "t": t, "s": s, "a": a, "pooled": pooled, "p": _sigmoid(pooled @ m["u"] + m["c"][0])}


def gradients(m: dict, f: dict, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss."""
    bag, h, t, s, a = f["bag"], f["h"], f["t"], f["s"], f["a"]
    err = (f["p"] - y) / len(y)
    dpool = err[:, None] * m["u"]
    da = (dpool[bag] * h).sum(1)
    de = a * (da - np.bincount(bag, a * da, minlength=len(y))[bag])
    dt, ds = de[:, None] * m["w"] * s * (1 - t**2), de[:, None] * m["w"] * t * s * (1 - s)
    dh = (a[:, None] * dpool[bag] + dt @ m["V"].T + ds @ m["U"].T) * (1 - h**2)
    return {"W": f["z"].T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": ((t * s).T @ de), "u": f["pooled"].T @ err, "c": np.array([err.sum()])}


def train(bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    m = start()
    every = np.concatenate(bags)
    m["mean"], m["scale"] = every.mean(0), every.std(0) + 1e-3
    rng, step = np.random.default_rng(SEED + 1), 0
    first_moment, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            pick, step = order[lo: lo + BATCH], step + 1
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            g = gradients(m, forward(m, np.concatenate([bags[i] for i in pick]), first), y[pick])
            for k, v in g.items():
                v = v + DECAY * m[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                m[k] = m[k] - RATE * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, text: str = "text", doc_id: str = "doc_id") -> dict | None:
    """The model, from labelled rows outside the held-out fold; None without both classes."""
    sample = fitting_sample(docs, labels, "quality", fold(F.col("id"), folds) != held, PER_CLASS, MAX_TRAIN_WORDS, text, doc_id)

    def encode(texts: pa.Array) -> list[pa.Array]:
        out = []
        for _, _, data, off in ta.blocks(texts):
            x, first = passages(data, off)
            out += [x[a:b].tobytes() for a, b in zip(first, first[1:])]
        return [pa.array(out, pa.binary())]

    rows = ta.append(sample, "text", [T.StructField("x", T.BinaryType())], lambda: encode).select("id", "y", "x").toArrow().to_pylist()
    rows.sort(key=lambda r: str(r["id"]))
    y = np.array([r["y"] for r in rows], float)
    if len(np.unique(y)) < 2:
        return None
    return train([np.frombuffer(r["x"], np.float32).reshape(-1, DIM + N_SHOWN).astype(float) for r in rows], y)


def with_scores(docs: DataFrame, model: dict | None, score: str, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(texts: pa.Array) -> list[pa.Array]:
            out = np.full(len(texts), 0.5)
            for lo, hi, data, off in ta.blocks(texts) if m else ():
                out[lo:hi] = forward(m, *passages(data, off))["p"]
            return [pa.array(out)]

        return f

    return ta.append(docs, text, [T.StructField(score, T.DoubleType())], make)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.3)."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
