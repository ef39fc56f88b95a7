"""Benchmark decontamination by latent semantic retrieval.

Words (runs of letters and digits, in small letters) are hashed into
``TERMS`` terms, and the corpus is cut into passages of ``PASSAGE`` words.  One
pass counts in how many passages each term stands.  Terms of more than ``COMMON`` of
all passages (and 20 more) carry no topic and weigh nothing; the others weigh
their IDF, folded by a second hash into ``COLUMNS`` columns: that is the TF-IDF
matrix A.  A second pass does a randomised SVD: every task adds up Y'A and Y'Y,
with Y = A * Omega for a fixed Gaussian Omega of ``SKETCH`` columns, and the sums
give the ``RANK`` leading right singular vectors.  Tasks send sums of fixed size,
added up in blocks of columns, lanes of tasks first; only COLUMNS x SKETCH numbers reach the driver.
All passages of all documents take part.

A third pass slides windows over every whole text, maps them into the latent
space (singular values divided out, so that rare and common topics weigh
alike), and compares them by cosine with the benchmark's items.  Items of up to
``SHORT`` words are sought with windows of 2 steps, others with 4 steps (a step is
``STEP`` words); items over ``LONG`` words are sought piece by piece.  A window
at ``COSINE`` (of short items ``COSINE_SHORT``) or more is a candidate, and its surroundings are aligned with the item: the
longest common subsequence, each word weighing its IDF, as a share of the
item's weight.  ``LEAK`` or more is a leak; from ``PARAPHRASE`` on it is one if also
the answer (the item's last sentence) stands there with half its weight.

The latent space does not see items whose words are all common terms (an item
leaked by many documents makes its own words common) and blurs short ones.  Items
with less than ``VISIBLE`` of their weight in the space, or of fewer than ``BRIEF`` words, are
sought by their key words instead: the heaviest ones that hold ``KEYS`` of an
item's weight.  A region without enough of them cannot reach ``PARAPHRASE``; each place
with enough is a candidate and is aligned the same way.

The benchmark is the stated query set: it goes to the tasks in blocks of
``ITEMS`` items, each block a pass over the documents.

Edge cases: null, empty and blank texts have no passage and no leak; such items,
items of a null id or text match nothing; items of common terms alone are found by their key words, with
cosine 0; equal items are reported each; repeated
document rows are judged each; empty tables give empty results; extra columns
never clash.  Texts shorter than a window are one window.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import textarrays as ta

TEXT_BYTES = 1 << 18  # of texts at once: every word takes a row of SKETCH numbers
TERMS = 1 << 16
COLUMNS = 4096
COMMON = 0.005
PASSAGE = 40
SKETCH = 112
RANK = 96
STEP = 10
SHORT = 28
LONG = 60
COSINE = 0.3  # of items over SHORT words
COSINE_SHORT = 0.2
VISIBLE = 0.5
BRIEF = 16
LEAK = 0.8
PARAPHRASE = 0.5
KEYS = 0.8
GROUP = 1024
HITS_AT_ONCE = 1 << 21
ITEMS = 8192
COSINES = 1 << 17  # windows times items compared at once
PAIRS = 256  # candidates whose words are compared at once
FEW = 8
SUM_BLOCKS = 16
SLOTS = 1024
SEED = 11

HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()),
                                 T.StructField("lcs", T.DoubleType()), T.StructField("answer", T.DoubleType())]))


def _terms(texts: pa.Array, size: int = TEXT_BYTES):
    """(first text, hashes, words of text d: first[d] to first[d + 1]) of each block."""
    for lo, _, data, off in ta.blocks(pc.utf8_lower(texts), size):
        w = ta.find_words(data, off, ta.ALNUM)
        yield lo, w.hashes(), w.first


def _term(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(TERMS - 1)).astype(np.int64)


def _column(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(24)) & np.uint64(COLUMNS - 1)).astype(np.int64)


@dataclass
class Space:
    """weight: of each term in A (0: common); idf: of each term; latent: of each column its
    place in the latent space. A window's place is the weighted sum of its words' columns."""

    weight: np.ndarray
    idf: np.ndarray
    latent: np.ndarray

    def sums(self, h: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The weighted sum of ``table``'s rows over each run of words."""
        w = self.weight[_term(h)]
        some = np.flatnonzero(w)
        return _added(np.searchsorted(starts, some, "right") - 1, len(starts), table, _column(h[some]), w[some])


def _added(run: np.ndarray, n: int, table: np.ndarray, row: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """For each of ``n`` runs the sum of the rows of ``table`` that its members name, each times its
    weight; ``run`` ascends. The first members of all runs are added, then the second ones, and so
    on. The runs with the most members come first, so every turn adds to the front of the sums."""
    size = np.bincount(run, minlength=n)
    order = np.argsort(-size, kind="stable")
    begin, size = (np.cumsum(size) - size)[order], size[order]
    sums, each = np.zeros((2, n, table.shape[1]), np.float32)
    for k in range(size.max(initial=0)):
        m = int(np.searchsorted(-size, -k))  # runs of more than k members
        if m <= FEW and k >= PASSAGE:  # a few long runs are left
            for i in range(m):
                at = slice(begin[i] + k, begin[i] + size[i])
                sums[i] += table[row[at]].sum(0) if weight is None else weight[at] @ table[row[at]]
            break
        at = begin[:m] + k
        rows = np.take(table, row[at], axis=0, out=each[:m], mode="clip")
        if weight is not None:
            rows *= weight[at, None]
        sums[:m] += rows
    each[order] = sums
    return each


def _starts(first: np.ndarray, width: int) -> np.ndarray:
    """Where each run of up to ``width`` words of one text begins."""
    n = np.diff(first)
    runs = -(-n // width)
    base = np.repeat(first[:-1], runs)
    return base + width * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Adds up rows (block, data) of equal blocks, streaming, in two steps: within lanes of
    about as many tasks as there are lanes, then the lanes' sums."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), "f8")
                sums[block] = sums[block] + x if block in sums else x.astype("f8")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])

    lanes = max(1, math.isqrt(parts.rdd.getNumPartitions()))
    dealt = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes))).repartition(SUM_BLOCKS * lanes, "block", "lane")
    first = dealt.drop("lane").mapInArrow(add, "block int, data binary")
    rows = first.repartition(2 * SUM_BLOCKS, "block").mapInArrow(add, "block int, data binary").collect()
    return {r["block"]: np.frombuffer(r["data"], "f8") for r in rows}


def _blocks_of(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(SUM_BLOCKS), pa.int32()), pa.array([b.tobytes() for b in np.split(x, SUM_BLOCKS)], pa.binary())], names=["block", "data"])


def _document_frequency(texts: DataFrame) -> tuple[np.ndarray, float]:
    def count(batches):
        df, n = np.zeros(TERMS), 0
        for batch in batches:
            for _, h, first in _terms(batch.column(0)):
                s = _starts(first, PASSAGE)
                n += len(s)
                own = np.repeat(np.arange(len(s)), np.diff(np.append(s, len(h))))
                each = np.sort(own * TERMS + _term(h))  # a term counts once in a passage
                df += np.bincount(each[np.diff(each, prepend=-1) != 0] % TERMS, minlength=TERMS)
        yield _blocks_of(np.concatenate([df, np.full(SUM_BLOCKS, n)]).reshape(-1)[_with_count()])
        ta.trim()

    got = _summed(texts.mapInArrow(count, "block int, data binary"))
    if not got:
        return np.zeros(TERMS), 0.0
    each = [got[b] for b in range(SUM_BLOCKS)]
    return np.concatenate([x[:-1] for x in each]), float(each[0][-1])


def _with_count() -> np.ndarray:
    """The order that gives every block its columns and then the number of passages."""
    width = TERMS // SUM_BLOCKS
    return np.concatenate([np.append(np.arange(b * width, (b + 1) * width), TERMS + b) for b in range(SUM_BLOCKS)])


def _gram_sums(texts: DataFrame, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Y'A (columns x sketch) and Y'Y over all passages; ``space.latent`` is Omega."""
    shared = texts.sparkSession.sparkContext.broadcast(space)

    def add(batches):
        sp = shared.value
        ya, yy = np.zeros((COLUMNS, SKETCH), np.float32), np.zeros((SKETCH, SKETCH))
        for batch in batches:
            for _, h, first in _terms(batch.column(0), 2 * TEXT_BYTES):  # more words of a column at once
                if not len(h):
                    continue
                s = _starts(first, PASSAGE)
                y = sp.sums(h, s, sp.latent)
                yy += y.T @ y
                w = sp.weight[_term(h)]
                some = np.flatnonzero(w)
                if not len(some):
                    continue
                column = _column(h[some]).astype(np.int16)
                order = np.argsort(column, kind="stable")
                own = np.searchsorted(s, some, "right") - 1
                ya += _added(column[order], COLUMNS, y, own[order], w[some][order])
        yield _blocks_of(ya.astype("f8"))
        yield pa.RecordBatch.from_arrays([pa.array([SUM_BLOCKS], pa.int32()), pa.array([yy.tobytes()], pa.binary())], names=["block", "data"])
        ta.trim()

    got = _summed(texts.mapInArrow(add, "block int, data binary"))
    return (np.concatenate([got[b] for b in range(SUM_BLOCKS)]).reshape(COLUMNS, SKETCH), got[SUM_BLOCKS].reshape(SKETCH, SKETCH))


def fit(docs: DataFrame, text: str = "text") -> Space:
    """The latent space of the corpus."""
    texts = docs.select(F.col(text).alias("text"))
    df, n = _document_frequency(texts)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    weight = np.where(df > COMMON * n + 20, 0, idf).astype(np.float32)
    if not n:
        return Space(weight, idf, np.zeros((COLUMNS, 1), np.float32))
    omega = np.random.default_rng(SEED).normal(size=(COLUMNS, SKETCH)).astype(np.float32)
    return Space(weight, idf, _leading(*_gram_sums(texts, Space(weight, idf, omega))))


def _leading(ya: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Each column's place in the space of the leading right singular vectors, whitened."""
    value, vector = np.linalg.eigh(yy)
    some = value > 1e-6 * max(value.max(), 1e-30)
    b = ya @ (vector[:, some] / np.sqrt(value[some]))  # (Q'A)', columns x sketch
    value, vector = np.linalg.eigh(b.T @ b)
    lead = np.argsort(-value)[:RANK]
    lead = lead[value[lead] > 1e-6 * max(value.max(), 1e-30)]
    return (b @ (vector[:, lead] / value[lead])).astype(np.float32)


def _words_of(text: str) -> np.ndarray:
    return next((h for _, h, _ in _terms(pa.array([text]))), np.zeros(0, np.uint64))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def pieces_of(items: list[tuple[int, str]], space: Space) -> list[dict]:
    """What is sought: whole items, and pieces of PASSAGE words of items over LONG words."""
    out = []
    for item, text in items:
        h = _words_of(text or "")
        last = [s for s in re.split(r"[.?!\n]+", text or "") if len(_words_of(s))]
        answer = _words_of(last[-1]) if last else h
        cuts = [0, len(h)] if len(h) <= LONG else [*range(0, len(h) - PASSAGE // 2, PASSAGE), len(h)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                part = h[a:b]
                weight = space.idf[_term(part)].astype(float)
                known, back = np.unique(part, return_inverse=True)
                out.append({"weight": weight, "need": PARAPHRASE * weight.sum(), "known": known, "known_weight": np.bincount(back, weight), "item": item, "h": part, "answer": answer if len(h) <= LONG else part[-8:],
                            "short": b - a <= SHORT, "vector": space.sums(part, np.array([0]), space.latent)[0]})
    return out


def latent_shows(piece: dict, space: Space) -> bool:
    """Whether a piece is long enough and has words enough in the latent space to be sought there."""
    seen = piece["weight"][space.weight[_term(piece["h"])] > 0].sum()
    return len(piece["h"]) >= BRIEF and bool(piece["vector"].any()) and seen >= VISIBLE * piece["weight"].sum()


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass
class Side:
    """The pieces sought with windows of n_steps, and what a block needs to sift them."""

    n_steps: int
    pieces: list[dict]
    unit: np.ndarray  # their directions in the latent space
    slots: np.ndarray  # (SLOTS, pieces): the weight of a piece's uncommon words
    all_slots: np.ndarray  # (pieces, SLOTS): of all its words
    all_need: np.ndarray
    need: np.ndarray  # the weight of uncommon words without which PARAPHRASE cannot be reached
    reach: np.ndarray
    cosine: float


def side_of(n_steps: int, pieces: list[dict], space: Space) -> Side | None:
    if not pieces:
        return None
    slots, all_slots = np.zeros((2, len(pieces), SLOTS), np.float32)
    need = []
    for i, p in enumerate(pieces):
        rare = space.weight[_term(p["h"])] > 0
        np.add.at(slots[i], _slot(p["h"][rare]), p["weight"][rare])
        np.add.at(all_slots[i], _slot(p["h"]), p["weight"])
        need.append(PARAPHRASE * p["weight"].sum() - p["weight"][~rare].sum())
    return Side(n_steps, pieces, _unit(np.array([p["vector"] for p in pieces])), np.ascontiguousarray(slots.T), all_slots, np.array([p["need"] for p in pieces]), np.array(need), np.array([len(p["h"]) for p in pieces]),
                COSINE_SHORT if pieces[0]["short"] else COSINE)


def weighted_lcs(item: np.ndarray, region: np.ndarray, weight: np.ndarray) -> float:
    """The weight of the heaviest common subsequence, as a share of the item's weight."""
    best = np.zeros(len(region) + 1)
    for word, w in zip(item, weight):
        got = best.copy()
        got[1:] = np.maximum(got[1:], np.where(region == word, best[:-1] + w, 0))
        best = np.maximum.accumulate(got)
    return float(best[-1] / max(weight.sum(), 1e-9))


def _sliding(x: np.ndarray, width: int) -> np.ndarray:
    """The sum of ``width`` rows from each row on that has so many."""
    n, at, size = len(x) - width + 1, 0, 1
    out = np.zeros((n, x.shape[1]), np.float32)
    while size <= width:  # x: sums of ``size`` rows
        if width & size:
            out += x[at: at + n]
            at += size
        x = x[:-size] + x[size:]
        size *= 2
    return out


def _search(h: np.ndarray, first: np.ndarray, space: Space, sides: list[Side], exacts: list[Exact]) -> dict[int, list]:
    """text: [(item, cosine, lcs, answer)] of the block's texts."""
    found: dict[int, dict] = {}
    if not len(h):
        return {}
    s = _starts(first, STEP)
    step = space.sums(h, s, space.latent)
    owner = np.searchsorted(first, s, "right") - 1
    rare = np.flatnonzero(space.weight[_term(h)])
    slot = _slot(h)
    rare_slot, rare_step = slot[rare], np.searchsorted(s, rare, "right") - 1
    for side in sides:
        window = step.copy()
        for k in range(1, side.n_steps):
            same = owner[k:] == owner[:-k]
            window[:-k][same] += step[k:][same]
        window = _unit(window)
        some = max(64, COSINES // len(side.pieces))
        for lo in range(0, len(window), some):
            cosine = window[lo: lo + some] @ side.unit.T
            near = cosine >= side.cosine
            if not near.any():
                continue
            # An upper bound of the uncommon words' weight, for all windows and pieces at once: every
            # piece's weight in each step, added up over the steps that the longest piece reaches.
            n = -(-side.reach.max() // STEP)
            low, high = lo - n, lo + len(near) + side.n_steps + n - 1
            these = slice(*np.searchsorted(rare_step, [low, high]))
            along = _sliding(_added(rare_step[these] - low, high - low, side.slots, rare_slot[these]), side.n_steps + 2 * n)
            near &= along >= side.need - 1e-2
            w, p = np.divmod(np.flatnonzero(near), near.shape[1])
            cos, w = cosine[w, p], w + lo
            a = np.maximum(first[owner[w]], s[w] - side.reach[p])
            b = np.minimum(first[owner[w] + 1], s[w] + side.n_steps * STEP + side.reach[p])
            # Of what is left, a bound of all words' weight that takes every word of the piece once.
            for i in range(0, len(w), PAIRS):
                at = slice(i, i + PAIRS)
                n = b[at] - a[at]
                which = np.repeat(np.arange(len(n)), n)
                there = np.zeros((len(n), SLOTS), np.float32)
                there[which, slot[np.arange(n.sum()) + np.repeat(a[at] - (np.cumsum(n) - n), n)]] = 1
                weight = np.einsum("ij,ij->i", there, side.all_slots.take(p[at], axis=0))
                for j in i + np.flatnonzero(weight >= side.all_need[p[at]] - 1e-2):
                    _align(found.setdefault(int(owner[w[j]]), {}), side.pieces[p[j]], h[a[j]: b[j]], float(cos[j]), space)
    for exact in exacts:
        _search_exact(h, first, space, exact, step, s, owner, found)
    return {d: [v for _, v in sorted(x.items())] for d, x in found.items() if x}


@dataclass
class Exact:
    """Pieces sought by their words, without the latent space. The key words of a piece are its
    heaviest ones with ``KEYS`` of its weight; a text with less than ``need`` of it in key
    words cannot reach PARAPHRASE, whatever else it says."""

    pieces: list[dict]
    unit: np.ndarray  # their directions in the latent space, 0 for a piece of common terms
    terms: np.ndarray  # of each term: is it one of a key word
    words: np.ndarray  # the key words, sorted
    first: np.ndarray  # word w is a key of the pieces piece[first[w]: first[w + 1]]
    piece: np.ndarray
    weight: np.ndarray
    need: np.ndarray
    reach: np.ndarray
    n_steps: np.ndarray


def exact_of(pieces: list[dict], space: Space) -> Exact:
    words, piece, weight, need = [], [], [], []
    for i, p in enumerate(pieces):
        idf = space.idf[_term(p["known"])].astype(float)
        order = np.argsort(-idf, kind="stable")
        total = np.cumsum(p["known_weight"][order])
        n = int(np.searchsorted(total, KEYS * total[-1])) + 1
        words.append(p["known"][order[:n]])
        weight.append(idf[order[:n]])
        piece.append(np.full(len(words[-1]), i))
        need.append(PARAPHRASE * total[-1] - (total[-1] - total[min(n, len(total)) - 1]))
    word = np.concatenate(words)
    order = np.argsort(word, kind="stable")
    known, first = np.unique(word[order], return_index=True)
    terms = np.zeros(TERMS, bool)
    terms[_term(known)] = True
    return Exact(pieces, _unit(np.array([p["vector"] for p in pieces])), terms, known, np.append(first, len(word)), np.concatenate(piece)[order],
                 np.concatenate(weight)[order], np.array(need), np.array([len(p["h"]) for p in pieces]), np.array([2 if p["short"] else 4 for p in pieces]))


def _anchors(h: np.ndarray, first: np.ndarray, exact: Exact):
    """(words, pieces): where a leak of the piece may have its first key word, one place in a step.
    Of the words up to a piece's length and its window behind that place, enough are keys."""
    some = np.flatnonzero(exact.terms[_term(h)])
    at = np.minimum(np.searchsorted(exact.words, h[some]), len(exact.words) - 1)
    same = exact.words[at] == h[some]
    some, at = some[same], at[same]
    n = exact.first[at + 1] - exact.first[at]
    owner = np.searchsorted(first, some, "right") - 1
    # Whole texts go together, as many as give HITS_AT_ONCE pairs of a word and a piece.
    before = np.append(0, np.cumsum(n))
    begins = np.flatnonzero(np.diff(owner, prepend=-1))
    part = before[begins] // HITS_AT_ONCE
    cuts = np.append(begins[np.flatnonzero(np.diff(part, prepend=-1))], len(some))
    for lo, hi in zip(cuts, cuts[1:]):
        m = n[lo:hi]
        which = np.repeat(np.arange(lo, hi), m)
        post = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(exact.first[at[lo:hi]], m)
        size = len(h) + 1
        key = exact.piece[post] * size + some[which]
        order = np.argsort(key, kind="stable")
        key, which, post = key[order], which[order], post[order]
        x, p = some[which], exact.piece[post]
        total = np.append(0, np.cumsum(exact.weight[post]))
        end = np.minimum(first[owner[which] + 1], x + exact.reach[p] + exact.n_steps[p] * STEP)
        bound = total[np.searchsorted(key, p * size + end)] - total[:-1]
        enough = np.flatnonzero(bound >= exact.need[p] - 1e-4)
        x, p, d = x[enough], p[enough], owner[which[enough]]
        new = (np.diff(p, prepend=-1) != 0) | (np.diff(d, prepend=-1) != 0) | (np.diff((x - first[d]) // STEP, prepend=-1) != 0)
        yield x[new], p[new]


def _search_exact(h: np.ndarray, first: np.ndarray, space: Space, exact: Exact, step: np.ndarray, s: np.ndarray, owner: np.ndarray, found: dict) -> None:
    for x, p in _anchors(h, first, exact):
        d = np.searchsorted(first, x, "right") - 1
        at = np.searchsorted(s, x, "right") - 1
        window = np.zeros((len(x), step.shape[1]), np.float32)
        for k in range(4):
            there = np.minimum(at + k, len(s) - 1)
            same = (at + k < len(s)) & (owner[there] == d) & (k < exact.n_steps[p])
            window[same] += step[there[same]]
        cosine = (_unit(window) * exact.unit[p]).sum(1)
        a = np.maximum(first[d], x - exact.reach[p])
        b = np.minimum(first[d + 1], x + exact.n_steps[p] * STEP + exact.reach[p])
        for i in range(len(x)):
            _align(found.setdefault(int(d[i]), {}), exact.pieces[p[i]], h[a[i]: b[i]], float(cosine[i]), space)


def _align(found: dict, piece: dict, region: np.ndarray, cosine: float, space: Space) -> None:
    """Puts (item, cosine, lcs, answer) into ``found`` if the region leaks the piece better than before."""
    have = found.get(piece["item"], (0, 0, 0, 0))
    if have[2] >= 0.999:
        return
    weight = piece["weight"]
    known = piece["known"]  # sorted
    at = known.searchsorted(region)
    at[at == len(known)] = 0
    there = np.zeros(len(known), bool)
    there[at[known[at] == region]] = True
    if there @ piece["known_weight"] < piece["need"]:
        return  # not even its words are there, in whatever order
    lcs = weighted_lcs(piece["h"], region, weight)
    answer = space.idf[_term(piece["answer"])].astype(float)
    answered = float(answer[np.isin(piece["answer"], region)].sum() / max(answer.sum(), 1e-9))
    if (lcs >= LEAK or lcs >= PARAPHRASE and answered >= 0.5) and lcs > have[2]:
        found[piece["item"]] = (piece["item"], cosine, lcs, answered)


def with_hits(docs: DataFrame, benchmark: DataFrame, hits: str, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with an array column ``hits`` of the items that each text leaks."""
    spark = docs.sparkSession
    space = fit(docs, text)
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    n_blocks = max(1, -(-items.count() // ITEMS))
    out, names = docs, []
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == block).collect()
        pieces = pieces_of(sorted({(r["id"], r["text"]) for r in rows if r["id"] is not None and r["text"]}), space)
        dim = [p for p in pieces if not latent_shows(p, space)]
        exacts = [exact_of(dim[i: i + GROUP], space) for i in range(0, len(dim), GROUP)]
        pieces = [p for p in pieces if latent_shows(p, space)]
        sides = [side_of(2, [p for p in pieces if p["short"]], space), side_of(4, [p for p in pieces if not p["short"]], space)]
        sides = [x for x in sides if x]
        shared = spark.sparkContext.broadcast((space, sides, exacts))

        def make(shared=shared):
            def f(texts: pa.Array) -> list[pa.Array]:
                got: list[list[dict]] = [[] for _ in range(len(texts))]
                for lo, h, first in _terms(texts):
                    for d, found in _search(h, first, *shared.value).items():
                        got[lo + d] = [dict(zip(("item_id", "cosine", "lcs", "answer"), x)) for x in found]
                return [pa.array(got, HITS_ARROW)]

            return f

        names.append(ta.free_name(out, f"{hits}_{block}" if n_blocks > 1 else hits))
        out = ta.append(out, text, [T.StructField(names[-1], HITS)], make)
    if n_blocks == 1:
        return out
    return out.withColumn(hits, F.concat(*names)).drop(*names)


HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it leaks: doc_id, item_id, cosine of the
    best window, weighted share of the item (lcs) and of its answer found there."""
    return with_hits(docs.select("doc_id", "text"), benchmark, "hits").select("doc_id", F.inline("hits"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The input rows that leak no item, with the input's columns."""
    name = ta.free_name(docs, "hits")
    return with_hits(docs, benchmark, name, text).where(F.size(name) == 0).drop(name)
