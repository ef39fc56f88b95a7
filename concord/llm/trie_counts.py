"""Token counts under a unigram vocabulary, with forward scores shared along a trie.

A pre-token is a word with the word mark before it.  Its segmentation into
pieces is the one of the highest total score; the forward score of a prefix is
the best score of any segmentation of it, and it depends on that prefix alone.
So the distinct pre-tokens of a block are put in a trie, each node gets its
forward score and piece count once, whichever pre-tokens share it, and the
nodes where pre-tokens end hold their counts.  Sorted pre-tokens are the trie's
leaves in depth-first order, so only the branch from the root to the current
node is kept in memory.  A text's count is the sum over its pre-tokens, looked
up by a 64-bit hash that a second hash guards (where they disagree, the block's
words are counted by text).  Workers remember the terminal counts of words they
have met, up to ``REMEMBERED``.

The vocabulary file holds merge ranks, not probabilities, so a piece's score is
that of Zipf's law over its rank, ``-ln(rank + 1)``; a character that is no piece
is taken as its UTF-8 bytes' pieces.  Of segmentations of equal score the one
with fewer pieces counts.  One pass, no shuffle.

Edge cases: null, empty and blank texts have no pre-token and count 0; null ids
are kept; repeated rows are counted each; an empty table gives an empty result;
extra columns never clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import textarrays as ta

MARK = "▁"
REMEMBERED = 2_000_000

_counters: dict[str, "PieceCounter"] = {}


class Pieces:
    """Scores of a SentencePiece vocabulary's pieces, and all suffixes of them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.byte: dict[int, float] = {}
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            score = -math.log(i + 1)
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[1:-1], 16)] = score
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)] = score
        self.suffixes = {p[k:] for p in self.score for k in range(len(p))}

    def step(self, text: str, at: int, scores: list[float], counts: list[int]) -> tuple[float, int]:
        """(forward score, pieces) of text[:at], from those of its shorter prefixes."""
        best, fewest = -math.inf, 0
        for begin in range(at - 1, -1, -1):
            piece = text[begin:at]
            if piece not in self.suffixes:
                break  # nor is anything longer
            own = self.score.get(piece)
            if own is not None:
                s, n = scores[begin] + own, counts[begin] + 1
                if s > best or s == best and n < fewest:
                    best, fewest = s, n
        if text[at - 1] not in self.score:
            raw = text[at - 1].encode("utf-8", "surrogatepass")
            s, n = scores[at - 1] + sum(self.byte[b] for b in raw), counts[at - 1] + len(raw)
            if s > best or s == best and n < fewest:
                best, fewest = s, n
        return best, fewest


def trie_counts(pieces: Pieces, pretokens: list[str]) -> list[int]:
    """The piece count of each of the sorted, distinct pre-tokens: a depth-first walk of their trie."""
    branch, scores, counts, out = "", [0.0], [0], []
    for word in pretokens:
        shared = 0
        for a, b in zip(branch, word):
            if a != b:
                break
            shared += 1
        del scores[shared + 1:], counts[shared + 1:]
        for at in range(shared + 1, len(word) + 1):
            s, n = pieces.step(word, at, scores, counts)
            scores.append(s)
            counts.append(n)
        out.append(counts[-1])
        branch = word
    return out


class PieceCounter:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._forget()

    def _forget(self) -> None:
        self.key, self.check, self.count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _count_words(self, words: list[str]) -> np.ndarray:
        marked = sorted({MARK + w for w in words})
        got = dict(zip(marked, trie_counts(self.pieces, marked)))
        return np.array([got[MARK + w] for w in words], np.int64)

    def block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, pieces) of each text of a block."""
        w = ta.find_words(data, off)
        raw = w.data.tobytes()
        text = lambda f: [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[f].tolist(), w.end[f].tolist())]
        h, check = w.hashes(0), w.hashes(1)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.key) + len(u) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.key, u)
        known = np.zeros(len(u), bool)
        inside = at < len(self.key)
        known[inside] = self.key[at[inside]] == u[inside]
        f = first[~known]
        new = self._count_words(text(f))
        order = np.argsort(np.concatenate([self.key, u[~known]]), kind="stable")
        self.key, self.check, self.count = (np.concatenate(x)[order] for x in ((self.key, u[~known]), (self.check, check[f]), (self.count, new)))
        at = np.searchsorted(self.key, u)
        if (check[first][back] != check).any() or (self.check[at] != check[first]).any():
            each = self._count_words(text(slice(None)))
        else:
            each = self.count[at][back]
        return np.diff(w.first), np.diff(np.concatenate([[0], np.cumsum(each)])[w.first])


def counter(path: str) -> PieceCounter:
    """The worker's counter of that vocabulary file."""
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens."""

    def make():
        c = counter(vocabulary)

        def f(texts: pa.Array) -> list[pa.Array]:
            got = [c.block(data, off) for _, _, data, off in ta.blocks(texts, 4 * ta.BLOCK_BYTES)]
            return [pa.array(np.concatenate([x[k] for x in got]) if got else [], pa.int64()) for k in (0, 1)]

        return f

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return ta.append(d, "text", [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())], make).drop("text")
