"""Token ids of whole texts, each distinct word encoded once in a worker.

The vocabulary must be in small letters and split at white space and between
letters and punctuation before it merges (as word_bpe_49k does, where white space
is dropped): then a text's ids are its units' ids in a row.  The
distinct words of a block go through the tokenizers library; every occurrence is
a lookup by a 64-bit hash.  A second, independent hash guards the first: where
the two disagree, the block's texts are encoded whole instead.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from concord.llm import textarrays as ta

#: Distinct words that a worker remembers; beyond it starts afresh.
REMEMBERED = 1_000_000

_encoders: dict[str, "WordEncoder"] = {}


_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


def units(data: np.ndarray, off: np.ndarray) -> ta.Words:
    """What is encoded once: words, cut before a full stop or comma that follows an ASCII
    letter or digit (the vocabulary never merges over that place), in small letters
    (it folds them itself).  Blocks that may hold a special token's string, which
    is matched before folding, keep their capitals."""
    cuts = np.flatnonzero(((data[1:] == 44) | (data[1:] == 46)) & _ALNUM[data[:-1]]) + 1
    special = ((data[:-1] == 60) & (data[1:] == 124)).any()
    return ta.find_words(data, off, fold=None if special else ta.LOWER, cuts=cuts)


#: Words of the small letters a-z, ß-ö, ø-ÿ, which no normaliser changes.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_PROBES = ["a", "the", "étoile", "straße", "zq", "ñandú", "extraordinary", "ÿ", "qxqxqx", "über"]


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Only if this vocabulary does treat such words like that.
        self.direct = False
        want = self._ids(_PROBES)
        self.direct = True
        self.direct = self._ids(_PROBES) == want
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(0, np.uint64)  # sorted
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, words: list[str]) -> list[list[int]]:
        """Words of small Latin letters go straight to the merges, spelt in the vocabulary's
        byte letters; the library's normalising and splitting would leave them as they are."""
        if not self.direct:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        tokenize, out, rest = self.tokenizer.model.tokenize, [], []
        for i, w in enumerate(words):
            if _LATIN(w):
                out.append([x.id for x in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_LETTERS))])
            else:
                out.append(None)
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _learn(self, key: np.ndarray, check: np.ndarray, words: list[str]) -> None:
        got = self._ids(words)
        size = np.array([len(x) for x in got], np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([i for x in got for i in x], np.uint32)])
        order = np.argsort(np.concatenate([self.key, key]), kind="stable")
        for name, new in (("key", key), ("check", check), ("start", start), ("size", size)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])

    def _places(self, w: ta.Words) -> np.ndarray | None:
        """Of each word its place in the store; None if two words share a hash."""
        h, check = w.hashes(0), w.hashes(1)
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        if (check[first][back] != check).any():
            return None
        if len(self.key) + len(u) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.key, u)
        new = np.append(self.key, np.uint64(0))[at] != u
        new[at == len(self.key)] = True
        if new.any():
            f = first[new]
            raw = w.data.tobytes()
            self._learn(u[new], check[f], [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[f].tolist(), w.end[f].tolist())])
            at = np.searchsorted(self.key, u)
        if (self.check[at] != check[first]).any():
            return None
        return at[back]

    def _whole(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off, off[1:])]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of a block of texts."""
        w = units(data, off)
        at = self._places(w)
        if at is None:
            got = self._whole(data, off)
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
        size = self.size[at]
        end = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.start[at] - end[:-1], size) + np.arange(end[-1])]
        return ids, np.diff(end[w.first])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for lo, hi, data, off in ta.blocks(texts):
            w = units(data, off)
            at = self._places(w)
            if at is None:
                out[lo:hi] = [len(x) for x in self._whole(data, off)]
            else:
                out[lo:hi] = np.diff(np.concatenate([[0], np.cumsum(self.size[at])])[w.first])
        return out


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of that vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
