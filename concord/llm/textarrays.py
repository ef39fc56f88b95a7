"""Words of Arrow string batches as numpy arrays: bounds, owners and 64-bit hashes.

Tasks that need every word of every text read the batch's UTF-8 buffer as it is
and work on whole blocks of texts at once; no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are handled in blocks of about so many bytes (a longer text is a block of its own).
#: A block's arrays take some hundred times its bytes, the hash tables kept 32 times.
BLOCK_BYTES = 1 << 19

#: Which bytes belong to a word. SPACED: all but 0x20 and 0x09-0x0D.
#: ALNUM: ASCII letters and digits and every byte of other characters.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: ASCII capitals as small letters.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLES = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n or more."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(n, BLOCK_BYTES + 1), _BASES[which]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= BLOCK_BYTES + 1:
            _powers[which] = have
    return have


@dataclass
class Words:
    data: np.ndarray  # the block's bytes
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # words of text d: first[d] to first[d + 1]

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit polynomial hash of each word; ``which`` 0 or 1: two independent ones."""
        up, down = _power_tables(which, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_TABLES[which][self.data] * up[: len(self.data)], dtype=np.uint64, out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        h ^= h >> np.uint64(32)
        h *= _MULT
        return h ^ (h >> np.uint64(29))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.string():
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def blocks(texts: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets into them) of each block."""
    data, off = buffers(texts)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACED, fold: np.ndarray | None = None,
               cuts: np.ndarray | None = None) -> Words:
    """The words of a block; ``fold`` maps bytes first; before each place in ``cuts`` a word ends too."""
    if fold is not None:
        data = fold[data]
    inside = kind[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    before[edges], after[edges - 1] = False, False
    if cuts is not None:
        before[cuts], after[cuts - 1] = False, False
    start = np.flatnonzero(inside & ~before)
    return Words(data, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, offsets))


def trim() -> None:
    """Gives freed memory back to the system. Python workers outlive their tasks and wait
    for those of later stages, which may run in other workers beside them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library: it has no such call
    _libc = None


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``df`` with ``fields`` computed from its text column, batch by batch: ``make``
    runs once in a task and gives the function from texts to the new columns."""
    schema = T.StructType([*df.schema.fields, *fields])
    at, names = df.columns.index(text), [f.name for f in schema.fields]

    def run(batches):
        f = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *f(batch.column(at))], names=names)
        trim()

    return df.mapInArrow(run, schema)
