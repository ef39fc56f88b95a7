"""Variable-capacity best-fit packing of token sequences.

Texts are cut into pieces of at most the largest permitted length and packed, in
decreasing order, into sequences of several permitted lengths (``CAPACITIES``): a
piece goes to the open bin with the least room that still holds it; where none
does, a new bin is opened.  At last every bin is cut down to the smallest
permitted length that holds its contents.  A sequence costs ``cost(c) = OVERHEAD + c
+ c * c / ATTENTION`` (a fixed share, one unit per token, and attention, which grows
with the square).

Which length is opened is chosen for all piece sizes jointly, run by run: pieces
fall into classes by the smallest length that holds them, and a plan gives every class
the length that its pieces open.  Plans are tried by packing the run: first every
single length (where it fits) and the length of least cost per token, then, from
the cheapest, every other length for one class after another, until no
change makes the run cheaper.  The cheapest plan's packing is the result.

Pieces are dealt by a hash of document and piece, so one very long document is
spread; a task packs its pieces in runs of ``RUN`` rows, whatever it was dealt, and
keeps only one run in memory.  Tails of runs are the only loss against packing
everything at once: under one bin of each size in RUN pieces.

Edge cases: a null or empty text is one piece of the end token alone; null ids
are packed like any other; equal lengths are taken in order of document and
piece; repeated rows are packed each; an empty table gives an empty result;
extra columns never clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm import textarrays as ta
from concord.llm import tokens

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 64
ATTENTION = 65536
RUN = 50_000


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / ATTENTION


def _fill(sizes: list[int], opens: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset within it) of decreasing sizes, and what each bin holds; ``opens``: the
    length that each size opens."""
    bins, offset, room, held = [], [], [], []
    open_at: dict[int, list[int]] = {}  # bins by their room
    rooms = 0  # bit r is set if a bin with room r is open
    for size, c in zip(sizes, opens):
        fits = rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                rooms &= ~(1 << r)
        else:
            r, b = c, len(room)
            room.append(r)
            held.append(0)
        bins.append(b)
        offset.append(held[b])
        held[b] += size
        room[b] = r - size
        if room[b]:
            open_at.setdefault(room[b], []).append(b)
            rooms |= 1 << room[b]
    return bins, offset, held


def _final(held: list[int], caps: np.ndarray) -> np.ndarray:
    """The smallest permitted length that holds each bin's contents."""
    return caps[np.searchsorted(caps, np.array(held, np.int64))]


def best_plan(sizes: np.ndarray, caps: np.ndarray) -> tuple[int, ...]:
    """For each length the one that a piece of its class opens (see above), for decreasing sizes."""
    kind = np.searchsorted(caps, sizes)
    price = {int(c): cost(int(c)) for c in caps}
    known: dict[tuple[int, ...], float] = {}
    in_order = sizes.tolist()

    def total(plan: tuple[int, ...]) -> float:
        if plan not in known:
            final = _final(_fill(in_order, np.array(plan)[kind].tolist())[2], caps)
            known[plan] = sum(price[int(c)] * int(n) for c, n in zip(*np.unique(final, return_counts=True)))
        return known[plan]

    lengths = [int(c) for c in caps]
    used = sorted(set(kind.tolist()))
    starts = [tuple(max(c, x) if k in used else c for k, c in enumerate(lengths)) for x in lengths]
    starts.append(tuple(min(lengths[k:], key=lambda x: price[x] / x) if k in used else c for k, c in enumerate(lengths)))
    plan = min(starts, key=total)
    while True:
        before = plan
        for k in used:
            plan = min([plan, *[(*plan[:k], c, *plan[k + 1:]) for c in lengths[k:]]], key=total)
        if plan == before:
            return plan


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset within it, the bin's final capacity) of every piece, in the given order."""
    caps = np.array(sorted(capacities))
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return bins, offset, np.zeros(0, np.int64)
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    plan = np.array(best_plan(ordered, caps))
    bins[order], offset[order], held = _fill(ordered.tolist(), plan[np.searchsorted(caps, ordered)].tolist())
    return bins, offset, _final(held, caps)[bins]


def pieces(lengths: DataFrame, doc_id: str, n_tokens: str, largest: int) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens): each text in runs of ``largest`` tokens and a rest."""
    n = F.greatest(F.coalesce(F.col(n_tokens), F.lit(0)).cast("long"), F.lit(0))
    cut = lengths.select(F.col(doc_id).alias("doc_id"), n.alias("n")).where("n > 0").select(
        "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest))).alias("piece"))
    start = F.col("piece") * largest
    return cut.select("doc_id", "piece", start.alias("token_start"), F.least(F.col("n") - start, F.lit(largest)).cast("int").alias("n_tokens"))


def best_fit(lengths: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """One row per piece: doc_id, piece, token_start, n_tokens, bin_id, bin_offset, capacity."""
    if not capacities or min(capacities) < 1:
        raise ValueError("permitted lengths must be positive")
    cut = pieces(lengths, doc_id, n_tokens, max(capacities))
    schema = T.StructType([*cut.schema.fields, T.StructField("bin_id", T.LongType()), T.StructField("bin_offset", T.LongType()), T.StructField("capacity", T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches):
        part, opened, waiting, n = TaskContext.get().partitionId(), 0, [], 0

        def packed(rows):
            nonlocal opened
            t = pa.Table.from_batches(rows)
            bins, offset, capacity = pack(t["n_tokens"].to_numpy().astype(np.int64), capacities)
            ids = (part << 40) + opened + bins
            opened += int(bins.max()) + 1
            return pa.table([*t.columns, ids, offset, capacity], names=names).combine_chunks().to_batches()

        for batch in batches:
            while batch.num_rows:
                take = min(RUN - n, batch.num_rows)
                waiting.append(batch.slice(0, take))
                n += take
                batch = batch.slice(take)
                if n == RUN:
                    yield from packed(waiting)
                    waiting, n = [], 0
        if n:
            yield from packed(waiting)

    dealt = cut.repartition(F.xxhash64("doc_id", "piece")).sortWithinPartitions("doc_id", "piece", "n_tokens")
    return dealt.mapInArrow(run, schema)


def token_lengths(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens) of every whole text with its end token."""

    def make():
        e = tokens.encoder(vocabulary)
        return lambda texts: [pa.array(e.counts(texts) + 1)]

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return ta.append(d, "text", [T.StructField("n_tokens", T.LongType())], make).select("doc_id", "n_tokens")


def pack_documents(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The packing of every whole text of ``docs``."""
    return best_fit(token_lengths(docs, vocabulary, text, doc_id))
