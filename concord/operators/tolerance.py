"""Comparison of numbers within a tolerance, keys repeated or not (CMP-2, NRM-1).

Two numbers are near if they are equal, both NaN, or both finite and apart by no more
than the greater of ``absolute`` and ``relative`` times the larger magnitude.  NULL
is near NULL only, an infinity itself only.  1e30 and 1e30 + 1 are the same
double; 1e-13 is near 0 under an absolute tolerance of 1e-12, never under a
relative one alone.  Numbers of all types are compared as doubles.

The rows of a key (that agree on the ``same`` columns too) are matched one to one,
as many as can be.  In sorted order whatever lies between two near numbers is
near both, so one pass with a queue finds a largest matching: the oldest waiting
number of the other side goes with each new one, and a number waits while what
comes is near it.

Plan: rows collapse to (key, value) counts of both sides before the shuffle; these
are dealt by range of (key, value) and sorted, so a key that holds a third of the
table is spread over tasks.  A task streams its rows.  Numbers that are near
the next one form a chain; chains never part a match.  A chain inside a task is matched there;
the first and the last one of a task may go on beyond it, and go as counts to a
second, small pass dealt by key.  Only counts per key remain after that.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import diff

COUNTS = "key_col string, same string, v double, is_null boolean, n_source long, n_target long, matched long, whole boolean"
NAMES = [x.split()[0] for x in COUNTS.split(", ")]


def near(a: float, b: float, absolute: float, relative: float) -> bool:
    if a == b or (math.isnan(a) and math.isnan(b)):
        return True
    return math.isfinite(a) and math.isfinite(b) and abs(a - b) <= max(absolute, relative * max(abs(a), abs(b)))


def match_chain(chain: list[tuple[float, int, int]], absolute: float, relative: float) -> int:
    """The size of a largest matching of sorted (value, sources, targets)."""
    waiting: deque[list] = deque()  # [value, how many] of one side
    side, matched = 0, 0
    for v, *new in chain:
        while waiting and not near(waiting[0][0], v, absolute, relative):
            waiting.popleft()
        while waiting and new[1 - side]:
            n = min(waiting[0][1], new[1 - side])
            matched += n
            new[1 - side] -= n
            waiting[0][1] -= n
            if not waiting[0][1]:
                waiting.popleft()
        n = min(new)  # equal values of both sides that are left
        matched += n
        new = [x - n for x in new]
        if any(new):
            if not waiting:
                side = 0 if new[0] else 1
            waiting.append([v, new[side]])
    return matched


def _chains(frames: Iterator[pd.DataFrame], absolute: float, relative: float) -> Iterator[tuple[tuple, list]]:
    """((key, same), chain) of a sorted stream."""
    now, chain = None, []
    for frame in frames:
        for key, same, v, is_null, s, t in zip(*[frame[c].tolist() for c in NAMES[:6]]):
            group = (key, same, is_null)
            if chain and (group != now or not near(chain[-1][0], v, absolute, relative)):
                yield now, chain
                chain = []
            now = group
            chain.append((v, s, t))
    if chain:
        yield now, chain


def _matcher(absolute: float, relative: float, final: bool):
    def run(frames):
        out, held, first = [], None, not final
        for group, chain in _chains(frames, absolute, relative):
            if held is not None:
                out.append(_matched(*held, absolute, relative))
            if first:  # may have begun in another task
                out += _open(group, chain)
                first, held = False, None
            else:
                held = group, chain
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=NAMES)
                out = []
        if held is not None:
            out += [_matched(*held, absolute, relative)] if final else _open(*held)
        yield pd.DataFrame(out, columns=NAMES)

    return run


def _matched(group: tuple, chain: list, absolute: float, relative: float) -> tuple:
    key, same, is_null = group
    return key, same, chain[0][0], is_null, sum(x[1] for x in chain), sum(x[2] for x in chain), match_chain(chain, absolute, relative), True


def _open(group: tuple, chain: list) -> list[tuple]:
    key, same, is_null = group
    return [(key, same, v, is_null, s, t, 0, False) for v, s, t in chain]


def tolerance_stats(source: DataFrame, target: DataFrame, value: str, key: str = diff.KEY, same: list[str] = (), *,
                    absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """Every key: ``key_col, n_source, n_target, n_matched``."""
    if not (0 <= absolute < math.inf and 0 <= relative < 1):
        raise ValueError("a tolerance is not negative; a relative one is below 1")
    opts: dict = {}
    plan = diff._plan_columns(source, target, [key, *same])
    sides = []
    for which, df in enumerate((source, target)):
        text = lambda c: diff.canon(F.col(f"`{c}`"), plan[c][which], **opts)  # noqa: B023,E731
        tied = F.concat(F.lit(""), *[F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)) for c in same])
        v = F.col(f"`{value}`").cast("double")
        sides.append(df.select(text(key).alias("key_col"), tied.alias("same"), F.coalesce(F.when(v == 0, F.lit(0.0)).otherwise(v), F.lit(0.0)).alias("v"),
                               v.isNull().alias("is_null"), F.lit(which).alias("side")))
    counts = sides[0].unionByName(sides[1]).groupBy("key_col", "same", "is_null", "v").agg(
        F.count_if(F.col("side") == 0).alias("n_source"), F.count_if(F.col("side") == 1).alias("n_target"))
    order = ["key_col", "same", "is_null", "v"]
    columns = NAMES[:6]
    first = counts.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_matcher(absolute, relative, False), COUNTS)
    # both kinds of rows in one pass: matched chains are summed, open ones matched by key
    ensure_checkpoint_dir(source.sparkSession)
    first = first.checkpoint()
    rest = first.where("NOT whole").select(*columns).groupBy(*order).agg(F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target"))
    second = rest.select(*columns).repartition("key_col", "same").sortWithinPartitions(*order).mapInPandas(_matcher(absolute, relative, True), COUNTS)
    return first.where("whole").unionByName(second).groupBy("key_col").agg(
        F.sum("n_source").alias("n_source"), F.sum("n_target").alias("n_target"), F.sum("matched").alias("n_matched"))


def tolerance_diff(source: DataFrame, target: DataFrame, value: str, key: str = diff.KEY, same: list[str] = (), *,
                   absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """CMP-2 within a tolerance: the keys with a row that has no near partner: ``key_col, n_source,
    n_target, n_matched, unmatched_source, unmatched_target, mismatch_type``."""
    s = tolerance_stats(source, target, value, key, same, absolute=absolute, relative=relative)
    kind = F.when(F.col("n_target") == 0, diff.MISSING).when(F.col("n_source") == 0, diff.EXTRA).otherwise(diff.CHANGED)
    return s.where("n_matched < n_source OR n_matched < n_target").select(
        "*", (F.col("n_source") - F.col("n_matched")).alias("unmatched_source"), (F.col("n_target") - F.col("n_matched")).alias("unmatched_target"),
        kind.alias("mismatch_type"))
