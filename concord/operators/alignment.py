"""Which row became which: alignment of the rows of repeated keys (CMP-2b).

A keyed comparison can only count the unequal pairs of a key that repeats.
Here a key's rows are lined up as multisets.  Equal rows cancel (on counts, before
anything is lined up).  Of the rest, pairs that differ in one column are made first,
then pairs that differ in two, then any pairs that are left; in each round the
rows of a key that agree on the round's columns are taken in the order of their values,
the first source row with the first target row.  Rounds of equally many columns
go in the columns' order, agreement on earlier columns first.  What finds no
partner is missing or extra.  The rule is the same for every key and size.

Rows stay collapsed to (key, values) with a count.  In a round, both sides'
rows of a group get their places by running counts, and one sweep over the places
carries the row of each side that covers them: as many segments as rows, never
pairs.  Groups are sorted, spilling windows over (key, agreed values), not
collected.  Between rounds the rows that are left, and only they, are checkpointed.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import diff

ALIGNED_COLUMNS = ("row_type", "changed_columns", "n_rows")


def rounds(n: int) -> list[tuple[int, ...]]:
    """The columns agreed on in each round."""
    sizes = [s for s in (n - 1, n - 2) if s > 0]
    return [c for s in sizes for c in itertools.combinations(range(n), s)] + [()]


def _round(left: DataFrame, values: list[str], agreed: list[str]) -> DataFrame:
    """Segments of both sides' rows: ``key_col, s, t`` (the rows' values, NULL on the side of a row that
    found no partner) and how many rows each stands for."""
    group = Window.partitionBy(diff.KEY, *agreed)
    placed = left.withColumn("m", F.least(*[F.sum(F.when(F.col("src") == x, F.col("n")).otherwise(0)).over(group) for x in (True, False)]))
    own = Window.partitionBy(diff.KEY, *agreed, "src").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.coalesce(F.sum("n").over(own), F.lit(0)))
    sweep = Window.partitionBy(diff.KEY, *agreed).orderBy("at", "src")
    row = F.struct(*values)
    side = lambda yes: F.last(F.when(F.col("src") == yes, row), ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = placed.select(diff.KEY, *values, "src", "n", "at", "m", side(True).alias("s"), side(False).alias("t"), F.lead("at").over(sweep).alias("next"))
    pair = F.struct(F.col("s"), F.col("t"), (F.least(F.coalesce("next", "m"), "m") - F.col("at")).alias("n"))
    over = F.struct(F.when(F.col("src"), row).alias("s"), F.when(~F.col("src"), row).alias("t"), (F.col("at") + F.col("n") - F.greatest("at", "m")).alias("n"))
    return swept.select(diff.KEY, F.inline(F.array(pair, over))).where("n > 0")


def aligned_rows(source: DataFrame, target: DataFrame, key: str = diff.KEY, columns: list[str] | None = None, *, strict: bool = False,
                 strip_dot_zero_strings: bool = False) -> DataFrame:
    """CMP-2b detail: ``key_col, row_type, changed_columns, <c>_source, <c>_target, n_rows``.

    ``row_type`` is ``value_mismatch`` (a source row lined up with a target row, the differing
    columns listed), ``missing_in_target`` or ``extra_in_target``; ``n_rows`` equal rows share a line."""
    cols = diff._resolve(source, target, key, columns)
    opts = dict(strict=strict, strip_dot_zero_strings=strip_dot_zero_strings)
    tuples, inner, plan = diff._tuple_counts(source, target, key, cols, opts)
    names = list(inner.values())
    more = F.col("__cs") - F.col("__ct")
    left = tuples.where(more != 0).select(diff.KEY, *names, (more > 0).alias("src"), F.abs(more).alias("n"))
    ensure_checkpoint_dir(source.sparkSession)
    parts = []
    for agreed in rounds(len(names)):
        segments = _round(left, names, [names[i] for i in agreed])
        if not agreed:
            parts.append(segments)
            break
        segments = segments.checkpoint()
        parts.append(segments.where("s IS NOT NULL AND t IS NOT NULL"))
        left = segments.where("s IS NULL OR t IS NULL").select(diff.KEY, F.coalesce("s", "t").alias("r"), F.col("s").isNotNull().alias("src"), "n").select(
            diff.KEY, "r.*", "src", "n")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    changed = F.array_join(F.array_compact(F.array(*[F.when(~F.col("s")[v].eqNullSafe(F.col("t")[v]), F.lit(c)) for c, v in inner.items()])), ",")
    text = lambda side, c, v: diff._text(F.col(side)[v], c, plan, opts)
    shown = [F.when(F.col(side).isNotNull(), text(side, c, v)).alias(f"{c}_{name}") for c, v in inner.items() for side, name in (("s", "source"), ("t", "target"))]
    out = out.groupBy(diff.KEY, "s", "t").agg(F.sum("n").alias("n_rows"))  # one line for rows paired in different rounds
    return out.select(diff._text(F.col(diff.KEY), key, plan, opts).alias(diff.KEY),
                      F.when(both, diff.CHANGED).when(F.col("t").isNull(), diff.MISSING).otherwise(diff.EXTRA).alias("row_type"),
                      F.when(both, changed).alias("changed_columns"), *shown, "n_rows")
