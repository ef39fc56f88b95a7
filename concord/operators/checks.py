"""Target-only checks (TGT-1, TGT-2) and the check types built on them
(CHKTYPE-4 .. CHKTYPE-7).

A check passes when it finds no violation.  Counts are aggregates
(``count_if``) evaluated in one pass; violating rows are returned lazily and
only a bounded, ordered sample reaches a result row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .result import TARGET_SAMPLE, one_row_join, result_frame, sample_json


def count_check_result(name: str, counted: DataFrame, check_type: str = "dq_check") -> DataFrame:
    """TGT-1: ``counted`` holds one row and one column, the number of violations.

    Passes iff the value is 0; a NULL count is reported as an error, like
    ``int(None)`` failing in the reference.
    """
    v = counted[0].cast("bigint")
    out = counted.select(
        (v == 0).alias("passed"), v.cast("string").alias("target_value"), v.alias("mismatch_count"),
        F.when(v.isNull(), F.lit("violation count is NULL")).alias("error_message"))
    return result_frame(out.select(F.coalesce("passed", F.lit(False)).alias("passed"),
                                   "target_value", "mismatch_count", "error_message"),
                        name, check_type)


def rows_check_result(name: str, rows: DataFrame, check_type: str = "dq_check",
                      sample_size: int = TARGET_SAMPLE, order_by: list[str] | None = None) -> DataFrame:
    """TGT-2: every row of ``rows`` is a violation; passes iff there is none."""
    n = rows.agg(F.count(F.lit(1)).alias("mismatch_count"))
    order = order_by or rows.columns
    # sample_size=0: no sample branch
    with_sample = one_row_join(n, sample_json(rows, order, sample_size)) if sample_size > 0 else \
        n.withColumn("mismatch_sample", F.lit(None).cast("string"))
    out = with_sample.select(
        (F.col("mismatch_count") == 0).alias("passed"),
        F.col("mismatch_count").cast("string").alias("target_value"),
        "mismatch_count", "mismatch_sample")
    return result_frame(out, name, check_type)


def violation_count(df: DataFrame, predicate: Column, alias: str = "cnt") -> DataFrame:
    """``SELECT COUNT(*) WHERE predicate`` as a one-row frame (NULL is not a violation)."""
    return df.agg(F.count_if(predicate).alias(alias))


def null_check(df: DataFrame, column: str) -> DataFrame:
    """CHKTYPE-4: number of NULLs in ``column``."""
    return violation_count(df, F.col(column).isNull())


def dq_check(df: DataFrame, predicate: Column) -> DataFrame:
    """CHKTYPE-6: number of rows violating a DQ predicate (see ``concord.functions.dq``)."""
    return violation_count(df, predicate)


def duplicate_groups(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """CHKTYPE-5: ``GROUP BY cols HAVING COUNT(*) > 1`` -> ``cols..., cnt``.

    NULL forms its own group, as in SQL.  Partial aggregation collapses a hot
    value before the shuffle.
    """
    cols = [columns] if isinstance(columns, str) else list(columns)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


def orphan_values(child: DataFrame, fk: str | list[str], parent: DataFrame,
                  pk: str | list[str]) -> DataFrame:
    """CHKTYPE-7: distinct child key values without a parent row, with row counts.

    ``fk_values, cnt``.  NULL foreign keys are orphans, as in the reference's
    ``LEFT JOIN ... WHERE dim.pk IS NULL`` form.  The child side is reduced to
    distinct keys first (partial aggregation absorbs hot keys), so the anti
    join moves one row per distinct key, never the raw fact rows.
    """
    fks = [fk] if isinstance(fk, str) else list(fk)
    pks = [pk] if isinstance(pk, str) else list(pk)
    keys = [f"__k{i}" for i in range(len(fks))]
    c = child.groupBy(*[F.col(f).alias(k) for f, k in zip(fks, keys)]).agg(
        F.count(F.lit(1)).alias("cnt"))
    # Parent keys are made distinct too: a repeated parent key cannot pile up
    # in one join task, and both sides arrive hash-partitioned on the keys.
    # A left join on a parent flag, not an anti join: Catalyst would push an
    # anti join below the child's aggregate and shuffle raw child rows.
    p = parent.select(*[F.col(x).alias(k) for x, k in zip(pks, keys)]).distinct() \
        .withColumn("__parent", F.lit(True))
    orphans = c.join(p, keys, "left").where(F.col("__parent").isNull())
    return orphans.select(*[F.col(k).alias(f) for k, f in zip(keys, fks)], "cnt")


def fk_violation_count(child: DataFrame, fk, parent: DataFrame, pk) -> DataFrame:
    """CHKTYPE-7 as a count: number of child rows whose key has no parent."""
    return orphan_values(child, fk, parent, pk).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("cnt"))


def violation_counts(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """Fused form: every predicate counted in ONE scan, returned long.

    ``check_name, violations`` - one row per predicate.  The reference runs one
    query per rule; here one aggregate evaluates all of them.
    """
    names = list(predicates)
    wide = df.agg(*[F.count_if(p).alias(f"__p{i}") for i, p in enumerate(predicates.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"__p{i}").alias("violations"))
                      for i, n in enumerate(names)])
    return wide.select(F.inline(pairs))


def grouped_violation_counts(df: DataFrame, group: list[str] | str,
                             predicates: Mapping[str, Column]) -> DataFrame:
    """``violation_counts`` per group (e.g. per load batch): ``group..., check_name,
    rows, violations``; one aggregation for all predicates."""
    g = [group] if isinstance(group, str) else list(group)
    names = list(predicates)
    wide = df.groupBy(*g).agg(F.count(F.lit(1)).alias("rows"),
                              *[F.count_if(p).alias(f"__p{i}") for i, p in enumerate(predicates.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"__p{i}").alias("violations"))
                      for i, n in enumerate(names)])
    return wide.select(*g, "rows", F.inline(pairs))
