"""Suite runner: test cases -> result rows (the reference's run loop, re-planned).

The reference executes test cases one after another, each fetching whole
query results into memory.  Here every case becomes a lazy one-row result
frame and the suite is their union: one Spark job evaluates all cases, the
counts of one target table in one scan.  Only the result rows (one per case, samples bounded) come back to the driver.

Which comparison a case gets depends on its type, its columns and the shape of
its statements, never on how many rows they return:

* both SQL texts: type ``row_count`` / ``scalar``, or one global aggregate of
  one column on each side -> scalar compare (CMP-1); ``key_col`` on both
  sides -> keyed diff (CMP-2); ``val`` on both -> value-set diff (CMP-3);
  otherwise -> row-set diff (CMP-4);
* target SQL only: a count of violations (TGT-1) if the case's ``target_kind``
  is ``count`` or the statement is a global aggregate; otherwise every row
  is a violation (TGT-2);
* no target SQL -> failed with the reference's message.

Inactive cases (``is_active`` false) are left out of a run.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import checks, checksum, diff
from ..operators.result import KEYED_SAMPLE, RESULT_SCHEMA, SET_SAMPLE_EACH_SIDE, TARGET_SAMPLE, count_text, error_result

# Fixed value: the error text of a case without SQL.
NO_SQL_ERROR = "No SQL queries defined for this test case"
SCALAR_TYPES = {"row_count", "scalar"}


def batch_check_results(df: DataFrame, batch_col: str, predicates: Mapping[str, Column]) -> DataFrame:
    """Every predicate evaluated for every load batch in one aggregation:
    ``run_id, check_name, rows, mismatch_count, passed``."""
    g = checks.grouped_violation_counts(df, batch_col, predicates)
    return g.select(F.col(batch_col).alias("run_id"), "check_name", "rows",
                    F.col("violations").alias("mismatch_count"),
                    (F.col("violations") == 0).alias("passed"))


def _is_count(case: Mapping[str, Any], tgt: DataFrame) -> bool:
    """Whether a target-only case returns a number of violations rather than the
    violating rows: its ``target_kind`` (``count`` / ``rows``) if given, else
    whether the statement is a global aggregate of one column - one row by
    construction, whatever the data - and never how many rows came back."""
    kind = case.get("target_kind")
    if kind:
        return kind == "count"
    if len(tgt.columns) != 1:
        return False
    node = tgt._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias", "View"):
        node = node.children().head()
    return node.nodeName() == "Aggregate" and node.groupingExpressions().isEmpty()


def _target_only(case: Mapping[str, Any], name: str, check_type: str, tgt: DataFrame, sample_size: int) -> DataFrame:
    if _is_count(case, tgt):
        return checks.count_check_result(name, tgt, check_type)
    return checks.rows_check_result(name, tgt, check_type, sample_size=sample_size)


def case_result(spark: SparkSession, case: Mapping[str, Any], params: dict | None = None, *,
                use_checksum: bool = False, samples: bool = True, target_sample: int = TARGET_SAMPLE,
                set_sample: int = SET_SAMPLE_EACH_SIDE, keyed_sample: int = KEYED_SAMPLE) -> DataFrame:
    """One test case -> one-row result frame (lazy unless ``use_checksum``, which
    runs a small job to decide).  ``samples=False`` leaves ``mismatch_sample``
    empty and plans no sample branch; the three sizes bound what it holds."""
    name = case.get("name") or "Unnamed Test"
    ctype = case.get("type") or "value_match"
    src_sql, tgt_sql = case.get("source_sql"), case.get("target_sql")
    try:
        if not tgt_sql:
            return error_result(spark, name, ctype, NO_SQL_ERROR)
        tgt = spark.sql(tgt_sql, args=params) if params else spark.sql(tgt_sql)
        if not src_sql:
            return _target_only(case, name, ctype, tgt, target_sample if samples else 0)
        src = spark.sql(src_sql, args=params) if params else spark.sql(src_sql)
        return compare_result(spark, name, ctype, src, tgt, use_checksum=use_checksum, samples=samples,
                              set_sample=set_sample, sample_size=keyed_sample)
    except Exception as e:  # analysis errors surface here, as in the reference
        return error_result(spark, name, ctype, str(e))


def compare_result(spark: SparkSession, name: str, ctype: str, src: DataFrame, tgt: DataFrame, *,
                   use_checksum: bool = False, samples: bool = True, set_sample: int = SET_SAMPLE_EACH_SIDE,
                   **opts) -> DataFrame:
    """Both sides of a case -> its one-row result: the checksum short-circuit
    (CHK-4) when asked, then scalar, keyed, value-set or row-set comparison by
    the columns present.  ``opts`` go to the keyed comparison; ``samples=False``
    plans no sample branch."""
    if not samples:
        opts["sample_size"] = 0
    if use_checksum and checksum.checksum_gate(src, tgt):
        return checksum.checksum_match_result(spark, name, ctype)
    one_col = len(src.columns) == 1 and len(tgt.columns) == 1
    if ctype in SCALAR_TYPES or one_col and _is_count({}, src) and _is_count({}, tgt):
        return diff.scalar_result(name, src, tgt, ctype)
    if diff.KEY in src.columns and diff.KEY in tgt.columns:
        return diff.keyed_diff_result(name, src, tgt, check_type=ctype, **opts)
    each = set_sample if samples else 0
    if diff.VAL in src.columns and diff.VAL in tgt.columns:
        return diff.set_diff_result(name, src, tgt, check_type=ctype, sample_each=each)
    return diff.row_set_diff_result(name, src, tgt, check_type=ctype, sample_each=each)


_SUITE_SCHEMA = T.StructType(RESULT_SCHEMA.fields + [T.StructField("test_case_id", T.IntegerType())])


def fused_counts(spark: SparkSession, cases: list[Mapping[str, Any]]) -> DataFrame:
    """All cases with a ``violation`` (table, predicate) of one table in one scan: one
    aggregate counts every predicate, and its row becomes a result row per case."""
    name = cases[0]["violation"][0]
    counts = spark.table(name).agg(*[F.count_if(F.expr(c["violation"][1])).alias(f"__v{i}") for i, c in enumerate(cases)])
    rows = F.array(*[F.struct(
        F.lit(c.get("name")).alias("check_name"), F.lit(c.get("type")).alias("check_type"), F.lit(c.get("id")).cast("int").alias("test_case_id"),
        F.col(f"__v{i}").alias("mismatch_count")) for i, c in enumerate(cases)])
    got = counts.select(F.inline(rows))
    known = {"passed": F.col("mismatch_count") == 0, "target_value": F.col("mismatch_count").cast("string")}
    return got.select(*[known.get(f.name, F.col(f.name) if f.name in got.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in _SUITE_SCHEMA.fields])


def fused_comparisons(spark: SparkSession, cases: list[Mapping[str, Any]]) -> DataFrame:
    """All cases with a ``compared`` of the same two sides and keys in one comparison
    (``diff.column_results``): the key is computed and shuffled once, each value
    stays in its own type, and every compared column becomes a result row."""
    src_from, src_key, tgt, tgt_key = cases[0]["compared"][:4]

    def side(table, key, values):
        return spark.sql(f"SELECT {key} AS {diff.KEY}, {', '.join(f'{v} AS c{i}' for i, v in enumerate(values))} FROM {table}")
    got = diff.column_results(side(src_from, src_key, [c["compared"][4] for c in cases]), side(tgt, tgt_key, [c["compared"][5] for c in cases]))
    told = {f"c{i}": (c.get("name") or "Unnamed Test", c.get("type") or "value_match", c.get("id")) for i, c in enumerate(cases)}

    def of_case(n):
        return F.create_map(*[F.lit(x) for name, row in told.items() for x in (name, row[n])])[F.col("column_name")]
    kinds = [diff.MISSING, diff.EXTRA, diff.CHANGED, diff.DUPLICATE]
    known = {"check_name": of_case(0), "check_type": of_case(1), "test_case_id": of_case(2),
             "passed": F.col("mismatch_count") == 0, "mismatch_count": F.col("mismatch_count"),
             "source_value": count_text(F.col("n_source"), "rows"), "target_value": count_text(F.col("n_target"), "rows"),
             "mismatch_breakdown": F.to_json(F.struct(F.struct(*kinds).alias("by_type"), F.struct(F.col(diff.CHANGED).alias(diff.VAL)).alias("by_column")))}
    return got.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _SUITE_SCHEMA.fields])


def _case_frames(spark: SparkSession, cases, params, opts) -> list[tuple[list, DataFrame]]:
    """(cases, their result rows): target-only counts of one table together, and so, where no
    sample is asked for, keyed comparisons of the same sides; each other case alone."""
    groups: dict[tuple, list] = {}
    out = []
    fuse_keyed = not opts.get("samples", True) and not opts.get("use_checksum")
    for c in cases:
        if c.get("is_active", True) is False:
            continue
        if c.get("violation"):
            groups.setdefault((fused_counts, c["violation"][0]), []).append(c)
        elif c.get("compared") and fuse_keyed:
            groups.setdefault((fused_comparisons, *c["compared"][:4]), []).append(c)
        else:
            out.append(([c], case_result(spark, c, params, **opts).withColumn("test_case_id", F.lit(c.get("id")).cast("int"))))
    for (fused, *_), together in groups.items():
        try:
            out.append((together, fused(spark, together)))
        except Exception:  # one expression cannot be analysed: each case alone, so that one fails alone
            out += [([c], case_result(spark, c, params, **opts).withColumn("test_case_id", F.lit(c.get("id")).cast("int"))) for c in together]
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def suite_results(spark: SparkSession, cases: list[Mapping[str, Any]], params: dict | None = None,
                  **opts) -> DataFrame:
    """The result rows of a suite as one lazy DataFrame (``test_case_id`` kept), the
    union of its cases' frames, so one Spark job evaluates all cases.  The
    target-only counts of one table (null and DQ checks) share one scan and one
    aggregate; with ``samples=False`` the keyed checks of one table pair share
    one comparison, which keeps every value in its own type; every other case
    reads its own sides.
    """
    frames = [f for _, f in _case_frames(spark, cases, params, opts)]
    return _union(frames) if frames else spark.createDataFrame([], _SUITE_SCHEMA)


def run_cases(spark: SparkSession, cases: list[Mapping[str, Any]], params: dict | None = None,
              **opts) -> DataFrame:
    """Run a suite; returns its result rows (one per case, ``test_case_id`` kept).

    All cases run in one job (``suite_results``); only the result rows - one
    per case, samples bounded - reach the driver.  If that job fails (a
    runtime error in one case, e.g. an ANSI overflow), its parts are re-run
    one by one - fused counts still together, and apart only if they fail -
    so a failing case fails alone with its error.
    """
    frames = _case_frames(spark, cases, params, opts)
    if not frames:
        return spark.createDataFrame([], _SUITE_SCHEMA)
    suite = _union([f for _, f in frames])
    try:
        rows = suite.collect()
    except Exception:
        rows = []
        for together, frame in frames:
            try:
                rows += frame.collect()
            except Exception as e:
                if len(together) > 1:  # the fused cases one by one
                    rows += run_cases(spark, [{**c, "violation": None, "compared": None} for c in together], params, **opts).collect()
                    continue
                c = together[0]
                err = error_result(spark, c.get("name") or "Unnamed Test", c.get("type") or "value_match", str(e))
                rows += err.withColumn("test_case_id", F.lit(c.get("id")).cast("int")).collect()
    return spark.createDataFrame(rows, suite.schema)


def validate_sql(spark: SparkSession, sql: str | None) -> tuple[str, str | None]:
    """Dry-run validation of one statement: ('valid', None) or ('invalid', message).

    ``spark.sql`` analyses the statement without running it and raises on an
    unknown table or column (``EXPLAIN`` would not raise)."""
    if not sql:
        return "valid", None
    try:
        spark.sql(sql)
        return "valid", None
    except Exception as e:
        return "invalid", str(e)
