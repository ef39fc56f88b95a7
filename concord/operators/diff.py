"""Comparison operators: scalar (CMP-1), keyed (CMP-2/2a/2b), value set (CMP-3)
and row set (CMP-4).

Each operator comes in two forms:

* a *detail* function returning the differences as a DataFrame (lazy, never
  collected), and
* a ``*_result`` function returning the one-row check result (see
  ``concord.operators.result``): pass/fail, counts and a bounded JSON sample.

Keyed diff plan
---------------
The reference merges both sides on the key in memory, so a key repeated m
times in the source and n times in the target yields m x n rows, and
``mismatch_count`` counts those rows.  Materialising the product is not an
option at scale (one hot key can hold a third of a table), so the count is
derived arithmetically instead:

1. both sides are stacked (``unionByName`` with a side flag) and aggregated
   by ``(key, value tuple)`` to a source and a target row count - one
   aggregation in place of two aggregates and their full outer join.  Partial
   aggregation runs before the exchange; rows are spread by the whole tuple,
   so a hot key with varied values is spread over many tasks, and a hot
   repeated tuple collapses to one row;
2. keys and values whose types agree and whose canonical text is one-to-one
   (integers, booleans, dates, ``timestamp_ntz``, decimals of one type) are
   grouped in their own type; the rest as canonical text (``canon``).  Text
   is printed for the output rows only;
3. the per-tuple counts are aggregated by key (partial aggregation again).
   For a key with ``n_s`` source rows, ``n_t`` target rows and ``M`` equal
   pairs (``sum(c_s * c_t)`` over its tuples) the reference's mismatch rows
   number ``n_s`` if the target lacks the key, ``n_t`` if the source lacks
   it, and ``n_s * n_t - M`` otherwise.

Values travel through step 3 only for tuples found on one side alone, the
only ones a mismatch row shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import canon
from .result import (KEYED_SAMPLE, SET_SAMPLE_EACH_SIDE, count_text, error_result,
                     one_row_join, result_frame, sample_json)

KEY = "key_col"
VAL = "val"
MISSING = "missing_in_target"
EXTRA = "extra_in_target"
CHANGED = "value_mismatch"
DUPLICATE = "duplicate_key"

# Fixed value: the error text of a comparison without a value column.
NO_VALUE_COLUMN_ERROR = ("Key-based comparison requires at least one value column "
                         "(e.g., 'val') present in both source and target.")


class DiffError(ValueError):
    pass


def compare_columns(source: DataFrame, target: DataFrame, key: str = KEY) -> list[str]:
    """CMP-2a: every column present on both sides except the key, in source order."""
    return [c for c in source.columns if c in target.columns and c != key]


# Types whose canonical text is a one-to-one image of the value (NULL -> '' is
# no value's text), so two sides of the *same* such type compare equal as text
# exactly when they compare equal as values.  Those columns are grouped in
# their own type - cheaper to hash and shuffle than text - and printed only in
# the output rows.  Not here: strings (trimmed, null tokens), floating point
# (NaN reads as ''), timestamps with time zone (a repeated local hour prints
# twice the same).
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NATIVE = (*_INTEGRAL, T.BooleanType, T.DateType, T.TimestampNTZType, T.DecimalType)


def _shared_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type both sides are compared in, or None to compare canonical text."""
    if isinstance(a, _INTEGRAL) and isinstance(b, _INTEGRAL):
        return T.LongType()
    if a == b and isinstance(a, _NATIVE):
        return a
    return None


def _plan_columns(source: DataFrame, target: DataFrame, names: list[str]) -> dict:
    """``{column: (source type, target type, shared type or None)}``."""
    fs = {f.name: f.dataType for f in source.schema.fields}
    ft = {f.name: f.dataType for f in target.schema.fields}
    return {n: (fs[n], ft[n], _shared_type(fs[n], ft[n])) for n in names}


def _side(df: DataFrame, key: str, inner: dict, plan: dict, which: int, opts: dict) -> DataFrame:
    """``key_col, __v*`` (native or canonical text) plus the side flag ``__src``."""
    def value(name):
        dt, shared = plan[name][which], plan[name][2]
        c = F.col(f"`{name}`")
        return c.cast(shared) if shared is not None else canon(c, dt, **opts)
    return df.select(value(key).alias(KEY), *[value(c).alias(v) for c, v in inner.items()],
                     F.lit(which == 0).alias("__src"))


def _tuple_counts(source: DataFrame, target: DataFrame, key: str, cols: list[str],
                  opts: dict) -> tuple[DataFrame, dict, dict]:
    """Steps 1-2: ``key_col, __v*, __cs, __ct`` per distinct (key, value tuple).

    One aggregation over the union of both sides replaces two aggregates and
    their full outer join: the same result with one exchange for both sides,
    no sort-merge join, and NULL grouped with NULL without null-safe join keys.
    """
    inner = {c: f"__v{i}" for i, c in enumerate(cols)}
    plan = _plan_columns(source, target, [key, *cols])
    u = _side(source, key, inner, plan, 0, opts).unionByName(_side(target, key, inner, plan, 1, opts))
    j = u.groupBy(KEY, *inner.values()).agg(
        F.count_if(F.col("__src")).alias("__cs"), F.count_if(~F.col("__src")).alias("__ct"))
    return j, inner, plan


def _text(c, key_or_col: str, plan: dict, opts: dict):
    """Canonical text of a grouped column (already text unless it kept its type)."""
    shared = plan[key_or_col][2]
    return canon(c, shared, **opts) if shared is not None else c


def _resolve(source, target, key, columns):
    cols = compare_columns(source, target, key) if columns is None else list(columns)
    if not cols:
        raise DiffError(NO_VALUE_COLUMN_ERROR)
    return cols


def _pairs_and_kind(n_s, n_t, matched):
    pairs = (F.when(n_t == 0, n_s).when(n_s == 0, n_t).otherwise(n_s * n_t - matched))
    kind = (F.when(pairs == 0, F.lit(None).cast("string"))
            .when(n_t == 0, F.lit(MISSING))
            .when(n_s == 0, F.lit(EXTRA))
            .when((n_s == 1) & (n_t == 1), F.lit(CHANGED))
            .otherwise(F.lit(DUPLICATE)))
    return pairs, kind


def key_stats(source: DataFrame, target: DataFrame, key: str = KEY,
              columns: list[str] | None = None, *, strict: bool = False,
              strip_dot_zero_strings: bool = False) -> DataFrame:
    """Per-key counts of a keyed comparison, every key (matched or not).

    ``key_col, n_source, n_target, matched_pairs, mismatch_pairs,
    mismatch_type`` (NULL when the key matches).  Step 3 aggregates numbers
    only, so it runs as a hash aggregate with map-side combining.
    """
    cols = _resolve(source, target, key, columns)
    opts = dict(strict=strict, strip_dot_zero_strings=strip_dot_zero_strings)
    j, _, plan = _tuple_counts(source, target, key, cols, opts)
    cs, ct = F.col("__cs"), F.col("__ct")
    k = j.groupBy(KEY).agg(F.sum(cs).alias("n_source"), F.sum(ct).alias("n_target"),
                           F.sum(cs * ct).alias("matched_pairs"))
    pairs, kind = _pairs_and_kind(F.col("n_source"), F.col("n_target"), F.col("matched_pairs"))
    return k.select(_text(F.col(KEY), key, plan, opts).alias(KEY), "n_source", "n_target",
                    "matched_pairs", pairs.alias("mismatch_pairs"), kind.alias("mismatch_type"))


def _key_rows(source: DataFrame, target: DataFrame, key: str, columns: list[str] | None,
              opts: dict) -> DataFrame:
    """Every key with its counts, classification and shown values (steps 1-3).

    Step 3 also carries, per side, the smallest tuple found on that side only;
    it is shown for a ``missing`` or ``extra`` key (all its rows:
    ``one_sided_rows``) and for a ``value_mismatch``.  Carrying a struct makes step 3 a
    sort-based aggregate (one external sort by key, map-side combining
    kept), which is cheaper than joining the values back afterwards.  Keys
    and values that kept their own type are printed as canonical text here,
    after the comparison.
    """
    cols = _resolve(source, target, key, columns)
    j, inner, plan = _tuple_counts(source, target, key, cols, opts)
    cs, ct = F.col("__cs"), F.col("__ct")
    tup = F.struct(*[F.col(v) for v in inner.values()])
    k = j.groupBy(KEY).agg(
        F.sum(cs).alias("n_source"), F.sum(ct).alias("n_target"),
        F.sum(cs * ct).alias("matched_pairs"),
        F.min(F.when((cs > 0) & (ct == 0), tup)).alias("__ts"),
        F.min(F.when((ct > 0) & (cs == 0), tup)).alias("__tt"))
    n_s, n_t = F.col("n_source"), F.col("n_target")
    pairs, kind = _pairs_and_kind(n_s, n_t, F.col("matched_pairs"))
    k = k.select(_text(F.col(KEY), key, plan, opts).alias(KEY), "n_source", "n_target",
                 "matched_pairs", pairs.alias("mismatch_pairs"), kind.alias("mismatch_type"),
                 "__ts", "__tt")
    kind = F.col("mismatch_type")
    show_s = (kind == MISSING) | (kind == CHANGED) & (n_s == 1)
    show_t = (kind == EXTRA) | (kind == CHANGED) & (n_t == 1)
    value_cols = []
    for c, v in inner.items():
        value_cols += [F.when(show_s, _text(F.col("__ts")[v], c, plan, opts)).alias(f"{c}_source"),
                       F.when(show_t, _text(F.col("__tt")[v], c, plan, opts)).alias(f"{c}_target")]
    k = k.select(KEY, "n_source", "n_target", "matched_pairs", "mismatch_pairs", "mismatch_type",
                 *value_cols)
    changed = F.array_join(F.array_compact(F.array(*[
        F.when(F.col(f"{c}_source") != F.col(f"{c}_target"), F.lit(c)) for c in inner])), ",")
    return k.withColumn("changed_columns", F.when(kind == CHANGED, changed))


def keyed_diff(source: DataFrame, target: DataFrame, key: str = KEY,
               columns: list[str] | None = None, *, strict: bool = False,
               strip_dot_zero_strings: bool = False) -> DataFrame:
    """CMP-2 / 2a / 2b: one row per key that has at least one mismatch.

    ``mismatch_type`` is ``missing_in_target``, ``extra_in_target``,
    ``value_mismatch`` (one row each side, values differ; ``changed_columns``
    lists the differing columns) or ``duplicate_key`` (the key repeats on a
    side; ``mismatch_pairs`` is the number of unequal source/target row pairs,
    exactly the reference's row count for that key).  ``<c>_source`` /
    ``<c>_target`` hold the normalised values: of a one-sided key its smallest
    row (``one_sided_rows`` lists them all), of a ``value_mismatch`` the row
    of each side; a ``duplicate_key`` shows none.
    """
    opts = dict(strict=strict, strip_dot_zero_strings=strip_dot_zero_strings)
    return _key_rows(source, target, key, columns, opts).where(F.col("mismatch_pairs") > 0)


def one_sided_rows(source: DataFrame, target: DataFrame, key: str = KEY, columns: list[str] | None = None, *,
                   strict: bool = False, strip_dot_zero_strings: bool = False) -> DataFrame:
    """CMP-2b detail: every distinct row of the keys that one side lacks, with how
    often it occurs: ``key_col, mismatch_type, <columns>, n_rows``.

    The distinct rows of the comparison meet the keys' totals in one join; a
    key that repeats gives a row per distinct tuple, and no pairs are formed.
    """
    cols = _resolve(source, target, key, columns)
    opts = dict(strict=strict, strip_dot_zero_strings=strip_dot_zero_strings)
    rows, inner, plan = _tuple_counts(source, target, key, cols, opts)
    totals = rows.groupBy(F.col(KEY).alias("__k")).agg(F.sum("__cs").alias("__ns"), F.sum("__ct").alias("__nt"))
    one_sided = totals.where((F.col("__ns") == 0) | (F.col("__nt") == 0))
    found = rows.join(one_sided, rows[KEY].eqNullSafe(one_sided["__k"]))
    return found.select(
        _text(F.col(KEY), key, plan, opts).alias(KEY),
        F.when(F.col("__nt") == 0, F.lit(MISSING)).otherwise(F.lit(EXTRA)).alias("mismatch_type"),
        *[_text(F.col(v), c, plan, opts).alias(c) for c, v in inner.items()],
        (F.col("__cs") + F.col("__ct")).alias("n_rows"))


def keyed_diff_result(name: str, source: DataFrame, target: DataFrame, key: str = KEY,
                      columns: list[str] | None = None, check_type: str = "value_match",
                      sample_size: int = KEYED_SAMPLE, **opts) -> DataFrame:
    """One-row check result of a keyed comparison; one Spark job.

    ``source_value`` / ``target_value`` are ``"<n> rows"``; ``mismatch_count``
    is the reference's count (see module docstring); ``mismatch_breakdown``
    counts mismatches per type and value mismatches per column; the sample
    holds the first ``sample_size`` mismatching keys in key order
    (TakeOrderedAndProject: each task keeps its own top rows); with
    ``sample_size=0`` no sample is planned.

    Both branches read every column of the per-key table (the per-column
    counts use the values), so their plans coincide below the final
    aggregates and Spark runs the comparison's shuffles once; the final
    per-key aggregate after the last shuffle runs in each branch (sharing it
    through another exchange was tried: the branches prune different columns,
    so that exchange is not reused).
    """
    o = dict(strict=opts.get("strict", False), strip_dot_zero_strings=opts.get("strip_dot_zero_strings", False))
    try:
        cols = _resolve(source, target, key, columns)
        rows = _key_rows(source, target, key, cols, o)
    except DiffError as e:
        return error_result(source.sparkSession, name, check_type, str(e))
    kinds = [MISSING, EXTRA, CHANGED, DUPLICATE]
    totals = rows.agg(
        count_text(F.coalesce(F.sum("n_source"), F.lit(0)), "rows").alias("source_value"),
        count_text(F.coalesce(F.sum("n_target"), F.lit(0)), "rows").alias("target_value"),
        F.coalesce(F.sum("mismatch_pairs"), F.lit(0)).alias("mismatch_count"),
        F.struct(*[F.coalesce(F.sum(F.when(F.col("mismatch_type") == k, F.col("mismatch_pairs"))),
                              F.lit(0)).alias(k) for k in kinds]).alias("__by_type"),
        F.struct(*[F.count_if((F.col("mismatch_type") == CHANGED)
                              & (F.col(f"{c}_source") != F.col(f"{c}_target"))).alias(c) for c in cols])
        .alias("__by_column"))
    # sample_size=0: no sample, and no branch computing one
    out = one_row_join(totals, sample_json(rows.where(F.col("mismatch_pairs") > 0), [KEY], sample_size)) \
        if sample_size > 0 else totals.withColumn("mismatch_sample", F.lit(None).cast("string"))
    out = out.select(
        "source_value", "target_value", "mismatch_count", "mismatch_sample",
        (F.col("mismatch_count") == 0).alias("passed"),
        F.to_json(F.struct(F.col("__by_type").alias("by_type"),
                           F.col("__by_column").alias("by_column"))).alias("mismatch_breakdown"))
    return result_frame(out, name, check_type)


def column_results(source: DataFrame, target: DataFrame, key: str = KEY, columns: list[str] | None = None, *,
                   strict: bool = False, strip_dot_zero_strings: bool = False) -> DataFrame:
    """Every value column compared by itself, all in one comparison: per column
    ``column_name, n_source, n_target, missing_in_target, extra_in_target,
    value_mismatch, duplicate_key, mismatch_count`` - the counts that a keyed
    comparison of that column alone gives.

    Both sides are grouped once by (key, all values), each value in its own
    type, so the key is computed, hashed and shuffled once for all columns.  A
    key with one row a side is settled by comparing its two rows column by
    column, a one-sided or wholly equal key by its counts.  What is left, keys
    that repeat and differ somewhere, is taken apart by column and counted per
    (key, column, value): only these rows are multiplied by the columns.
    """
    cols = _resolve(source, target, key, columns)
    opts = dict(strict=strict, strip_dot_zero_strings=strip_dot_zero_strings)
    rows, inner, plan = _tuple_counts(source, target, key, cols, opts)
    cs, ct = F.col("__cs"), F.col("__ct")
    tup = F.struct(*[F.col(v) for v in inner.values()])
    keys = rows.groupBy(KEY).agg(
        F.sum(cs).alias("n_s"), F.sum(ct).alias("n_t"), F.sum(cs * ct).alias("matched"),
        F.min(F.when((cs > 0) & (ct == 0), tup)).alias("__ts"), F.min(F.when((ct > 0) & (cs == 0), tup)).alias("__tt"))
    n_s, n_t = F.col("n_s"), F.col("n_t")
    one_each = (n_s == 1) & (n_t == 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = keys.agg(
        total(n_s).alias("n_source"), total(n_t).alias("n_target"),
        total(F.when(n_t == 0, n_s)).alias(MISSING), total(F.when(n_s == 0, n_t)).alias(EXTRA),
        F.array(*[F.struct(F.lit(c).alias("column_name"),
                           F.count_if(one_each & ~F.col("__ts")[v].eqNullSafe(F.col("__tt")[v])).alias(CHANGED))
                  for c, v in inner.items()]).alias("each"))
    by_column = totals.select("n_source", "n_target", MISSING, EXTRA, F.inline("each"))

    repeated = keys.where((n_s > 0) & (n_t > 0) & ~one_each & (F.col("matched") < n_s * n_t)).select(F.col(KEY).alias("__k"))
    apart = rows.join(repeated, F.col(KEY).eqNullSafe(F.col("__k")), "left_semi").select(
        KEY, "__cs", "__ct", F.inline(F.array(*[F.struct(F.lit(c).alias("__c"), _text(F.col(v), c, plan, opts).alias("__v"))
                                                for c, v in inner.items()])))
    values = apart.groupBy(KEY, "__c", "__v").agg(F.sum(cs).alias("cs"), F.sum(ct).alias("ct"))
    pairs = values.groupBy(KEY, "__c").agg((F.sum("cs") * F.sum("ct") - F.sum(F.col("cs") * F.col("ct"))).alias("pairs"))
    duplicates = pairs.groupBy(F.col("__c").alias("column_name")).agg(F.sum("pairs").alias(DUPLICATE))

    out = by_column.join(duplicates, "column_name", "left").withColumn(DUPLICATE, F.coalesce(DUPLICATE, F.lit(0)))
    return out.select("column_name", "n_source", "n_target", MISSING, EXTRA, CHANGED, DUPLICATE,
                      (F.col(MISSING) + F.col(EXTRA) + F.col(CHANGED) + F.col(DUPLICATE)).alias("mismatch_count"))


def column_breakdown(diff_rows: DataFrame) -> DataFrame:
    """Number of ``value_mismatch`` keys per compared column, from ``keyed_diff`` rows."""
    cols = [c[:-len("_source")] for c in diff_rows.columns if c.endswith("_source") and c != "n_source"]
    return diff_rows.agg(*[
        F.count_if((F.col("mismatch_type") == CHANGED)
                   & (F.col(f"{c}_source") != F.col(f"{c}_target"))).alias(c) for c in cols])


# ---------------------------------------------------------------- CMP-3 set diff

def set_membership(source: DataFrame, target: DataFrame, col: str = VAL, **opts) -> DataFrame:
    """Every distinct normalised value with side flags ``in_source`` / ``in_target``.

    Both sides are stacked and grouped by value once: partial aggregation
    collapses repeated (and hot) values before the one exchange, and no join
    is needed to line the two sides up.  Values of one shared type whose text
    is one-to-one (see ``_shared_type``) are grouped in that type and printed
    afterwards.
    """
    plan = _plan_columns(source, target, [col])
    inner = {}
    s = _side(source, col, inner, plan, 0, opts)
    t = _side(target, col, inner, plan, 1, opts)
    g = s.unionByName(t).groupBy(KEY).agg(
        (F.count_if(F.col("__src")) > 0).alias("in_source"),
        (F.count_if(~F.col("__src")) > 0).alias("in_target"))
    return g.select(_text(F.col(KEY), col, plan, opts).alias(VAL), "in_source", "in_target")


def set_diff(source: DataFrame, target: DataFrame, col: str = VAL, **opts) -> DataFrame:
    """CMP-3: values present on one side only: ``val, mismatch_type``."""
    m = set_membership(source, target, col, **opts)
    return m.where(F.col("in_source") != F.col("in_target")).select(
        VAL, F.when(F.col("in_source"), F.lit(MISSING)).otherwise(F.lit(EXTRA)).alias("mismatch_type"))


def _two_sided_sample(diff: DataFrame, order_by: list[str], each: int) -> DataFrame:
    parts = None
    for kind in (MISSING, EXTRA):
        part = diff.where(F.col("mismatch_type") == kind).orderBy(*order_by).limit(each)
        parts = part if parts is None else parts.unionByName(part)
    packed = F.struct(F.col("mismatch_type"), *[F.col(c) for c in order_by],
                      *[F.col(c) for c in diff.columns if c not in order_by and c != "mismatch_type"])
    agg = parts.agg(F.sort_array(F.collect_list(packed)).alias("__s"))
    return agg.select(F.when(F.size("__s") > 0, F.to_json("__s", {"ignoreNullFields": "false"}))
                      .alias("mismatch_sample"))


def set_diff_result(name: str, source: DataFrame, target: DataFrame, col: str = VAL,
                    check_type: str = "value_match", sample_each: int = SET_SAMPLE_EACH_SIDE,
                    **opts) -> DataFrame:
    m = set_membership(source, target, col, **opts)
    totals = m.agg(
        count_text(F.count_if("in_source"), "distinct values").alias("source_value"),
        count_text(F.count_if("in_target"), "distinct values").alias("target_value"),
        F.count_if(F.col("in_source") != F.col("in_target")).alias("mismatch_count"))
    diff = m.where(F.col("in_source") != F.col("in_target")).select(
        VAL, F.when(F.col("in_source"), F.lit(MISSING)).otherwise(F.lit(EXTRA)).alias("mismatch_type"))
    # sample_each=0: no sample, and no branches computing one
    out = one_row_join(totals, _two_sided_sample(diff, [VAL], sample_each)) if sample_each > 0 else totals
    return result_frame(out.withColumn("passed", F.col("mismatch_count") == 0), name, check_type)


# ---------------------------------------------------------------- CMP-4 row-set diff

def _positional_text(df: DataFrame, width: int) -> DataFrame:
    """Columns by position as (text with NULL -> '', is-null flag); no normalisation."""
    cols = []
    for i in range(width):
        if i < len(df.columns):
            c = df[i].cast("string")
            cols += [F.coalesce(c, F.lit("")).alias(f"c{i}"), c.isNull().alias(f"n{i}")]
        else:
            cols += [F.lit(None).cast("string").alias(f"c{i}"), F.lit(None).cast("boolean").alias(f"n{i}")]
    return df.select(*cols)


def row_set_membership(source: DataFrame, target: DataFrame) -> DataFrame:
    """Distinct row tuples (by position, as text) with ``in_source`` / ``in_target``.

    Sides with different column counts share no tuple, as in the reference.
    NULL is kept apart from every text (the reference prints it as ``None``).
    One aggregation over both sides stacked, as in ``set_membership``.
    """
    width = max(len(source.columns), len(target.columns))
    same_width = len(source.columns) == len(target.columns)
    s = _positional_text(source, width).withColumn("__side", F.lit(0))
    t = _positional_text(target, width).withColumn("__side", F.lit(1))
    keys = [x for i in range(width) for x in (f"c{i}", f"n{i}")]
    # Sides of different widths must not meet: the side joins the grouping key.
    group = keys if same_width else [*keys, "__side"]
    m = s.unionByName(t).groupBy(*group).agg(
        (F.count_if(F.col("__side") == 0) > 0).alias("in_source"),
        (F.count_if(F.col("__side") == 1) > 0).alias("in_target"))
    out = [F.when(~F.col(f"n{i}"), F.col(f"c{i}")).alias(f"c{i}") for i in range(width)]
    return m.select(*out, "in_source", "in_target")


def row_set_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """CMP-4: distinct rows present on one side only: ``c0..cN, mismatch_type``."""
    m = row_set_membership(source, target)
    cols = [c for c in m.columns if c.startswith("c")]
    return m.where(F.col("in_source") != F.col("in_target")).select(
        *cols, F.when(F.col("in_source"), F.lit(MISSING)).otherwise(F.lit(EXTRA)).alias("mismatch_type"))


def row_set_diff_result(name: str, source: DataFrame, target: DataFrame,
                        check_type: str = "value_match",
                        sample_each: int = SET_SAMPLE_EACH_SIDE) -> DataFrame:
    m = row_set_membership(source, target)
    cols = [c for c in m.columns if c.startswith("c")]
    totals = m.agg(
        count_text(F.count_if("in_source"), "distinct values").alias("source_value"),
        count_text(F.count_if("in_target"), "distinct values").alias("target_value"),
        F.count_if(F.col("in_source") != F.col("in_target")).alias("mismatch_count"))
    diff = m.where(F.col("in_source") != F.col("in_target")).select(
        *cols, F.when(F.col("in_source"), F.lit(MISSING)).otherwise(F.lit(EXTRA)).alias("mismatch_type"))
    out = one_row_join(totals, _two_sided_sample(diff, cols, sample_each)) if sample_each > 0 else totals
    return result_frame(out.withColumn("passed", F.col("mismatch_count") == 0), name, check_type)


# ---------------------------------------------------------------- CMP-1 scalar

SCALAR_SHAPE_ERROR = "a scalar comparison needs one row and one column on each side"
SCALAR_COLUMNS = ["source_value", "target_value", "passed", "mismatch_count", "error_message"]


def _scalar_side(df: DataFrame, side: str) -> DataFrame:
    """One row: how many rows the side holds, and its value (the only one if it is one row)."""
    return df.select(df[0].cast("string").alias("__v")).agg(
        F.count(F.lit(1)).alias(f"__n_{side}"), F.min("__v").alias(f"{side}_value"))


def scalar_compare(source: DataFrame, target: DataFrame) -> DataFrame:
    """CMP-1: one row and one column on each side, compared as raw text without
    normalisation (``10.00`` differs from ``10.0``, as in the reference).

    ``source_value, target_value, passed, mismatch_count, error_message``.  A side
    of another shape is an error, never a comparison of some row of it.
    """
    if len(source.columns) != 1 or len(target.columns) != 1:
        return error_result(source.sparkSession, "", "", f"{SCALAR_SHAPE_ERROR}: {len(source.columns)} and "
                            f"{len(target.columns)} columns").select(*SCALAR_COLUMNS)
    out = one_row_join(_scalar_side(source, "source"), _scalar_side(target, "target"))
    single = (F.col("__n_source") == 1) & (F.col("__n_target") == 1)
    eq = F.col("source_value").eqNullSafe(F.col("target_value"))
    shape = F.concat(F.lit(f"{SCALAR_SHAPE_ERROR}: "), F.col("__n_source"), F.lit(" and "), F.col("__n_target"), F.lit(" rows"))
    return out.select(F.when(single, F.col("source_value")).alias("source_value"),
                      F.when(single, F.col("target_value")).alias("target_value"), (single & eq).alias("passed"),
                      F.when(single, F.when(eq, 0).otherwise(1)).cast("bigint").alias("mismatch_count"),
                      F.when(~single, shape).alias("error_message"))


def scalar_result(name: str, source: DataFrame, target: DataFrame,
                  check_type: str = "row_count") -> DataFrame:
    return result_frame(scalar_compare(source, target), name, check_type)


def row_count_result(name: str, source: DataFrame, target: DataFrame) -> DataFrame:
    """CHKTYPE-1: ``COUNT(*)`` of both sides compared as scalars."""
    return scalar_result(name, source.agg(F.count(F.lit(1)).alias("cnt")),
                         target.agg(F.count(F.lit(1)).alias("cnt")), "row_count")
