"""Comparison operators on tiny frames with the edge rows of FIXTURES.md E."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.operators import diff


def rows(df, order="key_col"):
    return [r.asDict() for r in df.orderBy(order).collect()]


def test_keyed_diff_classifies_and_counts_pairs(spark):
    s = spark.createDataFrame(
        [("1", "a"), ("2", "b"), ("3", "c"), (None, "n"), ("5", "x"), ("5", "y"), ("6", "z")],
        "key_col string, val string")
    t = spark.createDataFrame(
        [("1", "a"), ("2", "B"), ("4", "d"), ("", "n"), ("5", "x"), ("5", "y"), ("6", "z"), ("6", "z")],
        "key_col string, val string")
    got = {r["key_col"]: (r["mismatch_type"], r["mismatch_pairs"]) for r in rows(diff.keyed_diff(s, t))}
    # NULL key joins '' (both normalise to ''); key 5: 2x2 pairs, 2 equal; key 6: 1x2 all equal.
    assert got == {"2": ("value_mismatch", 1), "3": ("missing_in_target", 1),
                   "4": ("extra_in_target", 1), "5": ("duplicate_key", 2)}
    r = diff.keyed_diff_result("k", s, t).collect()[0]
    assert (r.passed, r.mismatch_count, r.source_value, r.target_value) == (False, 5, "7 rows", "8 rows")
    sample = json.loads(r.mismatch_sample)
    assert [x["key_col"] for x in sample] == ["2", "3", "4", "5"]
    assert json.loads(r.mismatch_breakdown)["by_type"]["duplicate_key"] == 2


def test_normalisation_edge_rows(spark):
    s = spark.createDataFrame(
        [("k1", "\tx"), ("k2", "NULL"), ("k3", "7"), ("k4", None), ("k5", "v1.0")],
        "key_col string, val string")
    t = spark.createDataFrame(
        [("k1", "x"), ("k2", ""), ("k3", "7"), ("k4", "None"), ("k5", "v1")],
        "key_col string, val string")
    d = rows(diff.keyed_diff(s, t))
    # strings keep '.0' unless the parity flag is set
    assert [r["key_col"] for r in d] == ["k5"]
    assert rows(diff.keyed_diff(s, t, strip_dot_zero_strings=True)) == []


def test_numeric_text_across_types(spark):
    s = spark.createDataFrame([("a", 7.0, 95.4), ("b", float("nan"), 1e-4)], "key_col string, x double, y double")
    t = spark.createDataFrame([("a", 7, "95.40"), ("b", None, "0.0001")], "key_col string, x long, y string")
    # 7.0 = 7, NaN = NULL ('' both), 0.0001 printed plainly; '95.40' text keeps its zero
    d = rows(diff.keyed_diff(s, t))
    assert [(r["key_col"], r["changed_columns"]) for r in d] == [("a", "y")]


def test_typed_keys_match_text_semantics(spark):
    """Integral keys of both sides group in their own type; the result equals
    the canonical-text comparison (NULL key with NULL key, int with bigint)."""
    s = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c"), (5, "x"), (5, "y")], "key_col int, val string")
    t = spark.createDataFrame([(1, "a"), (None, "n"), (4, "d"), (5, "x")], "key_col bigint, val string")
    got = {r["key_col"]: (r["mismatch_type"], r["mismatch_pairs"]) for r in rows(diff.keyed_diff(s, t))}
    assert got == {"3": ("missing_in_target", 1), "4": ("extra_in_target", 1), "5": ("duplicate_key", 1)}
    # a text key on one side: NULL (int) meets '' (text), both canonical ''
    t2 = spark.createDataFrame([("1", "a"), ("", "n"), ("3", "c"), ("5", "x"), ("5", "y")],
                               "key_col string, val string")
    as_text = s.selectExpr("CAST(key_col AS STRING) AS key_col", "val")
    assert rows(diff.keyed_diff(s, t2)) == rows(diff.keyed_diff(as_text, t2))
    assert [r["key_col"] for r in rows(diff.keyed_diff(s, t2))] == ["5"]
    r = diff.keyed_diff_result("k", s, t).collect()[0]
    assert r.mismatch_count == 3
    assert [x["key_col"] for x in json.loads(r.mismatch_sample)] == ["3", "4", "5"]


def test_typed_values_print_canonical_text(spark):
    s = spark.sql("SELECT 1L AS key_col, CAST(95.40 AS DECIMAL(10,2)) AS v, DATE'2024-01-31' AS d, true AS b, "
                  "CAST(NULL AS INT) AS m")
    t = spark.sql("SELECT 1L AS key_col, CAST(95.41 AS DECIMAL(10,2)) AS v, DATE'2024-01-31' AS d, false AS b, "
                  "7 AS m")
    (r,) = rows(diff.keyed_diff(s, t))
    assert (r["v_source"], r["v_target"], r["d_source"], r["b_source"], r["b_target"]) == \
        ("95.4", "95.41", "2024-01-31", "true", "false")
    assert (r["m_source"], r["m_target"]) == ("", "7")
    assert r["changed_columns"] == "v,b,m"
    # strict keeps the decimal scale in the printed text
    (r,) = rows(diff.keyed_diff(s, t, strict=True))
    assert r["v_source"] == "95.40"


def test_decimal_scale_strict_and_default(spark):
    s = spark.sql("SELECT 'a' AS key_col, CAST(95.40 AS DECIMAL(10,2)) AS v")
    t = spark.sql("SELECT 'a' AS key_col, CAST(95.4 AS DECIMAL(10,1)) AS v")
    assert rows(diff.keyed_diff(s, t)) == []
    assert len(rows(diff.keyed_diff(s, t, strict=True))) == 1


def test_no_value_column_is_an_error(spark):
    s = spark.createDataFrame([("1",)], "key_col string")
    r = diff.keyed_diff_result("k", s, s).collect()[0]
    assert r.passed is False and "at least one value column" in r.error_message


def test_empty_sides(spark):
    e = spark.createDataFrame([], "key_col string, val string")
    s = spark.createDataFrame([("1", "a")], "key_col string, val string")
    r = diff.keyed_diff_result("k", s, e).collect()[0]
    assert (r.mismatch_count, r.target_value) == (1, "0 rows")
    r = diff.keyed_diff_result("k", e, e).collect()[0]
    assert r.passed and r.mismatch_count == 0


def test_set_diff(spark):
    s = spark.createDataFrame([("a",), ("b",), (None,), ("b",)], "val string")
    t = spark.createDataFrame([("a",), ("c",), ("",)], "val string")
    got = {(r["val"], r["mismatch_type"]) for r in diff.set_diff(s, t).collect()}
    assert got == {("b", "missing_in_target"), ("c", "extra_in_target")}
    r = diff.set_diff_result("s", s, t).collect()[0]
    assert (r.source_value, r.target_value, r.mismatch_count) == ("3 distinct values", "3 distinct values", 2)


def test_row_set_diff_keeps_nulls_and_positions(spark):
    s = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    t = spark.createDataFrame([(1, None), (2, "y")], "p int, q string")
    got = {(r["c0"], r["c1"], r["mismatch_type"]) for r in diff.row_set_diff(s, t).collect()}
    assert got == {("2", "x", "missing_in_target"), ("2", "y", "extra_in_target")}
    w = spark.createDataFrame([(1, None, 0)], "a int, b string, c int")
    r = diff.row_set_diff_result("r", s, w).collect()[0]
    assert r.mismatch_count == 3  # different widths: nothing matches


def test_scalar_compare_is_raw_text(spark):
    a = spark.sql("SELECT CAST(10.00 AS DECIMAL(5,2)) AS v")
    b = spark.sql("SELECT CAST(10.0 AS DOUBLE) AS v")
    r = diff.scalar_result("s", a, b).collect()[0]
    assert (r.passed, r.source_value, r.target_value, r.mismatch_count) == (False, "10.00", "10.0", 1)
    r = diff.row_count_result("c", a, b).collect()[0]
    assert r.passed and r.source_value == "1"


keys = st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", "c"])), max_size=40)


@settings(max_examples=6, deadline=None)
@given(keys)
def test_self_diff_is_empty(spark, data):
    df = spark.createDataFrame(data, "key_col int, val string")
    r = diff.keyed_diff_result("self", df, df).collect()[0]
    # identical multisets: only keys with several distinct values pair unequal rows
    expected = 0
    from collections import Counter
    by_key = {}
    for k, v in data:
        by_key.setdefault(k, Counter())[v] += 1
    for c in by_key.values():
        n = sum(c.values())
        expected += n * n - sum(x * x for x in c.values())
    assert r.mismatch_count == expected


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(0, 500), min_size=1, max_size=60), st.integers(0, 20))
def test_injected_faults_are_counted_exactly(spark, ids, n_faults):
    ids = sorted(ids)
    n = min(n_faults, len(ids))
    s = spark.createDataFrame([(i, "v") for i in ids], "key_col int, val string")
    t = spark.createDataFrame([(i, "w" if j < n else "v") for j, i in enumerate(ids)], "key_col int, val string")
    r = diff.keyed_diff_result("f", s, t).collect()[0]
    assert r.mismatch_count == n
    r2 = diff.keyed_diff_result("f", t, s).collect()[0]
    assert r2.mismatch_count == n  # symmetric


typed_rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 12)), st.one_of(st.none(), st.integers(0, 3))),
                      max_size=30)


@settings(max_examples=6, deadline=None)
@given(typed_rows, typed_rows)
def test_typed_comparison_equals_text_comparison(spark, a, b):
    """Integer keys and values grouped in their own type give exactly the rows
    of the same comparison over their text (NULL, repeats and m x n pairs)."""
    s = spark.createDataFrame(a, "key_col int, v bigint")
    t = spark.createDataFrame(b, "key_col bigint, v int")
    as_text = [x.selectExpr("CAST(key_col AS STRING) AS key_col", "CAST(v AS STRING) AS v") for x in (s, t)]
    typed = sorted(tuple(r) for r in diff.keyed_diff(s, t).collect())
    text = sorted(tuple(r) for r in diff.keyed_diff(*as_text).collect())
    assert typed == text
    assert diff.keyed_diff_result("t", s, t).collect()[0].mismatch_count == \
        diff.keyed_diff_result("t", *as_text).collect()[0].mismatch_count
    assert sorted(tuple(r) for r in diff.set_diff(s.select(F.col("v").alias("val")),
                                                   t.select(F.col("v").alias("val"))).collect()) == \
        sorted(tuple(r) for r in diff.set_diff(as_text[0].select(F.col("v").alias("val")),
                                               as_text[1].select(F.col("v").alias("val"))).collect())


def test_key_stats_and_column_breakdown(spark):
    s = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (4, "d", 40)], "key_col int, x string, y int")
    t = spark.createDataFrame([(1, "a", 10), (2, "B", 20), (3, "c", 31), (5, "e", 50)], "key_col int, x string, y int")
    stats = {r["key_col"]: (r["mismatch_type"], r["mismatch_pairs"]) for r in diff.key_stats(s, t).collect()}
    assert stats == {"1": (None, 0), "2": ("value_mismatch", 1), "3": ("value_mismatch", 1),
                     "4": ("missing_in_target", 1), "5": ("extra_in_target", 1)}
    (b,) = diff.column_breakdown(diff.keyed_diff(s, t)).collect()
    assert (b["x"], b["y"]) == (1, 1)


def test_named_key_column_subset_and_empty_sides(spark):
    s = spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5)], "id int, x string, y double")
    t = spark.createDataFrame([(1, "a", 9.0), (2, "c", 2.5)], "id bigint, x string, y double")
    # key given by name; only x compared, so the differing y is ignored
    d = diff.keyed_diff(s, t, key="id", columns=["x"])
    assert [(r["key_col"], r["x_source"], r["x_target"]) for r in d.collect()] == [("2", "b", "c")]
    assert diff.keyed_diff_result("k", s, t, key="id", columns=["x"]).collect()[0].mismatch_count == 1
    empty_s, empty_t = s.limit(0), t.limit(0)
    r = diff.keyed_diff_result("e", empty_s, empty_t, key="id").collect()[0]
    assert (r.passed, r.source_value, r.target_value, r.mismatch_count, r.mismatch_sample) == \
        (True, "0 rows", "0 rows", 0, None)
    r = diff.keyed_diff_result("one", s, empty_t, key="id").collect()[0]
    assert (r.passed, r.mismatch_count) == (False, 2)
    # no value column on both sides: the reference's error, no job
    r = diff.keyed_diff_result("n", s.select("id"), t.select("id"), key="id").collect()[0]
    assert (r.passed, r.error_message) == (False, diff.NO_VALUE_COLUMN_ERROR)


_CELL = st.one_of(st.none(), st.integers(0, 2))
_ROWS = st.lists(st.tuples(_CELL, _CELL, _CELL, st.sampled_from([None, "", "a", " a", "NULL", "b"])), max_size=12)


@settings(max_examples=12, deadline=None)
@given(_ROWS, _ROWS)
def test_column_results_equal_single_column_comparisons(spark, left, right):
    """All columns in one comparison give the counts of each column compared alone:
    repeated keys on either side, NULL keys, NULL cells, typed and text columns."""
    schema = "key_col int, a int, b bigint, c string"
    s, t = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    got = {r["column_name"]: r for r in diff.column_results(s, t).collect()}
    assert set(got) == {"a", "b", "c"}
    for c, r in got.items():
        want = diff.keyed_diff_result("x", s, t, columns=[c], sample_size=0).collect()[0]
        by = json.loads(want["mismatch_breakdown"])
        assert r["mismatch_count"] == want["mismatch_count"]
        assert (f"{r['n_source']} rows", f"{r['n_target']} rows") == (want["source_value"], want["target_value"])
        assert {k: r[k] for k in by["by_type"]} == by["by_type"]
        assert r["value_mismatch"] == by["by_column"][c]
