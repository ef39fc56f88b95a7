"""Target-only checks, DQ rules, checksums, transforms and lookups."""

import datetime as dt
import hashlib
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from concord.functions import dq
from concord.functions import transforms as xf
from concord.operators import checks, checksum, lookups


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame(
        [(1, 5, "A", "short", 202401), (2, -1, "B", "a much longer text", 202413),
         (3, None, None, None, None), (3, 0, "C", "x", 199912)],
        "id int, qty int, code string, name string, period int")


def count(df):
    return df.collect()[0][0]


def test_rules_follow_three_valued_logic(t):
    assert count(checks.dq_check(t, dq.rule_predicate(">0")("qty"))) == 2      # -1, 0; NULL is no violation
    assert count(checks.null_check(t, "qty")) == 1
    assert count(checks.dq_check(t, dq.rule_predicate("ENUM A, B")("code"))) == 1
    assert count(checks.dq_check(t, dq.rule_predicate("LEN≤10")("name"))) == 1
    assert count(checks.dq_check(t, dq.rule_predicate("YYYYMM")("period"))) == 1
    assert count(checks.dq_check(t, dq.rule_predicate("0-1 range")("qty"))) == 2
    assert dq.rule_kind("FK EXISTS") == "fk" and dq.rule_kind("must exist in dim_x") == "fk"
    assert dq.rule_kind("something odd") is None


def test_duplicates_and_orphans(spark, t):
    assert [tuple(r) for r in checks.duplicate_groups(t, "id").collect()] == [(3, 2)]
    parent = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    child = spark.createDataFrame([(1,), (2,), (9,), (9,), (None,)], "pid int")
    got = {(r["pid"], r["cnt"]) for r in checks.orphan_values(child, "pid", parent, "id").collect()}
    assert got == {(9, 2), (None, 1)}  # NULL foreign keys count, as in the LEFT JOIN form
    assert count(checks.fk_violation_count(child, "pid", parent, "id")) == 3


def test_fused_and_grouped_counts(t):
    preds = {"pos": dq.rule_predicate(">0")("qty"), "nn": dq.rule_predicate("NOT NULL")("code")}
    got = {r["check_name"]: r["violations"] for r in checks.violation_counts(t, preds).collect()}
    assert got == {"pos": 2, "nn": 1}
    g = {(r["id"], r["check_name"]): r["violations"]
         for r in checks.grouped_violation_counts(t, "id", preds).collect()}
    assert g[(3, "pos")] == 1 and g[(3, "nn")] == 1 and g[(1, "pos")] == 0


def test_target_only_results(spark, t):
    r = checks.count_check_result("c", checks.null_check(t, "qty")).collect()[0]
    assert (r.passed, r.mismatch_count, r.target_value) == (False, 1, "1")
    r = checks.rows_check_result("d", checks.duplicate_groups(t, "id")).collect()[0]
    assert (r.passed, r.mismatch_count) == (False, 1) and '"id":3' in r.mismatch_sample
    r = checks.count_check_result("n", spark.sql("SELECT CAST(NULL AS INT) AS c")).collect()[0]
    assert r.passed is False and r.error_message


def test_checksum_is_order_independent_and_separates_columns(spark):
    a = spark.createDataFrame([("a", "bc"), ("x", None)], "p string, q string")
    b = spark.createDataFrame([("x", None), ("a", "bc")], "p string, q string").repartition(3)
    c = spark.createDataFrame([("ab", "c"), ("x", "")], "p string, q string")
    ca, cb, cc = (checksum.checksum(d).collect()[0] for d in (a, b, c))
    assert ca == cb and ca != cc
    assert checksum.checksum_gate(a, b) and not checksum.checksum_gate(a, c)
    e = spark.createDataFrame([], "p string")
    assert tuple(checksum.checksum(e).collect()[0]) == (0, D(0), D(0), 0)
    # columns go by name: another order agrees, swapped texts do not; NULL is no text
    assert checksum.checksum_gate(a, a.select("q", "p"))
    assert not checksum.checksum_gate(a, a.selectExpr("q AS p", "p AS q")) and not checksum.checksum_gate(a, a.withColumnRenamed("q", "r"))
    n, m = (spark.createDataFrame([(v, "N")], "p string, q string") for v in (None, "N"))
    assert not checksum.checksum_gate(n, m)
    x1 = checksum.checksum(a, flavour="xxhash64").collect()[0]
    x2 = checksum.checksum(b, flavour="xxhash64").collect()[0]
    assert x1 == x2


def test_transforms(spark):
    df = spark.createDataFrame([(17, 5, dt.date(2025, 12, 1), "NR", "category_name_long_text", "2024-02-30")],
                               "a long, b int, d date, r string, c string, s string")
    r = df.select(
        xf.surrogate_md5("a", "b").alias("md5"),
        xf.period_key("d").alias("pk"),
        xf.code_map("r", {"NR": 1, "SR": 2}).alias("code"),
        xf.substr("c", 1, 8).alias("sub"),
        xf.prefix_pad("b", "E", 6).alias("pad"),
        xf.to_decimal(F.lit(D("2.675")), 10, 2).alias("dec"),
        xf.parse_date("s").alias("bad_date"),
        xf.cast_to(F.lit("12x"), "int").alias("bad_int"),
    ).collect()[0]
    assert r.md5 == hashlib.md5(b"175").hexdigest()  # '+' is text concatenation
    assert (r.pk, r.code, r.sub, r.pad, r.dec) == (202512, 1, "category", "E000005", D("2.68"))
    assert r.bad_date is None and r.bad_int is None


def test_scd2_and_dimension_lookups(spark):
    fact = spark.createDataFrame([(1, 10, dt.date(2025, 12, 1)), (2, 10, dt.date(2026, 3, 1)),
                                  (3, 99, dt.date(2026, 1, 1))], "id int, cust int, d date")
    dim = spark.createDataFrame(
        [(100, 10, dt.date(2025, 12, 1), dt.date(2026, 2, 1), 0),
         (101, 10, dt.date(2026, 2, 1), None, 1)],
        "sk int, cust int, valid_from date, valid_to date, is_current int")
    got = {r["id"]: r["sk"] for r in lookups.scd2_lookup(fact, dim, "cust", "cust", "d", "sk").collect()}
    assert got == {1: 100, 2: 101, 3: None}  # start inclusive, open end, missing stays NULL
    cur = {r["id"]: r["sk"] for r in
           lookups.scd2_lookup(fact, dim, "cust", "cust", "d", "sk", mode="current").collect()}
    assert cur == {1: 101, 2: 101, 3: None}
    names = spark.createDataFrame([(10, "ten")], "k int, name string")
    out = lookups.dim_lookup(fact, names, "cust", "k", ["name"], broadcast_max_rows=1000)
    assert {r["id"]: r["name"] for r in out.collect()} == {1: "ten", 2: "ten", 3: None}
    a = spark.createDataFrame([(1, "p1")], "pk int, pname string")
    b = spark.createDataFrame([(1, 7)], "b_pk int, b_sk int")
    c = spark.createDataFrame([(7, "s7")], "sk int, sname string")
    j = lookups.bridge_join(a, b, c, "pk", "b_pk", "b_sk", "sk").collect()[0]
    assert (j.pname, j.sname) == ("p1", "s7")
