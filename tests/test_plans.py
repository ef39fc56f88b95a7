"""Plan-shape and skew properties the operators rely on at scale."""

from pyspark.sql import functions as F

from concord.operators import checks, diff, profile

PAIRING_JOINS = ("SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "ShuffledHashJoin")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_pairs_are_counted_not_formed(spark):
    # one key holds a third of each side, with three values on each side
    n_hot, n_rest = 3000, 6000
    s = spark.range(n_hot + n_rest).select(
        F.when(F.col("id") < n_hot, F.lit(-1)).otherwise(F.col("id")).alias("key_col"),
        (F.col("id") % 3).alias("val"))
    t = spark.range(n_hot + n_rest).select(
        F.when(F.col("id") < n_hot, F.lit(-1)).otherwise(F.col("id")).alias("key_col"),
        ((F.col("id") + 1) % 3).alias("val"))
    r = diff.keyed_diff_result("hot", s, t).collect()[0]
    # hot key: 1000 rows per value on each side -> 3000*3000 pairs, 3*1000*1000 equal;
    # every other key differs (v vs v+1 mod 3)
    assert r.mismatch_count == n_hot * n_hot - 3 * 1000 * 1000 + n_rest
    hot = diff.keyed_diff(s, t).where("key_col = '-1'").collect()[0]
    assert (hot.n_source, hot.n_target, hot.mismatch_type) == (n_hot, n_hot, "duplicate_key")


def test_comparisons_aggregate_instead_of_joining(spark):
    s = spark.range(100).select(F.col("id").alias("key_col"), (F.col("id") % 7).alias("val"))
    t = spark.range(50, 150).select(F.col("id").alias("key_col"), (F.col("id") % 5).alias("val"))
    for df in (diff.keyed_diff(s, t), diff.keyed_diff_result("k", s, t), diff.set_diff(s, t),
               diff.row_set_diff(s, t), profile.column_profile({"s": s, "t": t}),
               checks.duplicate_groups(s, "val")):
        plan = _plan(df)
        assert not any(j in plan for j in PAIRING_JOINS), plan
        assert "HashAggregate" in plan or "SortAggregate" in plan


def test_orphans_move_distinct_keys(spark):
    child = spark.range(1000).select((F.col("id") % 10).alias("fk"))
    parent = spark.range(5).select(F.col("id").alias("pk"))
    got = {r["fk"]: r["cnt"] for r in checks.orphan_values(child, "fk", parent, "pk").collect()}
    assert got == {k: 100 for k in range(5, 10)}
    # the child side is aggregated to distinct keys (partial count below the
    # exchange) before it meets the parent; raw child rows never enter the join
    plan = _plan(checks.orphan_values(child, "fk", parent, "pk"))
    assert "LeftAnti" not in plan and "LeftOuter" in plan
    assert plan.index("LeftOuter") < plan.index("partial_count")


def test_hot_value_in_set_diff_and_profile(spark):
    # value 0 holds a third of the rows on both sides
    s = spark.range(9000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id")).alias("val"))
    t = spark.range(9000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id") + 1).alias("val"))
    r = diff.set_diff_result("hot", s, t).collect()[0]
    # distinct values: 0 and 3000..8999 vs 0 and 3001..9000 -> one missing, one extra
    assert (r.mismatch_count, r.source_value, r.target_value) == (2, "6001 distinct values", "6001 distinct values")
    p = {x["column_name"]: x for x in profile.column_profile({"s": s}).collect()}
    assert (p["val"]["n_distinct"], p["val"]["max_repeat"], p["val"]["is_unique"]) == (6001, 3000, False)
    assert not any(j in _plan(diff.set_diff(s, t)) for j in PAIRING_JOINS)
