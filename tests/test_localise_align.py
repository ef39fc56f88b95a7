"""Checksum tree, as-of sweep, tolerance matching and alignment against brute force."""

import datetime
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.operators import alignment, checktree, diff, lookups, tolerance


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- checksum tree

def _sides(spark, seed):
    r = random.Random(seed)
    src = [(r.choice([None, str(r.randrange(400))]) if i % 50 == 0 else str(i), r.choice([None, "", "a", "b"]), r.randrange(5)) for i in range(400)]
    tgt = [(k, r.choice([v, v, v, v, "x"]), n) for k, v, n in src if r.random() > 0.03] + [("new", "a", 1)] * 2
    schema = "key_col string, val string, num int"
    return spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema).withColumn("num", F.col("num").cast("long"))


@pytest.mark.parametrize("bits,leaf,most", [(10, 64, 1 << 16), (2, 2, 1 << 16), (3, 1, 20)])
def test_tree_diff_equals_keyed_diff(spark, monkeypatch, bits, leaf, most):
    for name, value in (("BITS", bits), ("LEAF_ROWS", leaf), ("MAX_NODES", most)):
        monkeypatch.setattr(checktree, name, value)
    s, t = _sides(spark, bits)
    assert rows_of(checktree.tree_diff(s, t)) == rows_of(diff.keyed_diff(s, t))
    assert rows_of(checktree.tree_diff(s, t.limit(0))) == rows_of(diff.keyed_diff(s, t.limit(0)))
    as_number = s.where("key_col rlike '^[0-9]+$'").withColumn("key_col", F.col("key_col").cast("int"))
    assert rows_of(checktree.tree_diff(as_number, t)) == rows_of(diff.keyed_diff(as_number, t))


def test_only_differing_leaves_are_compared(spark):
    s = spark.range(300_000).select(F.col("id").alias("key_col"), (F.col("id") * 7).alias("val"))
    t = s.withColumn("val", F.when(F.col("key_col").isin(5, 77_777, 250_000), -1).otherwise(F.col("val"))).where("key_col <> 123456")
    leaves = checktree.differing_leaves(s, t)
    assert leaves.level == 2 and leaves.history[0][1] == 4 and leaves.history[1][2] < 40
    assert {r["key_col"] for r in checktree.tree_diff(s, t).collect()} == {"5", "77777", "250000", "123456"}
    plan = checktree.tree_diff(s, t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2
    same = checktree.differing_leaves(s, s)
    assert same.nodes == [] and checktree.tree_diff(s, s).count() == 0
    assert [tuple(r)[2:] for r in checktree.localised(s, s).collect()] == [(0, 0)]
    twice = s.unionByName(s.where("key_col = 9").unionByName(s.where("key_col = 9")))  # a xor would cancel these
    assert {r["key_col"] for r in checktree.tree_diff(s, twice).collect()} == {r["key_col"] for r in diff.keyed_diff(s, twice).collect()} | set()
    assert len(checktree.differing_leaves(s, twice).nodes) == 1


# ---------------------------------------------------------------- as-of sweep

DAY0 = datetime.date(2020, 1, 1)


def _history(seed, overlaps):
    r, out, sk = random.Random(seed), [], 0
    for key in [None, *range(12)]:
        day = 0
        for _ in range(r.randint(0, 6)):
            start = day + r.randint(0, 3)
            end = start + r.randint(1, 60) if overlaps or True else None
            out.append((sk, key, DAY0 + datetime.timedelta(start), None if r.random() < 0.1 and not overlaps else DAY0 + datetime.timedelta(end)))
            sk += 1
            if out[-1][3] is None:
                break
            day = end - r.randint(0, 20) if overlaps else end + r.randint(0, 10)
            day = max(day, start + 1)
    return out


def _facts(seed):
    r = random.Random(seed)
    return [(i, r.choice([None, 3, 3, 3, *range(13)]), r.choice([None, *[DAY0 + datetime.timedelta(r.randint(-5, 300)) for _ in range(9)]])) for i in range(700)]


@pytest.mark.parametrize("overlaps,slice_days", [(False, 1), (False, 365), (True, 7), (True, 30)])
def test_asof_sweep_equals_brute_force(spark, overlaps, slice_days):
    versions, facts = _history(4, overlaps), _facts(5)
    dim = spark.createDataFrame(versions, "sk long, id int, valid_from date, valid_to date")
    fact = spark.createDataFrame(facts, "row int, k long, t date").withColumn("version", F.lit("own")).withColumn("cell", F.lit(1))
    got = lookups.scd2_asof(fact, dim, "k", "id", "t", "sk", slice_days=slice_days)
    assert got.columns == [*fact.columns, "sk"]
    want = {}
    for i, k, t in facts:
        started = [v for v in versions if k is not None and t is not None and v[1] == k and v[2] <= t]
        last = max(started, key=lambda v: v[2], default=None)
        want[i] = last[0] if last and (last[3] is None or t < last[3]) else None
    assert {r["row"]: r["sk"] for r in got.collect()} == want and any(v is not None for v in want.values())
    if not overlaps:
        joined = lookups.scd2_lookup(fact, dim, "k", "id", "t", "sk")
        assert rows_of(got) == rows_of(joined)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert lookups.scd2_asof(fact, dim.limit(0), "k", "id", "t", "sk").where("sk IS NULL").count() == 700
    assert lookups.scd2_asof(fact.limit(0), dim, "k", "id", "t", "sk").count() == 0


def test_asof_hot_key_is_spread_and_times_count(spark):
    ts = datetime.datetime
    dim = spark.createDataFrame([(1, 7, ts(2020, 1, 1, 12), ts(2020, 1, 2)), (2, 7, ts(2020, 1, 2), None)], "sk int, id int, valid_from timestamp_ntz, valid_to timestamp_ntz")
    fact = spark.createDataFrame([(i, 7, t) for i, t in enumerate([ts(2020, 1, 1, 11, 59), ts(2020, 1, 1, 12), ts(2020, 1, 1, 23, 59), ts(2020, 1, 2), ts(2029, 5, 5)])],
                                 "i int, k int, t timestamp_ntz")
    got = lookups.scd2_asof(fact, dim, "k", "id", "t", "sk", out="found")
    assert [r["found"] for r in got.orderBy("i").collect()] == [None, 1, 1, 2, 2]


def test_version_faults(spark):
    d = datetime.date
    rows = [(1, d(2020, 1, 1), d(2020, 2, 1)), (1, d(2020, 2, 1), d(2020, 3, 1)), (1, d(2020, 3, 5), None), (2, d(2020, 1, 1), None), (2, d(2021, 1, 1), None),
            (3, d(2020, 1, 1), d(2020, 1, 1)), (4, None, None), (5, d(2020, 1, 1), d(2020, 6, 1)), (5, d(2020, 5, 1), d(2020, 7, 1))]
    got = lookups.scd2_faults(spark.createDataFrame(rows, "id int, valid_from date, valid_to date"), "id")
    assert sorted((r["id"], r["fault"]) for r in got.collect()) == [(1, "gap"), (2, "overlap"), (3, "empty"), (4, "no_start"), (5, "overlap")]


# ---------------------------------------------------------------- tolerance

def largest_matching(s, t, absolute, relative):
    """By augmenting paths."""
    edges = [[j for j, b in enumerate(t) if (a is None and b is None) or (a is not None and b is not None and tolerance.near(a, b, absolute, relative))] for a in s]
    partner = {}

    def augment(i, seen):
        for j in edges[i]:
            if j not in seen:
                seen.add(j)
                if j not in partner or augment(partner[j], seen):
                    partner[j] = i
                    return True
        return False

    return sum(augment(i, set()) for i in range(len(s)))


ODD = [None, math.nan, math.inf, -math.inf, 1e30, 1e30 * (1 + 1e-9), 1e-13, 0.0, -0.0, -1e-13, 5.0, 5.005]


@pytest.mark.parametrize("absolute,relative", [(0.0, 0.0), (1e-12, 0.0), (0.3, 0.0), (0.0, 1e-6), (0.05, 0.1)])
def test_tolerance_matches_as_many_rows_as_can_be(spark, absolute, relative):
    r = random.Random(6)
    value = lambda: r.choice([r.choice(ODD), round(r.uniform(-2, 2), 1), round(r.uniform(0, 30), 2)])
    side = lambda: [(r.choice([None, "a", "hot", "hot", "hot", "b", "c"]), value(), r.choice(["x", None])) for _ in range(260)]
    src, tgt = side(), side() + [("only", 1.0, None)]
    schema = "key_col string, v double, g string"
    got = tolerance.tolerance_stats(spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema), "v", same=["g"], absolute=absolute, relative=relative)
    want = {}
    for k in {x[0] or "" for x in src + tgt}:
        rows = lambda x: [y for y in x if (y[0] or "") == k]  # noqa: E731,B023
        matched = sum(largest_matching([y[1] for y in rows(src) if y[2] == g], [y[1] for y in rows(tgt) if y[2] == g], absolute, relative) for g in ("x", None))
        want[k] = (len(rows(src)), len(rows(tgt)), matched)
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == want


def test_a_hot_key_s_chains_cross_task_borders(spark):
    """One key holds all rows; every number is near the next, so one chain runs over all tasks."""
    n = 4000
    src = spark.range(n).selectExpr("'k' AS key_col", "cast(id AS double) AS v")
    tgt = spark.range(n).selectExpr("'k' AS key_col", "cast(id AS double) + 0.4 AS v").where("v <> 17.4")
    for absolute, matched in ((0.5, n - 1), (1.0, n - 1), (0.1, 0)):
        got = tolerance.tolerance_stats(src, tgt, "v", absolute=absolute).collect()
        assert [tuple(r) for r in got] == [("k", n, n - 1, matched)]


def test_tolerance_diff_kinds_and_empty_sides(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 1e30)], "key_col int, v double")
    t = spark.createDataFrame([(1, "1.001"), (3, "3.5"), (4, "1e30"), (9, "1")], "key_col int, v string").withColumn("v", F.col("v").cast("decimal(38,6)"))
    got = {r["key_col"]: r["mismatch_type"] for r in tolerance.tolerance_diff(s, t, "v", absolute=0.01).collect()}
    assert got == {"2": "missing_in_target", "3": "value_mismatch", "9": "extra_in_target"}
    assert tolerance.tolerance_diff(s.limit(0), s.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        tolerance.tolerance_stats(s, t, "v", relative=1.0)


# ---------------------------------------------------------------- alignment

def brute_alignment(src, tgt, width):
    out = Counter()
    low = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    for key in {r[0] for r in src + tgt}:
        s, t = (Counter(r[1:] for r in side if r[0] == key) for side in (src, tgt))
        s, t = s - t, t - s
        for agreed in alignment.rounds(width):
            group = lambda side: {g: sorted((x for x in side.elements() if tuple(x[i] for i in agreed) == g), key=low)  # noqa: E731,B023
                                  for g in {tuple(x[i] for i in agreed) for x in side}}  # noqa: B023
            gs, gt = group(s), group(t)
            for g in gs.keys() & gt.keys():
                for a, b in zip(gs[g], gt[g]):
                    out[key, a, b] += 1
                    s[a] -= 1
                    t[b] -= 1
            s, t = +s, +t
        for a, n in s.items():
            out[key, a, None] += n
        for b, n in t.items():
            out[key, None, b] += n
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_alignment_follows_its_rule(spark, width):
    r = random.Random(width)
    row = lambda: (r.choice([1, 2, 2, 2, 3, 4, None]), *[r.choice([None, 0, 1, 2, 3][: 2 + (width < 4) * 3]) for _ in range(width)])
    src, tgt = [row() for _ in range(220)], [row() for _ in range(200)] + [(77, *[1] * width)] * 3
    names = [f"c{i}" for i in range(width)]
    schema = "key_col int, " + ", ".join(f"{c} int" for c in names)
    got = alignment.aligned_rows(spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema)).collect()
    text = lambda x: "" if x is None else str(x)
    want = Counter()
    for (key, a, b), n in brute_alignment(src, tgt, width).items():
        kind = "missing_in_target" if b is None else "extra_in_target" if a is None else "value_mismatch"
        changed = ",".join(c for c, x, y in zip(names, a, b) if x != y) if a and b else None
        shown = tuple(x for c in range(width) for x in (a and text(a[c]), b and text(b[c])))
        want[(text(key), kind, changed, *shown)] += n
    assert Counter({tuple(r)[:-1]: r["n_rows"] for r in got}) == want


def test_alignment_of_a_hot_key_and_empty_sides(spark):
    s = spark.range(30_000).selectExpr("1 AS key_col", "cast(id % 500 AS int) AS a", "cast(id % 40 AS int) AS b")
    t = s.withColumn("b", F.when(F.col("a") % 10 == 0, F.col("b") + 100).otherwise(F.col("b"))).where("a <> 7")
    got = alignment.aligned_rows(s, t)
    kinds = {r["row_type"]: r["n"] for r in got.groupBy("row_type").agg(F.sum("n_rows").alias("n")).collect()}
    assert kinds == {"missing_in_target": 60, "value_mismatch": 3000}
    assert {r["changed_columns"] for r in got.where("row_type = 'value_mismatch'").collect()} == {"b"}
    assert alignment.aligned_rows(s.limit(0), s.limit(0)).count() == 0
    assert alignment.aligned_rows(s, s).count() == 0
