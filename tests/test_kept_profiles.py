"""Profiles that are kept by batch, statistics from footers, rules in any order."""

import random
import re

from pyspark.sql import functions as F

from concord.operators import profile
from concord.plans import mapping
from tests import sample_etl


def test_merged_sketches_are_within_their_bound_and_rule_out_no_key(spark):
    df = spark.range(60_000).selectExpr("id % 5 AS batch", "id AS k", "id % 20000 AS d", "cast(id % 7 AS string) AS s", "if(id % 3 = 0, null, id) AS n",
                                        "id * 1.5 AS x", "if(id = 59999, 0, id) AS almost")
    state = profile.batch_sketches("t", df, "batch")
    assert state.count() == 5 * 6
    got = {r["column_name"]: r for r in profile.key_profile({"t": df.drop("batch")}, state).collect()}
    for c, d in (("k", 60_000), ("d", 20_000), ("s", 7), ("n", 40_000), ("x", 60_000), ("almost", 59_999)):
        assert abs(got[c]["approx_distinct"] - d) <= profile.SKETCH_SLACK * d + 2 and got[c]["n_rows"] == 60_000
    assert got["n"]["n_nulls"] == 20_000
    assert {c for c, r in got.items() if r["is_key_candidate"]} == {"k", "x"}


def test_a_new_batch_adds_its_sketches_only(spark, tmp_path):
    path = str(tmp_path / "s")
    load = lambda b: spark.range(1000).selectExpr(f"{b} AS batch", f"id + {b} * 1000 AS k", "id % 10 AS g")
    profile.batch_sketches("t", load(0), "batch").write.parquet(path)
    first = {r["column_name"]: r["approx_distinct"] for r in profile.merged_profile(spark.read.parquet(path)).collect()}
    profile.batch_sketches("t", load(1), "batch").write.mode("append").parquet(path)
    both = {r["column_name"]: r["approx_distinct"] for r in profile.merged_profile(spark.read.parquet(path)).collect()}
    assert both["g"] == first["g"] == 10 and both["k"] > 1.8 * first["k"]
    assert profile.batch_sketches("t", load(0).limit(0), "batch").count() == 0


def test_footers_answer_without_a_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    (spark.range(1000).selectExpr("id", "cast(id AS int) % 9 AS m", "if(id % 4 = 0, null, id * 0.5D) AS x", "date_add(date'2020-01-01', cast(id AS int)) AS d",
                                  "id > 10 AS b", "concat('t', id) AS s", "array(id) AS a").repartition(3).write.parquet(path))
    df = profile.footer_session(spark).read.parquet(path)
    plan = profile.footer_aggregate(df)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedAggregation: \[COUNT\(\*\), ", plan) and "min(id)" in plan and "max(d)" in plan
    got = {r["column_name"]: tuple(r)[1:] for r in profile.footer_statistics(spark, path).collect()}
    assert got == {"id": (1000, 1000, "0", "999"), "m": (1000, 1000, "0", "8"), "x": (1000, 750, "0.5", "499.5"), "d": (1000, 1000, "2020-01-01", "2022-09-26"),
                   "b": (1000, 1000, "false", "true"), "s": (1000, 1000, None, None)}
    scanned = spark.read.parquet(path).agg(F.min("id"), F.max("x")).first()
    assert str(scanned[0]) == got["id"][2] and str(scanned[1]) == got["x"][3]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session is as it was


def test_a_shuffled_document_gives_the_same_cases(spark, tmp_path):
    tables = sample_etl.register(spark)
    (tmp_path / "etl-mapping-document.csv").write_text(sample_etl.MAPPING_CSV, encoding="utf-8")
    fm = [r.asDict() for r in mapping.read_delimited(spark, str(tmp_path)).orderBy("map_id").collect()]
    identity = {}
    for r in fm:
        if r["is_key"]:
            identity.setdefault(r["target_table"], r["target_column"])
    cases = lambda rows: sorted(({k: v for k, v in c.items() if k != "id"} for c in mapping.to_checks(rows, tables, identity)), key=repr)
    want = cases(fm)
    assert any("net_amt" in c["name"] and c["validation_status"] == "valid" for c in want)
    for seed in range(6):
        rows = [dict(r) for r in fm]
        random.Random(seed).shuffle(rows)
        assert cases(rows) == want


def test_rules_in_a_circle_are_manual(spark):
    spark.range(3).selectExpr("id", "id AS p", "id AS q").createOrReplaceTempView("circle_src")
    spark.range(3).selectExpr("id AS k", "id AS a", "id AS b", "id AS c", "id AS d").createOrReplaceTempView("circle_tgt")
    tables = {t: spark.table(t) for t in ("circle_src", "circle_tgt")}
    row = lambda target, rule, key=False: dict(map_id=target, source_table="circle_src", source_column="p", target_table="circle_tgt", target_column=target,
                                               transformation=rule, is_key=key, dq_rule=None)
    rows = [row("a", "b*(1-q)"), row("b", "a*(1-q)"), row("c", "a*q"), row("d", "p*q"), row("k", "direct", True)]
    order, circular = mapping.in_rule_order(rows, tables)
    assert circular == {0, 1, 2} and order == [3, 4]
    cases = {c["name"]: c for c in mapping.to_checks(rows, tables)}
    for t in "abc":
        found = next(c for n, c in cases.items() if n.startswith(f"{t} value_match"))
        assert found["validation_status"] == "manual" and mapping.CIRCLE in found["description"]
    assert next(c for n, c in cases.items() if n.startswith("d value_match"))["validation_status"] == "valid"
