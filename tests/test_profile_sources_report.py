"""Profiling and discovery, file sources, the suite runner, reports and sinks."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from concord.operators import profile
from concord.plans import mapping, report, suite
from concord.sources import files, jdbc


@pytest.fixture(scope="module")
def star(spark):
    region = spark.createDataFrame([(0, "EU"), (1, "US")], "r_regionkey int, r_name string")
    nation = spark.createDataFrame([(0, "FR", 0), (1, "DE", 0), (2, "CA", 1)],
                                   "n_nationkey int, n_name string, n_regionkey int")
    cust = spark.createDataFrame([(10, 0, "x"), (11, 2, None), (12, 7, "y")],
                                 "c_custkey bigint, c_nationkey int, c_type string")
    orders = spark.createDataFrame([(100, 10), (101, 10), (102, 11)], "o_orderkey bigint, o_custkey bigint")
    return {"region": region, "nation": nation, "customer": cust, "orders": orders}


def test_column_profile(star):
    p = {(r["table_name"], r["column_name"]): r for r in profile.column_profile(star).collect()}
    assert p[("customer", "c_custkey")]["is_key_candidate"]
    assert not p[("customer", "c_type")]["is_key_candidate"] and p[("customer", "c_type")]["n_nulls"] == 1
    assert p[("orders", "o_custkey")]["max_repeat"] == 2 and not p[("orders", "o_custkey")]["is_unique"]
    a = {r["column_name"]: r for r in profile.approx_column_profile("orders", star["orders"]).collect()}
    assert a["o_orderkey"]["approx_distinct"] == 3


def test_foreign_keys_and_related_tables(spark, star):
    fks = {(r["child_table"], r["child_column"], r["parent_table"]): (r["orphan_values"], r["is_fk"])
           for r in profile.discover_foreign_keys(star).collect()}
    assert fks[("orders", "o_custkey", "customer")] == (0, True)
    assert fks[("nation", "n_regionkey", "region")] == (0, True)
    assert fks[("customer", "c_nationkey", "nation")] == (1, False)  # 7 has no nation
    rel = profile.discover_foreign_keys(star)
    cols = profile.column_profile(star).select("table_name", "column_name", "is_key_candidate")
    got = {(r["table_name"], r["reason"]) for r in
           profile.related_tables(spark, ["customer"], rel, cols).collect()}
    assert got == {("customer", "seed"), ("orders", "inbound_fk")}
    got = {(r["table_name"], r["reason"]) for r in
           profile.related_tables(spark, ["orders", "region"], rel, cols).collect()}
    assert ("customer", "outbound_fk") in got
    # the one-call pipeline equals the step-by-step one
    assert {(r["table_name"], r["reason"]) for r in profile.discover_related(star, ["orders", "region"]).collect()} \
        == got


def test_parent_candidates_are_exact_for_fk_discovery(star):
    cand = profile.parent_candidate_columns(star)
    # names, measures and keys without a same-stem partner are never profiled
    assert cand == {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"],
                    "customer": ["c_custkey", "c_nationkey"], "orders": ["o_custkey"]}
    full = profile.column_profile(star).collect()
    a = sorted(tuple(r) for r in profile.discover_foreign_keys(star, full).collect())
    b = sorted(tuple(r) for r in profile.discover_foreign_keys(star).collect())
    assert a == b


def test_schema_listing(spark, star):
    schema = profile.schema_listing(spark, star).where("table_name = 'orders'").collect()
    assert [(r["column_name"], r["data_type"]) for r in schema] == [("o_orderkey", "bigint"),
                                                                    ("o_custkey", "bigint")]
    inv = {(r["table_name"], r["column_name"]): r for r in profile.schema_inventory(star).collect()}
    assert (inv[("customer", "c_type")]["n_rows"], inv[("customer", "c_type")]["n_nulls"]) == (3, 1)
    assert inv[("customer", "c_type")]["nullable"] and inv[("customer", "c_type")]["position"] == 2
    assert inv[("orders", "o_custkey")]["n_nulls"] == 0


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;name\n1;x\n2;y\n")
    (tmp_path / "b.tsv").write_text("id\tv\n1\t2.5\n")
    (tmp_path / "c.json").write_text('[{"id": 1, "k": "z"}, {"id": 2, "k": "w"}]')
    (tmp_path / "d.txt").write_text("ignored")
    spark.createDataFrame([(1,)], "id int").write.parquet(str(tmp_path / "e.parquet"))
    names = files.register_path(spark, str(tmp_path))
    assert sorted(names) == ["a.csv", "b.tsv", "c.json", "e.parquet"]
    assert spark.sql("SELECT sum(id) FROM `a.csv`").collect()[0][0] == 3
    assert files.scalar(files.run_sql(spark, "SELECT count(*) FROM `c.json` WHERE id > :m", {"m": 1})) == 1
    assert files.sample_rows(spark.table("`b.tsv`"), 5) == [{"id": "1", "v": "2.5"}]
    single = files.register_path(spark, str(tmp_path / "a.csv"))
    assert single == ["a.csv", "data"] and spark.table("data").count() == 2
    with pytest.raises(FileNotFoundError):
        files.register_path(spark, str(tmp_path / "missing.csv"))
    assert files.sample_rows(spark.sql("SELECT 1 AS x").where("x > 1")) == []
    assert files.list_tables(spark).where("name = 'data'").count() == 1
    assert jdbc.jdbc_url("mysql", host="h", port=3306, database="d") == "jdbc:mysql://h:3306/d"


def test_pipe_table_and_tab_documents(spark, tmp_path):
    (tmp_path / "m.txt").write_text(
        "| MapID | Src Table | Src Field | Rule/Transform | Tgt Table | Tgt Field | Key | DQ Rule |\n"
        "|---|---|---|---|---|---|---|---|\n"
        "| M1 | emp | emp_id | 'E' || LPAD(emp_id, 6, '0') | emp_t | emp_code | Y | NOT NULL |\n"
        "\n"
        "| M2 | emp | name | nan | emp_t | name | N | None |\n")
    rows = {r["map_id"]: r for r in mapping.read_pipe_tables(spark, str(tmp_path / "m.txt")).collect()}
    assert rows["M1"]["transformation"] == "'E' || LPAD(emp_id, 6, '0')"
    assert rows["M2"]["transformation"] == "DIRECT" and rows["M2"]["dq_rule"] is None
    assert rows["M1"]["is_key"] and rows["M2"]["target_sql_expr"] == "name"
    (tmp_path / "t.tsv").write_text("  MapID \tSrc Table\tSrc Field\tTgt Table\tTgt Field\tKey\n"
                                    "X1\ta\tb\tc\td\tNULL\n")
    r = mapping.read_delimited(spark, str(tmp_path / "t.tsv")).collect()[0]
    assert (r["map_id"], r["target_column"], r["is_key"]) == ("X1", "d", False)


def test_clean_rows_null_tokens(spark):
    df = spark.createDataFrame([(" a ", "nan", None, 3), ("NULL", " None", "x", 4)],
                               "p string, q string, r string, n int")
    got = [tuple(r) for r in mapping.clean_rows(df).orderBy("n").collect()]
    assert got == [("a", "", "", 3), ("", "", "x", 4)]


def test_rule_translation():
    assert mapping.rule_to_sql("MD5(a+b)::CHAR(32)", "a") == \
        "md5(concat(CAST(a AS STRING), CAST(b AS STRING)))"
    assert mapping.rule_to_sql("CASE 'NR'→1,'SR'→2", "r") == "CASE r WHEN 'NR' THEN 1 WHEN 'SR' THEN 2 END"
    assert mapping.rule_to_sql("YEAR(d)*100+MONTH()", "d", "INT") == "YEAR(d)*100+MONTH(d)"
    assert mapping.rule_to_sql("(1-x)*g", "x", "DECIMAL(12,2)", {"g": "q*p"}) == \
        "CAST((1-x)*(q*p) AS DECIMAL(12,2))"
    assert mapping.rule_to_sql("SCD2 lookup dim", "c") is None
    assert mapping.rule_to_sql("", "c") == "c"


def test_suite_runner_dispatch_and_errors(spark):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").createOrReplaceTempView("s1")
    spark.createDataFrame([(1, "a"), (2, "c")], "id int, v string").createOrReplaceTempView("t1")
    cases = [
        {"id": 1, "name": "keyed", "type": "value_match",
         "source_sql": "SELECT id AS key_col, v AS val FROM s1", "target_sql": "SELECT id AS key_col, v AS val FROM t1"},
        {"id": 2, "name": "set", "type": "value_match",
         "source_sql": "SELECT v AS val FROM s1", "target_sql": "SELECT v AS val FROM t1"},
        {"id": 3, "name": "count", "type": "row_count",
         "source_sql": "SELECT COUNT(*) FROM s1", "target_sql": "SELECT COUNT(*) FROM t1"},
        {"id": 4, "name": "nulls", "type": "null_check", "target_sql": "SELECT COUNT(*) FROM t1 WHERE v IS NULL"},
        {"id": 5, "name": "rows", "type": "dq_check", "target_sql": "SELECT id FROM t1 WHERE v <> 'a'"},
        {"id": 6, "name": "none", "type": "custom"},
        {"id": 7, "name": "bad", "type": "custom", "source_sql": "SELECT 1", "target_sql": "SELECT * FROM nope"},
        {"id": 8, "name": "param", "type": "dq_check",
         "target_sql": "SELECT COUNT(*) FROM t1 WHERE id > :lo", "source_sql": None},
        {"id": 9, "name": "gate", "type": "value_match",
         "source_sql": "SELECT * FROM s1", "target_sql": "SELECT * FROM s1"},
    ]
    res = {r["test_case_id"]: r for r in suite.run_cases(spark, cases, params={"lo": 1}).collect()}
    assert (res[1].passed, res[1].mismatch_count) == (False, 1)
    assert (res[2].passed, res[2].mismatch_count) == (False, 2)
    assert res[3].passed and res[3].source_value == "2"
    assert res[4].passed and res[4].target_value == "0"
    assert (res[5].passed, res[5].mismatch_count) == (False, 1)  # one violating row, not a count of 2
    assert res[6].error_message == suite.NO_SQL_ERROR
    assert not res[7].passed and res[7].error_message
    assert res[8].mismatch_count == 1
    lazy = {r["test_case_id"]: r for r in suite.suite_results(spark, cases, params={"lo": 1}).collect()}
    assert lazy == res
    # without samples: the same counts and values, no sample planned
    bare = {r["test_case_id"]: r for r in suite.suite_results(spark, cases, params={"lo": 1}, samples=False).collect()}
    assert all(b.mismatch_sample is None for b in bare.values())
    strip = ("check_name", "passed", "source_value", "target_value", "mismatch_count", "error_message")
    assert {k: tuple(v[c] for c in strip) for k, v in bare.items()} == \
        {k: tuple(v[c] for c in strip) for k, v in res.items()}
    gated = suite.case_result(spark, cases[8], use_checksum=True).collect()[0]
    assert gated.source_value == "Checksum Match" and gated.passed
    assert suite.validate_sql(spark, "SELECT * FROM nope")[0] == "invalid"
    assert suite.validate_sql(spark, "SELECT 1")[0] == "valid"


def test_reports_and_sinks(spark, tmp_path):
    results = spark.createDataFrame(
        [(1, 1, True), (1, 2, False), (2, 1, True), (3, 1, True), (3, 2, True)],
        "run_id int, test_case_id int, passed boolean")
    runs = report.run_counters(results)
    rates = {r["run_id"]: (r["pass_rate"], r["band"]) for r in report.pass_rate(runs).collect()}
    assert rates == {1: (50, "warning"), 2: (100, "good"), 3: (100, "good")}
    page = report.run_page(runs, offset=1, limit=1).collect()
    assert [(r["run_id"], r["total"]) for r in page] == [(2, 3)]
    d = report.dashboard(runs, latest=2).collect()[0]
    assert (d.n_runs, d.passed_latest, d.failed_latest) == (3, 3, 0)
    cases = spark.createDataFrame([(1, "c1", "row_count")], "id int, name string, type string")
    det = {r["test_case_id"]: (r["test_case_name"], r["test_case_type"])
           for r in report.run_detail(results.where("run_id = 1"), cases).collect()}
    assert det == {1: ("c1", "row_count"), 2: ("Deleted Test", "unknown")}
    docs = spark.createDataFrame([(1, "m1", 5, 6, True), (2, "m2", 5, 5, True), (3, "m3", 5, 1, False)],
                                 "id int, name string, source_connector_id int, target_connector_id int, "
                                 "is_active boolean")
    assert {r["name"]: r["role"] for r in report.connector_usage(docs, 5).collect()} == \
        {"m1": "source", "m2": "source & target"}
    out = str(tmp_path / "results")
    report.append_results(results.where("run_id = 1"), out)
    report.append_results(results.where("run_id = 2"), out)
    assert spark.read.parquet(out).count() == 3
    run = spark.createDataFrame([(1, 'Doc "A"', "completed", dt.datetime(2026, 1, 1), 2, 1, 1)],
                                "id int, mapping_name string, status string, started_at timestamp, "
                                "total_cases int, passed_cases int, failed_cases int")
    detail = results.where("run_id = 1").withColumn("test_case_name", F.lit('say "hi"')) \
        .withColumn("test_case_type", F.lit("custom")).withColumn("source_value", F.lit("1")) \
        .withColumn("target_value", F.lit("2")).withColumn("mismatch_count", F.lit(1)) \
        .withColumn("error_message", F.lit(None).cast("string"))
    report.write_report_csv(run, detail, str(tmp_path / "rep"))
    text = "".join(p.read_text() for p in (tmp_path / "rep" / "results").glob("*.csv"))
    assert '"say ""hi"""' in text and "FAIL" in text
    head = "".join(p.read_text() for p in (tmp_path / "rep" / "header").glob("*.csv"))
    assert "Run ID:,1" in head and '"Doc ""A"""' in head
    summary = report.parse_summary(spark.range(3), spark.createDataFrame(
        [("valid",), ("invalid",), ("valid",)], "validation_status string")).collect()[0]
    assert (summary.field_mappings_count, summary.valid_tests, summary.invalid_tests) == (3, 2, 1)


def test_compare_result_dispatch(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "key_col int, val string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "key_col int, val string")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "key_col int, val string")
    # equal multisets: the checksum short-circuit answers without comparing
    r = suite.compare_result(spark, "g", "value_match", a, b, use_checksum=True).collect()[0]
    assert (r.passed, r.source_value) == (True, "Checksum Match")
    # different: keyed comparison (key_col present)
    r = suite.compare_result(spark, "k", "value_match", a, c, use_checksum=True).collect()[0]
    assert (r.passed, r.mismatch_count, r.source_value) == (False, 1, "2 rows")
    # a scalar by its type
    one = spark.sql("SELECT 5 AS n")
    r = suite.compare_result(spark, "s", "scalar", one, spark.sql("SELECT 5 AS n")).collect()[0]
    assert (r.passed, r.source_value) == (True, "5")
    # val only: value set; neither: row set
    r = suite.compare_result(spark, "v", "value_match", a.select("val"), c.select("val")).collect()[0]
    assert (r.mismatch_count, r.source_value) == (2, "2 distinct values")
    r = suite.compare_result(spark, "r", "value_match", a.toDF("p", "q"), c.toDF("p", "q")).collect()[0]
    assert r.mismatch_count == 2
