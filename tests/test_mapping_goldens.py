"""The sample mapping document end to end: read, translate, run; compare with
the golden outcomes derived by hand from the fixture (SURVEY section 5)."""

import pytest

from concord.plans import mapping, report, suite

from . import sample_etl


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    tables = sample_etl.register(spark)
    d = tmp_path_factory.mktemp("mapdoc")
    (d / "etl-mapping-document.csv").write_text(sample_etl.MAPPING_CSV, encoding="utf-8")
    fm = mapping.read_delimited(spark, str(d))
    rows = [r.asDict() for r in fm.orderBy("map_id").collect()]
    cases = mapping.to_checks(rows, tables)
    res = suite.run_cases(spark, cases)
    return {r["check_name"]: r for r in res.collect()}, rows, cases


def test_field_mappings_read(results):
    _, rows, _ = results
    assert [r["map_id"] for r in rows] == [f"S00{i}" for i in range(1, 9)]
    assert rows[6]["transformation"] == "CASE 'NR'→1,'SR'→2,'ER'→3"
    assert [r["is_key"] for r in rows] == [True, True, True, False, True, False, True, False]


def by_prefix(res, prefix):
    hits = [v for k, v in res.items() if k.startswith(prefix)]
    assert len(hits) == 1, (prefix, list(res))
    return hits[0]


def test_row_counts(results):
    res, _, _ = results
    assert by_prefix(res, "row_count sales -> sale_fact")["passed"]
    assert by_prefix(res, "row_count products -> products_dim")["passed"]
    r = by_prefix(res, "row_count customers -> geo_dim")
    assert not r["passed"] and (r["source_value"], r["target_value"]) == ("10", "3")


@pytest.mark.parametrize("mid", ["S001", "S002", "S003", "S004", "S005", "S007", "S008"])
def test_value_matches_pass(results, mid):
    res, _, _ = results
    r = by_prefix(res, f"{mid} value_match")
    assert r["error_message"] is None, r["error_message"]
    assert r["passed"], (mid, r["mismatch_count"], r["mismatch_sample"])


def test_net_amount_has_four_rounding_mismatches(results):
    import json
    res, _, _ = results
    r = by_prefix(res, "S006 value_match")
    assert not r["passed"] and r["mismatch_count"] == 4
    sample = json.loads(r["mismatch_sample"])
    got = {(x["val_source"], x["val_target"]) for x in sample}
    assert got == {("273.29", "273.27"), ("631.02", "631.01"), ("918.9", "918.94"), ("245.62", "245.61")}


def test_dq_and_fk_checks(results):
    res, _, _ = results
    assert by_prefix(res, "S001 null_check")["passed"]
    assert by_prefix(res, "S002 fk_check")["mismatch_count"] == 0
    assert by_prefix(res, "S003 fk_check")["mismatch_count"] == 0
    assert by_prefix(res, "S004 dq_check")["passed"]
    assert by_prefix(res, "S005 dq_check")["passed"]
    # "0-1 range" read literally on net_amt: every row violates it.
    assert by_prefix(res, "S006 dq_check")["mismatch_count"] == 10
    assert by_prefix(res, "S007 dq_check")["passed"]
    assert by_prefix(res, "S008 dq_check")["passed"]


def test_duplicate_check_only_on_identity(results):
    res, _, _ = results
    dup = [k for k in res if "duplicate_check" in k]
    assert sorted(dup) == ["S001 duplicate_check sale_fact.sale_sk", "S007 duplicate_check geo_dim.geo_sk"]
    assert all(res[k]["passed"] for k in dup)


def test_run_counters(spark, results):
    res, _, _ = results
    df = spark.createDataFrame([(1, r["passed"]) for r in res.values()], "run_id int, passed boolean")
    row = report.run_counters(df).collect()[0]
    assert row["total_cases"] == len(res)
    assert row["failed_cases"] == 3  # geo row count, S006 value match, S006 range rule


def test_documents_are_read_without_a_shuffle_of_their_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n \nMapID;Src Table;Src Field\nA1;t;\"x;y\"\nA2;u;z\n")
    (tmp_path / "b.txt").write_text("  | MapID | Src Table |\n|---|---|\n| B1 | t |\n")
    (tmp_path / "c.csv").write_text("")
    got = mapping.read_text_documents(spark, str(tmp_path))
    assert sorted((r["map_id"], r["source_table"], r["source_column"]) for r in got.collect()) == [("A1", "t", "x;y"), ("A2", "u", "z"), ("B1", "t", None)]
    cells = spark.createDataFrame([("d", ["MapID", "Key"]), ("d", ["1", "y"]), ("e", ["no"])], "document string, cells array<string>")
    plan = mapping._from_cell_arrays(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
