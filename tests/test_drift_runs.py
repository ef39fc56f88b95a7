"""Folders of drifting files, and runs that are stored once."""

import pytest

from concord.plans import report
from concord.sources import drift


def _folder(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


FILES = {
    "a.csv": "id,amount,day,ok\n1,10,2020-01-02,true\n2,20,2020-01-03,false\n3,,,\n",
    "b.csv": "amount,id,name\n1.5,4,x\n-2e3,5,\"a,b\"\nn/a,6,z\n",
    "c/d.tsv": "id\tday\n7\t2020-02-01 10:30:00\n8\t2020-02-02\nnine\t2020-02-03\n",
    "short.csv": "id,amount\n10\n11,1,2\n12,1\n",
    "empty.csv": "", "header_only.csv": "id,brand_new\n", "bom.csv": "﻿id;ID;\n13;1;2\n",
}


def test_one_typed_table_and_every_row_once(spark, tmp_path):
    got = drift.read_folder(spark, _folder(tmp_path, FILES), tolerated=0.2)
    assert {k: v for k, v in got.types.items()} == {"id": "bigint", "amount": "double", "day": "timestamp_ntz", "ok": "boolean", "name": "string",
                                                    "brand_new": "string", "ID_2": "bigint", "column_3": "bigint"}
    rows = {r["id"]: r for r in got.rows.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 7, 8, 12, 13]
    assert rows[5]["amount"] == -2000.0 and rows[5]["name"] == "a,b" and rows[3]["amount"] is None and rows[13]["ID_2"] == 1
    assert str(rows[7]["day"]) == "2020-02-01 10:30:00" and str(rows[1]["day"]) == "2020-01-02 00:00:00" and rows[1]["ok"] is True
    assert rows[4]["source_file"].endswith("b.csv")
    bad = sorted((r["source_file"].rsplit("/", 1)[1], r["reason"]) for r in got.rejects.collect())
    assert bad == [("b.csv", "amount: not double: n/a"), ("d.tsv", "id: not bigint: nine"), ("short.csv", "malformed row"), ("short.csv", "malformed row")]


def test_widening_stops_at_the_lowest_type_that_loses_nothing():
    counts = dict(boolean=0, bigint=90, double=98, date=0, timestamp_ntz=0)
    assert drift._choose(100, counts, 0.05) == "double"
    assert drift._choose(100, counts | {"double": 90}, 0.05) == "string"
    assert drift._choose(100, counts | {"double": 90}, 0.1) == "bigint"
    assert drift._choose(0, dict.fromkeys(counts, 0), 0.05) == "string"


def test_json_lines_drift_too(spark, tmp_path):
    folder = _folder(tmp_path, {"a.json": '{"id": 1, "v": 2}\n{"id": 2, "v": "2.5"}\n', "b.json": '{"id": 3, "tags": ["x"]}\n{broken\n{"id": "4", "v": 3}\n'})
    got = drift.read_folder(spark, folder, "json")
    assert got.types == {"id": "bigint", "v": "double", "tags": "string"}
    assert sorted((r["id"], r["v"], r["tags"]) for r in got.rows.where("id < 3").collect()) == [(1, 2.0, None), (2, 2.5, None)]
    assert [r["reason"] for r in got.rejects.collect()] == ["malformed row"]


def test_runs_are_read_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = lambda *x: spark.createDataFrame([(v, v * 2) for v in x], "a int, b int")
    first = report.write_run(rows(1, 2), path, "007")
    assert sorted(tuple(r) for r in report.read_runs(spark, path).collect()) == [(1, 2, "007"), (2, 4, "007")]
    report.write_run(rows(1, 2), path, "007")  # again
    report.write_run(rows(9), path, "x/y z", commit=False)  # broke before its commit
    assert report.read_runs(spark, path).count() == 2
    report.write_run(rows(5).withColumnRenamed("b", "c"), path, "x/y z")
    got = report.read_runs(spark, path).collect()
    assert sorted((r["a"], r["run"]) for r in got) == [(1, "007"), (2, "007"), (5, "x/y z")]
    report.commit_run(spark, path, "007", first)  # back to an earlier attempt
    assert [r["a"] for r in report.read_runs(spark, path, ["x/y z"]).collect()] == [5]
    with pytest.raises(FileNotFoundError):
        report.read_runs(spark, path, ["none"])


def test_a_writer_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    good = spark.range(5).toDF("a")
    report.write_run(good, path, "r")
    with pytest.raises(Exception):
        report.write_run(good.selectExpr("raise_error('lost') AS a"), path, "r")
    assert report.read_runs(spark, path).count() == 5
