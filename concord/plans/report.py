"""Run-level aggregation (RUN-1 .. RUN-8) and sinks (SNK-1 .. SNK-3).

Runs and results are DataFrames with the schemas of FIXTURES.md section D;
every function here is a DataFrame -> DataFrame step (the sinks write).
"""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.result import one_row_join

# Pass-rate bands of the reference's report page and its defaults.
GOOD_BAND = 80
WARN_BAND = 50
DEFAULT_PAGE_SIZE = 20
DASHBOARD_RUNS = 10
UNKNOWN_MAPPING = "Unknown Mapping"
DELETED_TEST = "Deleted Test"
UNKNOWN_TYPE = "unknown"


def run_counters(results: DataFrame, run_col: str = "run_id") -> DataFrame:
    """RUN-1: ``run_id, total_cases, passed_cases, failed_cases, status`` per run."""
    return results.groupBy(run_col).agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("passed")).alias("passed_cases"),
        F.count_if(~F.col("passed")).alias("failed_cases"),
    ).withColumn("status", F.lit("completed"))


def run_page(runs: DataFrame, offset: int = 0, limit: int = DEFAULT_PAGE_SIZE,
             run_col: str = "run_id", documents: DataFrame | None = None) -> DataFrame:
    """RUN-2: newest runs first, ``offset``/``limit`` paging, ``total`` = all runs,
    mapping name joined in (``Unknown Mapping`` when the document is gone).

    The page is a top-k (``limit`` is the feature): ``orderBy + offset + limit``.
    """
    total = runs.agg(F.count(F.lit(1)).alias("total"))
    page = runs.orderBy(F.col(run_col).desc()).offset(offset).limit(limit)
    if documents is not None:
        page = page.join(documents.select(F.col("id").alias("mapping_document_id"),
                                          F.col("name").alias("mapping_name")),
                         "mapping_document_id", "left") \
            .withColumn("mapping_name", F.coalesce("mapping_name", F.lit(UNKNOWN_MAPPING)))
    # the total as a scalar subquery: no join with a one-row frame
    return page.select("*", total.scalar().alias("total"))


def pass_rate(runs: DataFrame) -> DataFrame:
    """RUN-5: ``round(100 * passed / total)`` (0 for an empty run) and its band."""
    rate = F.when(F.col("total_cases") > 0,
                  F.round(F.col("passed_cases") * 100.0 / F.col("total_cases"))).otherwise(0).cast("int")
    band = F.when(rate >= GOOD_BAND, "good").when(rate >= WARN_BAND, "warning").otherwise("poor")
    return runs.select("run_id", "total_cases", "passed_cases", rate.alias("pass_rate"), band.alias("band"))


def dashboard(runs: DataFrame, latest: int = DASHBOARD_RUNS, run_col: str = "run_id",
              documents: DataFrame | None = None) -> DataFrame:
    """RUN-4: passed / failed summed over the ``latest`` runs only; run (and
    mapping) counts over all - the reference's dashboard arithmetic."""
    recent = runs.orderBy(F.col(run_col).desc()).limit(latest).agg(
        F.coalesce(F.sum("passed_cases"), F.lit(0)).cast("bigint").alias("passed_latest"),
        F.coalesce(F.sum("failed_cases"), F.lit(0)).cast("bigint").alias("failed_latest"))
    parts = [runs.agg(F.count(F.lit(1)).alias("n_runs")), recent]
    if documents is not None:
        parts.append(active_only(documents).agg(F.count(F.lit(1)).alias("n_mappings")))
    return one_row_join(*parts)


def run_detail(results: DataFrame, cases: DataFrame) -> DataFrame:
    """RUN-3: results with their test case's name and type; a deleted case
    reads ``Deleted Test`` / ``unknown``."""
    c = cases.select(F.col("id").alias("test_case_id"), F.col("name").alias("__n"), F.col("type").alias("__t"))
    j = results.join(c, "test_case_id", "left")
    return j.withColumn("test_case_name", F.coalesce("__n", F.lit(DELETED_TEST))) \
            .withColumn("test_case_type", F.coalesce("__t", F.lit(UNKNOWN_TYPE))).drop("__n", "__t")


def parse_summary(field_mappings: DataFrame, cases: DataFrame) -> DataFrame:
    """RUN-6: counts of field mappings, test cases, valid and invalid cases."""
    fm = field_mappings.agg(F.count(F.lit(1)).alias("field_mappings_count"))
    tc = cases.agg(F.count(F.lit(1)).alias("test_cases_count"),
                   F.count_if(F.col("validation_status") == "valid").alias("valid_tests"),
                   F.count_if(F.col("validation_status") == "invalid").alias("invalid_tests"))
    return one_row_join(fm, tc)


def active_only(df: DataFrame) -> DataFrame:
    """RUN-7: soft-deleted rows (``is_active`` false) are hidden, history kept."""
    return df.where(F.col("is_active"))


def connector_usage(documents: DataFrame, connector_id: int) -> DataFrame:
    """RUN-8: active documents using a connector and its role in each."""
    s = F.col("source_connector_id") == connector_id
    t = F.col("target_connector_id") == connector_id
    role = F.when(s & t, "source & target").when(s, "source").otherwise("target")
    return active_only(documents).where(s | t).select("id", "name", role.alias("role"))


# ---------------------------------------------------------------- sinks

def append_results(results: DataFrame, path: str, run_col: str = "run_id") -> None:
    """SNK-1: append one run's result rows, partitioned by run id."""
    results.write.mode("append").partitionBy(run_col).parquet(path)


# Committed runs: <path>/results/run=<run>/attempt=<attempt>/... and <path>/commits/run=<run>/...

def write_run(results: DataFrame, path: str, run: str, *, commit: bool = True) -> str:
    """SNK-1, once: stores the results of one run and commits them; returns the attempt.

    An attempt writes its rows into a folder of its own; the commit marker, one row
    that names the attempt, replaces the run's marker in one partition overwrite.
    Readers follow the markers, so a run written twice counts once (the last
    committed attempt), and one that broke half-way, or was never committed, is not
    seen, whatever files it left.  Executors may be lost meanwhile: rows go through
    Spark's committer, and the marker is written after them."""
    attempt = uuid.uuid4().hex
    results.write.parquet(f"{path}/results/run={quote(run, safe='')}/attempt={attempt}")
    if commit:
        commit_run(results.sparkSession, path, run, attempt)
    return attempt


def commit_run(spark: SparkSession, path: str, run: str, attempt: str) -> None:
    marker = spark.createDataFrame([(attempt, run)], "committed string, run string")
    (marker.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/commits"))


def read_runs(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """The results of the committed runs, with the column ``run``: one folder a run is read, the
    markers (a row a run) say which."""
    marked = spark.read.schema("committed string, run string").option("basePath", f"{path}/commits").parquet(f"{path}/commits")
    folders = [f"{path}/results/run={quote(r['run'], safe='')}/attempt={r['committed']}" for r in marked.collect() if runs is None or r["run"] in runs]
    if not folders:
        raise FileNotFoundError(f"no committed run in {path}")
    out = spark.read.option("basePath", f"{path}/results").option("mergeSchema", True).schema(_merged(spark, folders)).parquet(*folders)
    return out.drop("attempt")


def _merged(spark: SparkSession, folders: list[str]):
    """The columns of all runs, then run and attempt as text (Spark would read a run 007 as 7)."""
    own = spark.read.option("mergeSchema", True).parquet(*folders).schema
    fields = [f for f in own.fields if f.name not in ("run", "attempt")]
    return T.StructType([*fields, T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])


def report_rows(run: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-3 content: the run header (7 label/value lines) and the result table
    with PASS/FAIL (quoting is done by the CSV writer)."""
    # The report's labels, here and in report_table.
    def line(label, value):
        return F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    header = run.select(F.inline(F.array(
        line("Run ID:", F.col("id")),
        line("Mapping Document:", F.coalesce(F.col("mapping_name"), F.lit("Unknown"))),
        line("Status:", F.col("status")),
        line("Date:", F.col("started_at")),
        line("Total:", F.col("total_cases")),
        line("Passed:", F.col("passed_cases")),
        line("Failed:", F.col("failed_cases")))))
    return header, report_table(results)


def report_table(results: DataFrame) -> DataFrame:
    """SNK-3 result table: one line per result of ``run_detail``, PASS/FAIL,
    empty text for missing values (the CSV writer quotes)."""
    return results.select(
        F.col("test_case_id").alias("Test Case ID"),
        F.coalesce("test_case_name", F.lit("")).alias("Test Name"),
        F.col("test_case_type").alias("Type"),
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("Status"),
        F.coalesce("source_value", F.lit("")).alias("Source Value"),
        F.coalesce("target_value", F.lit("")).alias("Target Value"),
        F.col("mismatch_count").alias("Mismatches"),
        F.coalesce("error_message", F.lit("")).alias("Error Message"))


def write_report_csv(run: DataFrame, results: DataFrame, path: str) -> None:
    """SNK-3: the run report as two CSV outputs under ``path`` (``header/`` and
    ``results/``), quotes doubled inside quoted cells."""
    header, table = report_rows(run, results)
    opts = dict(header=True, quote='"', escape='"', quoteAll=False)
    header.coalesce(1).write.mode("overwrite").options(**{**opts, "header": False}).csv(f"{path}/header")
    table.write.mode("overwrite").options(**opts).csv(f"{path}/results")



def read_report_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The header lines (``label, value``) and the result lines of ``write_report_csv``, all text,
    empty for what is missing."""
    opts = dict(quote='"', escape='"', multiLine=True)
    header = spark.read.schema("label string, value string").options(**opts).csv(f"{path}/header")
    return header.na.fill(""), spark.read.options(header=True, **opts).csv(f"{path}/results").na.fill("")
