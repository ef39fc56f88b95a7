"""The check-result record shared by every comparison and check operator.

One row per executed check, the schema of the reference's test result
(``mismatch_count`` widened to BIGINT).  Results are DataFrames: a suite of
checks is a ``unionByName`` of one-row frames and runs as one Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType([
    T.StructField("check_name", T.StringType()),
    T.StructField("check_type", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("source_value", T.StringType()),
    T.StructField("target_value", T.StringType()),
    T.StructField("mismatch_count", T.LongType()),
    T.StructField("mismatch_sample", T.StringType()),
    T.StructField("error_message", T.StringType()),
    # ours: JSON counts per mismatch type and per changed column (keyed diff)
    T.StructField("mismatch_breakdown", T.StringType()),
])
RESULT_COLUMNS = [f.name for f in RESULT_SCHEMA.fields]

# Sample sizes of the reference engine.
KEYED_SAMPLE = 100
SET_SAMPLE_EACH_SIDE = 50
TARGET_SAMPLE = 50

JSON_OPTIONS = {"ignoreNullFields": "false"}


def result_frame(df: DataFrame, name: str, check_type: str) -> DataFrame:
    """Project a one-row frame with (a subset of) the result columns to the full schema."""
    cols = []
    for f in RESULT_SCHEMA.fields:
        if f.name == "check_name":
            cols.append(F.lit(name).alias(f.name))
        elif f.name == "check_type":
            cols.append(F.lit(check_type).alias(f.name))
        elif f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def error_result(spark: SparkSession, name: str, check_type: str, message: str) -> DataFrame:
    row = (name, check_type, False, None, None, None, None, message, None)
    return spark.createDataFrame([row], RESULT_SCHEMA)


def sample_json(rows: DataFrame, order_by: list[str], limit: int) -> DataFrame:
    """One-row frame ``mismatch_sample``: the first ``limit`` rows by ``order_by`` as JSON.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: every task keeps its
    own top ``limit`` and only those reach the final merge, so the sample is
    bounded whatever the number of mismatches.
    """
    ordered = rows.orderBy(*order_by).limit(limit)
    # sort_array on a struct whose leading fields are the order keys restores
    # the order that collect_list does not guarantee.
    lead = [F.col(c) for c in order_by]
    rest = [F.col(c) for c in rows.columns if c not in order_by]
    packed = F.struct(*lead, *rest)
    agg = ordered.agg(F.sort_array(F.collect_list(packed)).alias("__s"))
    return agg.select(
        F.when(F.size("__s") > 0, F.to_json("__s", JSON_OPTIONS)).alias("mismatch_sample"))


def one_row_join(*frames: DataFrame) -> DataFrame:
    """Put the columns of frames holding exactly one row each side by side.

    No join: the frames are stacked (each padding the others' columns with
    NULL) and every column takes its one non-null value.  All inputs are
    global aggregates or bounded samples, so this stacks a handful of rows.
    """
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return stacked.agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in cols])


def count_text(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {unit}"))
