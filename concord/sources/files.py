"""File sources (SRC-1 .. SRC-6) and the SQL / catalog helpers (SRC-10 .. SRC-13).

Readers are lazy: nothing is loaded until an action; the reference copies
each file into an in-memory table first.  A file becomes a temp view named by
its file name (extension included), so a name with a dot must be back-quoted
in SQL: ``SELECT * FROM `sales.csv```.
"""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED_SUFFIXES = (".csv", ".tsv", ".parquet", ".json")
DELIMITER_CANDIDATES = [",", "\t", ";", "|"]
DEFAULT_ALIAS = "data"

# Schemas the reference leaves out of table listings.
SYSTEM_SCHEMAS = ["information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys"]


def _first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else ""


def sniff_delimiter(header_line: str) -> str:
    """Most frequent candidate delimiter in the header line (',' by default)."""
    counts = {d: header_line.count(d) for d in DELIMITER_CANDIDATES}
    best = max(counts, key=lambda d: counts[d])
    return best if counts[best] > 0 else ","


def read_file(spark: SparkSession, path: str, *, schema=None, delimiter: str | None = None) -> DataFrame:
    """SRC-1..4: read one file by suffix with header/delimiter/type inference.

    Pass ``schema`` at scale: inference costs an extra pass over the data.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".csv", ".tsv"):
        sep = delimiter or ("\t" if ext == ".tsv" else sniff_delimiter(_first_line(spark, path)))
        reader = spark.read.option("header", True).option("sep", sep).option("quote", '"') \
            .option("escape", '"').option("multiLine", False)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    if ext == ".json":
        # JSON arrays need whole-file parsing; JSON lines split freely.
        multi = _first_line(spark, path).lstrip().startswith("[")
        reader = spark.read.option("multiLine", multi)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    raise ValueError(f"unsupported file type {ext!r}")


def _list_files(spark: SparkSession, path: str) -> list[str] | None:
    """Entries directly inside ``path`` (any Hadoop file system), or None for a
    file.  A sub-folder counts when its name has a supported suffix: that is
    how Spark itself writes a table (``out.parquet/part-*``)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(f"File not found: {path}")
    if not fs.getFileStatus(hpath).isDirectory():
        return None
    return sorted(st.getPath().toString() for st in fs.listStatus(hpath)
                  if st.isFile() or os.path.splitext(st.getPath().getName())[1].lower() in SUPPORTED_SUFFIXES)


def view_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def register_path(spark: SparkSession, path: str, schemas: dict[str, Any] | None = None) -> list[str]:
    """SRC-5 / SRC-6: one temp view per supported file; ``schemas`` by file name
    save the pass over the data that inferring one takes.

    A folder gives one view per file (unsupported suffixes skipped); a single
    file gives its own view plus the alias ``data``.  Returns the view names.
    """
    files = _list_files(spark, path)
    names = []
    if files is None:
        name = os.path.basename(path.rstrip("/"))
        df = read_file(spark, path, schema=(schemas or {}).get(name))
        df.createOrReplaceTempView(view_name(name))
        df.createOrReplaceTempView(DEFAULT_ALIAS)
        return [name, DEFAULT_ALIAS]
    for f in files:
        name = os.path.basename(f.rstrip("/"))
        if os.path.splitext(name)[1].lower() in SUPPORTED_SUFFIXES:
            read_file(spark, f, schema=(schemas or {}).get(name)).createOrReplaceTempView(view_name(name))
            names.append(name)
    return names


def run_sql(spark: SparkSession, sql: str, params: dict[str, Any] | None = None) -> DataFrame:
    """SRC-10: user SQL over registered views; ``:name`` markers are bound as
    typed parameters, never spliced into the text."""
    return spark.sql(sql, args=params) if params else spark.sql(sql)


def scalar(df: DataFrame) -> Any:
    """SRC-11: first column of the first row, or None (reads one row)."""
    rows = df.limit(1).collect()
    return rows[0][0] if rows else None


def sample_rows(df: DataFrame, n: int = 5) -> list[dict[str, str | None]]:
    """SRC-12: the first ``n`` rows with every value as text; [] on any error."""
    try:
        rows = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).limit(n).collect()
        return [r.asDict() for r in rows]
    except Exception:
        return []


def list_tables(spark: SparkSession) -> DataFrame:
    """SRC-13: tables and views of every schema of the session, system schemas excluded."""
    found = {(t.catalog, t.namespace[0] if t.namespace else None, t.name, t.tableType, t.isTemporary)
             for db in spark.catalog.listDatabases() for t in spark.catalog.listTables(db.name)}
    rows = sorted(found, key=str)  # temporary views are listed in every schema, once here
    df = spark.createDataFrame(rows, "catalog string, namespace string, name string, "
                                     "table_type string, is_temporary boolean")
    return df.where(F.col("namespace").isNull() | ~F.lower("namespace").isin(*SYSTEM_SCHEMAS))
