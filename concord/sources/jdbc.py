"""Database sources over JDBC (SRC-7 PostgreSQL, SRC-8 MySQL, SRC-9 SQL Server).

One loader for the three dialects.  A query runs inside the database and
arrives as one partition; a table can be read in parallel slices of a numeric
column (``partition_column``), which is the form to use for large tables.
The driver jar of the database must be on the Spark class path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

URL_TEMPLATES = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}",
}
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
}


def jdbc_url(kind: str, **config) -> str:
    if kind not in URL_TEMPLATES:
        raise ValueError(f"Unsupported database type: {kind}")
    return URL_TEMPLATES[kind].format(**config)


def _reader(spark: SparkSession, url: str, user: str | None, password: str | None,
            driver: str | None, fetch_size: int):
    r = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    if user is not None:
        r = r.option("user", user)
    if password is not None:
        r = r.option("password", password)
    if driver:
        r = r.option("driver", driver)
    return r


def read_query(spark: SparkSession, url: str, query: str, *, user: str | None = None,
               password: str | None = None, driver: str | None = None,
               fetch_size: int = 10_000) -> DataFrame:
    """Run ``query`` in the database and read its result."""
    return _reader(spark, url, user, password, driver, fetch_size).option("query", query).load()


def read_table(spark: SparkSession, url: str, table: str, *, user: str | None = None,
               password: str | None = None, driver: str | None = None,
               partition_column: str | None = None, lower_bound: int | None = None,
               upper_bound: int | None = None, num_partitions: int | None = None,
               fetch_size: int = 10_000) -> DataFrame:
    """Read a table, in ``num_partitions`` parallel range slices when a
    ``partition_column`` with bounds is given (filters and column pruning are
    pushed into each slice's SQL)."""
    r = _reader(spark, url, user, password, driver, fetch_size).option("dbtable", table)
    if partition_column is not None:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower_bound)
             .option("upperBound", upper_bound).option("numPartitions", num_partitions))
    return r.load()
