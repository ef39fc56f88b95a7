"""What several operators share: the shared folder, words as a column, checked broadcasts."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: 0x20 and 0x09-0x0D.
WORD_BREAKS = " \t\n\x0b\x0c\r"

#: Rows of one 8-byte key up to which a side is broadcast (about 100 MB as a hash table).
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.
    Only where that is unset (tests, one machine) a scratch folder is chosen; a
    cluster without the setting is refused, as its machines share no local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="concord-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, different on every call."""
    return f"{shared_dir(spark).rstrip('/')}/concord-{name}-{uuid.uuid4().hex}"


def spaced(text: Column) -> Column:
    """The text with each word break as one space; null: empty."""
    flat = F.coalesce(text, F.lit(""))
    for c in WORD_BREAKS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return flat


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors (once per application), whose Python
    workers import it: they need not share the driver's path."""
    if spark.sparkContext.applicationId not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="concord-code-"), "concord-code"), "zip", root, "concord")
        spark.sparkContext.addPyFile(archive)
        _shipped.add(spark.sparkContext.applicationId)


def with_code(f: Callable) -> Callable:
    """f(spark, ...) with the package sent first."""

    @functools.wraps(f)
    def g(spark: SparkSession, *args):
        ship(spark)
        return f(spark, *args)

    return g


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; null or blank: none.
    (Splitting at one character takes no regular expression.)"""
    return F.array_remove(F.split(spaced(text), " "), "")


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count proves it has at most ``max_rows``
    rows; else unchanged, so the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def packed(df: DataFrame) -> DataFrame:
    """Every input row as one struct column ``row``: names that an operator adds
    cannot clash with the input's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
