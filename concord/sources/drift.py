"""Typed reading of a folder whose files drift: other columns, other types, bad values (SRC-1, 2, 4, 5).

Type inference per file gives every file its own idea of a column, and a bad
value turns a whole column into text.  Here a folder is one table:

1. Every file's header is found in one text pass (files with equal headers
   are read together, so plans grow with the kinds of headers, not the files).
   A column that a file lacks is NULL there.
2. One aggregate over all files counts, for every column, how many values parse as
   each type of a small lattice: boolean; bigint below double; date below timestamp;
   text above all.  A column gets the type that all but ``tolerated`` of its values fit,
   and of a chain the lowest type that loses none of them.
3. Rows are cast; a row with a value that does not fit its column, or of another
   number of fields than its header, goes to the reject table whole, with its file
   and the reason.  Every input row is in exactly one of the two.

Blank values are NULL and fit every type; a column without values is text.
Quoted line breaks need ``multi_line`` (files then do not split).  Everything but
the headers and one row of counts stays on the executors.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import sniff_delimiter

TOLERATED = 0.05
#: The chains of the lattice, lowest type first, and what a value of the type looks like.
CHAINS = [["boolean"], ["bigint", "double"], ["date", "timestamp_ntz"]]
SHAPES = {
    "boolean": r"(?i)(true|false)",
    "bigint": r"[+-]?[0-9]{1,18}",
    "double": r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,3})?",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "timestamp_ntz": r"[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?",
}
FILE, BAD = "__file", "__bad"


@dataclass
class Folder:
    """``rows``: the typed table with a column ``source_file``; ``rejects``: source_file, reason, record
    (the row as JSON text); ``types``: the columns' types."""

    rows: DataFrame
    rejects: DataFrame
    types: dict[str, str]


def _headers(spark: SparkSession, folder: str, delimiter: str | None) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """Files by (delimiter, columns).  One row a file: its first line."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    firsts = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("line"))
    out: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for r in firsts.orderBy("path").collect():
        line = (r["line"] or "").lstrip("﻿")
        sep = delimiter or sniff_delimiter(line)
        names: list[str] = []
        for i, name in enumerate(next(csv.reader([line], delimiter=sep), [])):
            name = name.strip() or f"column_{i + 1}"
            while name.lower() in {x.lower() for x in names}:
                name += "_2"
            names.append(name)
        out.setdefault((sep, tuple(names)), []).append(r["path"])
    return out


def _texts(spark: SparkSession, folder: str, kind: str, delimiter: str | None, multi_line: bool) -> DataFrame | None:
    """All files as text columns, with their file and the raw text of malformed rows."""
    if kind == "json":
        df = (spark.read.option("recursiveFileLookup", True).option("primitivesAsString", True).option("multiLine", multi_line)
              .option("columnNameOfCorruptRecord", BAD).json(folder))
        texts = [F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.to_json(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]
        df = df.select(*texts, F.col("_metadata.file_path").alias(FILE))
        return df if BAD in df.columns else df.withColumn(BAD, F.lit(None).cast("string"))
    parts = []
    for (sep, names), paths in _headers(spark, folder, delimiter).items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, BAD)])
        reader = spark.read.schema(schema).options(header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, enforceSchema=True,
                                                   columnNameOfCorruptRecord=BAD)
        parts.append(reader.csv(paths).select("*", F.col("_metadata.file_path").alias(FILE)))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def _fits(c: Column, kind: str) -> Column:
    return c.rlike(f"^({SHAPES[kind]})$") & c.try_cast(kind).isNotNull()


def _choose(n: int, parsed: dict[str, int], tolerated: float) -> str:
    for chain in CHAINS:
        if n and parsed[chain[-1]] >= n * (1 - tolerated):
            return next(kind for kind in chain if parsed[kind] == parsed[chain[-1]])
    return "string"


def read_folder(spark: SparkSession, folder: str, kind: str = "csv", *, delimiter: str | None = None, multi_line: bool = False,
                tolerated: float = TOLERATED) -> Folder:
    """The folder's files of one ``kind`` (csv, with any delimiter, or json) as one typed table."""
    texts = _texts(spark, folder, kind, delimiter, multi_line)
    if texts is None:
        raise FileNotFoundError(f"No files in {folder}")
    names = [c for c in texts.columns if c not in (FILE, BAD)]
    value = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names}
    whole = texts.where(F.col(BAD).isNull())
    counts = [F.struct(F.count(value[c]).alias("n"), *[F.count_if(_fits(value[c], k)).alias(k) for k in SHAPES]).alias(f"c{i}") for i, c in enumerate(names)]
    seen = whole.agg(F.count(F.lit(1)), *counts).first()
    types = {c: _choose(seen[f"c{i}"]["n"], seen[f"c{i}"].asDict(), tolerated) for i, c in enumerate(names)}
    wrong = [F.when(value[c].isNotNull() & ~_fits(value[c], k), F.concat(F.lit(f"{c}: not {k}: "), value[c])) for c, k in types.items() if k != "string"]
    reason = F.coalesce(F.when(F.col(BAD).isNotNull(), F.lit("malformed row")), *wrong, F.lit(None).cast("string"))
    judged = texts.withColumn("__reason", reason)
    cast = [(F.col(f"`{c}`") if k == "string" else value[c].try_cast(k)).alias(c) for c, k in types.items()]
    rows = judged.where("__reason IS NULL").select(*cast, F.col(FILE).alias("source_file"))
    record = F.coalesce(F.col(BAD), F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    rejects = judged.where("__reason IS NOT NULL").select(F.col(FILE).alias("source_file"), F.col("__reason").alias("reason"), record.alias("record"))
    return Folder(rows, rejects, types)
