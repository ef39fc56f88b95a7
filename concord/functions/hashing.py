"""Row text and row hashes used by the checksum operators (CHK-*).

A row's text names no column but takes them in the order of their names, so
both sides of a comparison are read alike whatever their column order.  Every
value is written with its length (``V3:abc``), NULL as ``N``: no value can
run into the next one or pass for NULL.

A row has two 64-bit hashes, so a checksum rests on 128 bits a row:

* ``md5`` - the two halves of the MD5 digest, as unsigned numbers.  DuckDB
  gives the same (``CAST('0x' || substr(md5(x), 1, 16) AS UBIGINT)``), which
  lets an independent engine verify a checksum.
* ``xxhash64`` - Spark's native hash of the text and of the marked text;
  faster, Spark-only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import value_text

UNSIGNED = "decimal(20,0)"


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    fields = {f.name: f.dataType for f in df.schema.fields}
    names = sorted(fields if columns is None else columns, key=lambda n: (n.lower(), n))
    parts = []
    for n in names:
        text = value_text(F.col(f"`{n}`"), fields[n])
        parts.append(F.coalesce(F.concat(F.lit("V"), F.length(text).cast("string"), F.lit(":"), text), F.lit("N")))
    return F.concat(*parts) if parts else F.lit("")


def _hex_number(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10).cast(UNSIGNED)


def row_hashes(df: DataFrame, columns: list[str] | None = None, flavour: str = "md5") -> tuple[Column, Column]:
    """Two 64-bit hashes of each row."""
    text = row_text(df, columns)
    if flavour == "md5":
        digest = F.md5(text)
        return _hex_number(digest, 1, 16), _hex_number(digest, 17, 16)
    if flavour == "xxhash64":
        return F.xxhash64(text).cast(UNSIGNED), F.xxhash64(F.concat(F.lit("second "), text)).cast(UNSIGNED)
    raise ValueError(f"unknown hash flavour {flavour!r}")
