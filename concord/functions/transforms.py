"""Mapping-rule transforms (XF-1, XF-4 .. XF-11, XF-13) as Column expressions.

Lookup-style rules (XF-2 SCD2, XF-3 dimension, XF-12 bridge) are joins and
live in ``concord.operators.lookups``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def direct(c) -> Column:
    """XF-13: copy the column unchanged (the default rule)."""
    return _c(c)


def surrogate_md5(*cols) -> Column:
    """XF-1: ``MD5(a+b)`` where ``+`` is text concatenation; NULL in -> NULL out."""
    return F.md5(F.concat(*[_c(c).cast("string") for c in cols]))


def to_decimal(c, precision: int, scale: int) -> Column:
    """XF-4 / XF-6: exact decimal with half-up rounding (ANSI: overflow raises)."""
    return _c(c).cast(f"decimal({precision},{scale})")


def period_key(d) -> Column:
    """XF-5: ``YEAR(d) * 100 + MONTH(d)``."""
    d = _c(d)
    return (F.year(d) * 100 + F.month(d)).cast("int")


def code_map(c, mapping: dict, default=None) -> Column:
    """XF-7: ``CASE c WHEN k THEN v ... [ELSE default] END``."""
    c = _c(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def substr(c, pos: int, length: int) -> Column:
    """XF-8: ``SUBSTR(c, pos, length)`` (1-based)."""
    return F.substring(_c(c).cast("string"), pos, length)


def prefix_pad(c, prefix: str, width: int, pad: str = "0") -> Column:
    """XF-9: ``prefix || LPAD(c, width, pad)``."""
    return F.concat(F.lit(prefix), F.lpad(_c(c).cast("string"), width, pad))


def cast_to(c, type_name: str, *, safe: bool = True) -> Column:
    """XF-10: cast to the target type; ``safe`` gives NULL instead of an ANSI error."""
    return _c(c).try_cast(type_name) if safe else _c(c).cast(type_name)


def parse_date(c, fmt: str = "yyyy-MM-dd", *, safe: bool = True) -> Column:
    """XF-11: text to DATE with a pattern; ``safe`` gives NULL on bad input."""
    c = _c(c).cast("string")
    return F.try_to_date(c, fmt) if safe else F.to_date(c, fmt)
