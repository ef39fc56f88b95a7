"""Canonical text of values (NRM-1).

Comparisons are made on text so that a value read from one store equals the
same value read from another store with a different type system.  Every
function here returns a ``Column`` built from public Spark SQL functions, so
the work stays inside whole-stage code generation; there is no Python UDF.

``value_text`` is the engine-independent text of a *non-null* value.
``canon`` adds the comparison normalisation of the reference engine, applied
in this order:

1. NULL becomes ``''``;
2. the value is turned into text (``value_text``);
3. leading and trailing whitespace (spaces, tabs, newlines) is removed;
4. a trailing ``.0`` is removed (numeric columns always; strings only when
   ``strip_dot_zero_strings`` is set, the reference's behaviour);
5. a whole value equal to one of ``NULL_TOKENS`` becomes ``''``.

Decimal columns: in the default mode trailing fractional zeros are removed,
so ``95.40`` equals ``95.4`` and ``7.00`` equals ``7``.  ``strict=True`` keeps
the scale (only a trailing ``.0`` is removed), which is the reference's
behaviour: there ``95.40`` differs from ``95.4``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whole-cell texts that are read as "no value".
NULL_TOKENS = ["nan", "NaN", "None", "null", "NULL"]

# Doubles are printed through DECIMAL(38,12): plain notation, no exponent,
# identical in Spark and DuckDB.  Values that do not survive the round trip
# (NaN, infinities, more than 26 integer digits or 12 decimals) keep the
# engine's own text.
_FLOAT_DECIMAL = "decimal(38,12)"
# Fixed value: the characters Java's regex class \s matches (space, tab,
# newline, vertical tab, form feed, carriage return).
WHITESPACE = " \t\n\u000b\f\r"

# Everything below avoids regular expressions: trimming and suffix tests
# work on Spark's UTF-8 strings directly instead of converting every value
# to a Java string and back.


def _strip_fraction_zeros(text: Column) -> Column:
    """'12.3400' -> '12.34', '7.000' -> '7', '100' -> '100'."""
    stripped = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(text.contains("."), stripped).otherwise(text)


def _drop_dot_zero(text: Column) -> Column:
    """Remove one trailing '.0' ('7.0' -> '7', '7.00' -> '7.00')."""
    return F.when(text.endswith(".0"), text.substr(F.lit(1), F.length(text) - 2)).otherwise(text)


def _float_text(c: Column) -> Column:
    as_dec = c.cast("string").try_cast(_FLOAT_DECIMAL)
    exact = as_dec.isNotNull() & (as_dec.cast("double") == c.cast("double"))
    return F.when(exact, _strip_fraction_zeros(as_dec.cast("string"))).otherwise(c.cast("string"))


def value_text(c: Column | str, dtype: T.DataType, *, strict: bool = False) -> Column:
    """Engine-independent text of a value; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return _float_text(c)
    if isinstance(dtype, T.DecimalType):
        text = c.cast("string")
        return text if strict else _strip_fraction_zeros(text)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Types whose text never has edge whitespace, a trailing '.0' or a null token.
_PLAIN = (*_INTEGRAL, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def canon(c: Column | str, dtype: T.DataType, *, strict: bool = False,
          strip_dot_zero_strings: bool = False) -> Column:
    """Normalised comparison text (never NULL); see module docstring.

    The steps are specialised by type where they cannot change the text
    (integers, booleans, dates and timestamps print without whitespace, a
    trailing '.0' or a null token), which keeps the per-row cost low.
    """
    text = F.coalesce(value_text(c, dtype, strict=strict), F.lit(""))
    if isinstance(dtype, _PLAIN):
        return text
    if isinstance(dtype, T.StringType):
        text = F.btrim(text, F.lit(WHITESPACE))
        if strip_dot_zero_strings:
            text = _drop_dot_zero(text)
    elif isinstance(dtype, T.DecimalType) and not strict:
        pass  # trailing zeros, and so any '.0', are already gone
    else:
        text = _drop_dot_zero(F.btrim(text, F.lit(WHITESPACE)))
    return F.when(text.isin(*NULL_TOKENS), F.lit("")).otherwise(text)
