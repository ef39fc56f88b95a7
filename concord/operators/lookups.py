"""Lookup transforms that are joins: SCD2 (XF-2), dimension (XF-3) and bridge (XF-12).

Join strategy is left to Spark: with adaptive execution on, a side whose
*measured* size is under ``spark.sql.autoBroadcastJoinThreshold`` becomes a
broadcast hash join at run time, and a hot fact key is split by the skew-join
rule.  ``broadcast_if_small`` forces a broadcast only after a bounded row
count proves the side small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int | None) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df``.

    The check reads at most ``max_rows + 1`` rows, so its cost is bounded
    whatever the size of ``df``.  ``max_rows=None`` leaves the choice to Spark.
    """
    if max_rows is None:
        return df
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def _c(df: DataFrame, c: Column | str) -> Column:
    return df[c] if isinstance(c, str) else c


def scd2_lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, at: str,
                surrogate: str, *, out: str | None = None, valid_from: str = "valid_from",
                valid_to: str = "valid_to", current_flag: str = "is_current",
                mode: str = "asof", broadcast_max_rows: int | None = None) -> DataFrame:
    """XF-2: attach the dimension's surrogate key to every fact row.

    ``mode="asof"``: the version with ``valid_from <= at < valid_to`` (start
    inclusive, end exclusive, NULL end = open).  ``mode="current"``: the row
    flagged current.  A left join: a fact row without a version gets NULL, so
    an FK check reports it instead of the row vanishing.
    """
    out = out or surrogate
    d = dim.select(F.col(dim_key).alias("__dk"), F.col(surrogate).alias("__sk"),
                   F.col(valid_from).alias("__vf"), F.col(valid_to).alias("__vt"),
                   *([F.col(current_flag).alias("__cur")] if mode == "current" else []))
    if mode == "current":
        d = d.where(F.col("__cur").cast("int") == 1)
        cond = fact[fact_key] == d["__dk"]
    elif mode == "asof":
        t = fact[at]
        cond = ((fact[fact_key] == d["__dk"]) & (t >= d["__vf"])
                & (d["__vt"].isNull() | (t < d["__vt"])))
    else:
        raise ValueError(f"unknown SCD2 mode {mode!r}")
    d = broadcast_if_small(d, broadcast_max_rows)
    joined = fact.join(d, cond, "left")
    return joined.select(*[fact[c] for c in fact.columns], F.col("__sk").alias(out))


def dim_lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
               columns: dict[str, str] | list[str], *, broadcast_max_rows: int | None = None) -> DataFrame:
    """XF-3: left join a dimension and take ``columns`` (``{dim_col: out_name}``)."""
    cols = {c: c for c in columns} if isinstance(columns, list) else dict(columns)
    d = dim.select(F.col(dim_key).alias("__dk"), *[F.col(k).alias(f"__d_{v}") for k, v in cols.items()])
    d = broadcast_if_small(d, broadcast_max_rows)
    j = fact.join(d, fact[fact_key] == d["__dk"], "left")
    return j.select(*[fact[c] for c in fact.columns], *[F.col(f"__d_{v}").alias(v) for v in cols.values()])


def bridge_join(a: DataFrame, bridge: DataFrame, c: DataFrame, a_key: str, bridge_a_key: str,
                bridge_c_key: str, c_key: str, how: str = "inner") -> DataFrame:
    """XF-12: ``A JOIN B ON a.k = b.k JOIN C ON b.k2 = c.k2`` for tables that
    share no key directly.  Columns keep their names, so they must not clash."""
    ab = a.join(bridge, a[a_key] == bridge[bridge_a_key], how)
    return ab.join(c, ab[bridge_c_key] == c[c_key], how)


# ---------------------------------------------------------------- XF-2 without pairing

DAY = 86_400


def scd2_asof(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, at: str, surrogate: str, *, out: str | None = None,
              valid_from: str = "valid_from", valid_to: str = "valid_to", slice_days: int = 365) -> DataFrame:
    """XF-2 as-of, by a sweep instead of a join: no fact row is paired with a version.

    Facts and versions of a key are stacked, sorted by date (a version before the
    facts of its first moment), and the last version is carried forward; it counts
    if its ``valid_to`` is open or later than the fact.  A key's time is cut into
    slices of ``slice_days``, each sorted by itself, so a key that holds a third of
    the facts is spread over its slices; a slice begins with the version carried
    over from the slices before, found on one row per key and slice.

    Where versions do not overlap the result is that of ``scd2_lookup``.  Where they do
    (``scd2_faults`` lists them), the version that started last decides, and every
    fact keeps one row.  A fact without a version, key or date has NULL."""
    out = out or surrogate
    moment = lambda c: F.col(f"`{c}`").cast("timestamp_ntz")
    # unix_seconds needs a zoned time; all times are read in one zone, so order and slices hold
    cell = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / (DAY * slice_days))
    # Spark orders structs by their fields: the last started version, then the last to end, open ends last
    version = F.struct(moment(valid_from).alias("since"), moment(valid_to).isNull().alias("open"), moment(valid_to).alias("until"),
                       F.col(f"`{surrogate}`").alias("sk"))
    typed = F.col(f"`{fact_key}`").cast(dim.schema[dim_key].dataType) if fact.schema[fact_key].dataType != dim.schema[dim_key].dataType else F.col(f"`{fact_key}`")
    row = F.struct(*[F.col(f"`{c}`") for c in fact.columns])
    facts = fact.select(typed.alias("k"), moment(at).alias("t"), row.alias("row"))
    versions = dim.select(F.col(f"`{dim_key}`").alias("k"), moment(valid_from).alias("t"), version.alias("version")).where("k IS NOT NULL AND t IS NOT NULL")
    some = facts.where("k IS NOT NULL AND t IS NOT NULL").withColumn("cell", cell(F.col("t")))
    versions = versions.withColumn("cell", cell(F.col("t")))
    # One row per key and slice, with the version that its end carries on.
    cells = versions.groupBy("k", "cell").agg(F.max("version").alias("version"), F.lit(False).alias("asked")).unionByName(
        some.select("k", "cell").distinct().select("k", "cell", F.lit(None).cast(versions.schema["version"].dataType).alias("version"), F.lit(True).alias("asked")))
    cells = cells.groupBy("k", "cell").agg(F.max("version").alias("version"), F.bool_or("asked").alias("asked"))
    before = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (cells.select("k", "cell", "asked", F.last("version", ignorenulls=True).over(before).alias("version"))
               .where("asked AND version IS NOT NULL").select("k", "cell", F.lit(None).cast("timestamp_ntz").alias("t"), "version"))
    nothing = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
    stacked = (versions.unionByName(carried).select("k", "cell", "t", "version", nothing("row", some))
               .unionByName(some.select("k", "cell", "t", nothing("version", versions), "row")))
    order = [F.col("t").asc_nulls_first(), F.col("row").isNotNull(), F.col("version")]
    sweep = Window.partitionBy("k", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = stacked.select("t", "row", F.last("version", ignorenulls=True).over(sweep).alias("v")).where("row IS NOT NULL")
    found = F.when(F.col("v.open") | (F.col("t") < F.col("v.until")), F.col("v.sk")).alias(out)
    rest = facts.where("k IS NULL OR t IS NULL").select("row.*", F.lit(None).cast(dim.schema[surrogate].dataType).alias(out))
    return swept.select("row.*", found).unionByName(rest)


def scd2_faults(dim: DataFrame, dim_key: str, *, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Versions that do not follow on one another: ``<key>, valid_from, valid_to, next_from, fault``.

    ``overlap``: the key's next version starts before this one ends; ``gap``: it starts
    later; ``empty``: the version ends at or before its start; ``no_start``: it has none.
    A version shows its first fault in the order empty, overlap, gap."""
    f, t = F.col(f"`{valid_from}`"), F.col(f"`{valid_to}`")
    later = F.lead(f).over(Window.partitionBy(F.col(f"`{dim_key}`")).orderBy(f, t.asc_nulls_last()))
    fault = (F.when(f.isNull(), "no_start").when(t <= f, "empty").when(later.isNotNull() & (t.isNull() | (later < t)), "overlap")
             .when(later > t, "gap"))
    return dim.select(F.col(f"`{dim_key}`"), f.alias("valid_from"), t.alias("valid_to"), later.alias("next_from"), fault.alias("fault")).where("fault IS NOT NULL")
