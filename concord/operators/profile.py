"""Profiling and relationship discovery (PRF-1 .. PRF-3, DIS-1 .. DIS-4).

The reference reads declared constraints (primary, unique and foreign keys)
from the database catalog.  Files and most Spark tables declare none, so the
same facts are measured on the data:

* PRF-2 a column is *unique* when no non-null value occurs twice, and a key
  candidate when it is also never NULL;
* PRF-3 a column is a foreign key of a key candidate when every one of its
  non-null values occurs in the parent (inclusion test by anti join).

Tables are passed as ``{name: DataFrame}``.  Work over data is done in Spark
jobs; only per-column summaries (one row per column) reach the driver, where
they decide which column pairs to test.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the reference's id-like column-name pattern (bridge discovery by name).
ID_LIKE_PATTERN = r"(?i).*(_id|_key|_code|_cd|type|code)$"
# Name stems that may carry a foreign key (ours; covers "custkey", "user_id", ...).
KEY_STEM_PATTERN = r"(?i).*(id|key|code|_cd|type)$"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Reasons of the discovery phases, in phase order (ours).
PHASE_REASONS = ["seed", "outbound_fk", "bridge_fk", "bridge_name", "inbound_fk"]


def schema_listing(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """PRF-1: ``table_name, column_name, position, data_type, nullable`` (metadata only)."""
    rows = [(t, f.name, i, f.dataType.simpleString(), f.nullable)
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, "
                                       "data_type string, nullable boolean")


def schema_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """PRF-1 measured: the schema listing plus ``n_rows`` of the table and
    ``n_nulls`` of each column, so a column declared nullable can be told from
    one that holds NULLs.  One aggregate per table (a scan, no shuffle); the
    listing rows are literals of its projection, so nothing is joined."""
    parts = []
    for t, df in tables.items():
        fields = df.schema.fields
        wide = df.agg(F.count(F.lit(1)).alias("__n"),
                      *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"__z{i}") for i, f in enumerate(fields)])
        rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("position"),
                                  F.lit(f.dataType.simpleString()).alias("data_type"),
                                  F.lit(f.nullable).alias("nullable"), F.col(f"__z{i}").alias("n_nulls"))
                         for i, f in enumerate(fields)])
        parts.append(wide.select(F.lit(t).alias("table_name"), F.col("__n").alias("n_rows"), F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "column_name", "position", "data_type", "nullable", "n_rows", "n_nulls")


def _typed_value(c, dt: T.DataType) -> tuple[str, object]:
    """The value in one of three type families (long, double, text), so the
    columns of a family share one unpivoted layout without casting numbers to
    text."""
    if isinstance(dt, (*_INTEGRAL, T.BooleanType)):
        return "long", c.cast("bigint")
    if isinstance(dt, T.DateType):
        return "long", F.unix_date(c).cast("bigint")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "double", c.cast("double")
    if isinstance(dt, T.StringType):
        return "text", c
    return "text", c.cast("string")


def column_profile(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """PRF-2: one row per column: ``table_name, column_name, n_rows, n_nulls,
    n_distinct, max_repeat, is_unique, is_key_candidate``.

    Exact counts, all tables in one job.  Columns are unpivoted to (column id,
    value), one layout per type family (long, double, text), so each family is
    grouped on two columns of one type; counts per value use map-side
    combining (a hot value collapses before the shuffle) and are then summed
    per column.  Column names join back only at the end, on the per-column
    rows.
    """
    spark = next(iter(tables.values())).sparkSession
    ids: list[tuple[int, str, str]] = []
    families: dict[str, list[DataFrame]] = {}
    for t, df in tables.items():
        fields = {f.name: f.dataType for f in df.schema.fields}
        per: dict[str, list] = {}
        for c in (columns or {}).get(t) or df.columns:
            fam, v = _typed_value(F.col(f"`{c}`"), fields[c])
            per.setdefault(fam, []).append(F.struct(F.lit(len(ids)).alias("cid"), v.alias("v")))
            ids.append((len(ids), t, c))
        for fam, structs in per.items():
            families.setdefault(fam, []).append(df.select(F.inline(F.array(*structs))))
    stats = []
    for parts in families.values():
        long = parts[0]
        for p in parts[1:]:
            long = long.unionByName(p)
        per_value = long.groupBy("cid", "v").agg(F.count(F.lit(1)).alias("cnt"))
        stats.append(per_value.groupBy("cid").agg(
            F.sum("cnt").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("cnt"))), F.lit(0)).cast("bigint").alias("n_nulls"),
            F.count_if(F.col("v").isNotNull()).alias("n_distinct"),
            F.coalesce(F.max(F.when(F.col("v").isNotNull(), F.col("cnt"))), F.lit(0)).cast("bigint")
            .alias("max_repeat")))
    prof = stats[0]
    for x in stats[1:]:
        prof = prof.unionByName(x)
    # One row per column: a metadata-sized frame, joined by id.
    names = spark.createDataFrame(ids, "cid int, table_name string, column_name string")
    unique = (F.col("max_repeat") <= 1) & (F.col("n_distinct") > 0)
    return prof.join(F.broadcast(names), "cid").select(
        "table_name", "column_name", "n_rows", "n_nulls", "n_distinct", "max_repeat",
        unique.alias("is_unique"), (unique & (F.col("n_nulls") == 0)).alias("is_key_candidate"))


def approx_column_profile(name: str, df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Cheap one-pass profile of one table (no shuffle of values): ``n_rows,
    n_nulls, approx_distinct`` per column.  A column whose approximate distinct
    count is well below its non-null count cannot be unique, so the exact
    profile can be limited to the remaining columns."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"__z{i}"),
                 F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(f"__d{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__z{i}").alias("n_nulls"),
                              F.col(f"__d{i}").alias("approx_distinct")) for i, c in enumerate(df.columns)])
    return wide.select(F.lit(name).alias("table_name"), F.col("__n").alias("n_rows"), F.inline(rows))


# ---------------------------------------------------------------- profiles that are kept

LOG_K = 12
#: Slack of a sketch's count: five standard errors (1.04 / sqrt(2 ** LOG_K)) and small counts' rounding.
SKETCH_SLACK = 5 * 1.04 / 64


def batch_sketches(name: str, df: DataFrame, batch: str) -> DataFrame:
    """PRF-2 state: ``batch, table_name, column_name, n_rows, n_nulls, sketch``, one row per load
    batch and column, from one aggregation with map-side combining.

    The sketches (HyperLogLog, ``2 ** LOG_K`` registers) of batches add up to that of
    all their rows, so these rows can be stored as batches arrive; a profile reads
    them, not the data.  Numbers and times are sketched as their text."""
    cols = [c for c in df.columns if c != batch]
    text = lambda c: F.col(f"`{c}`").cast("string")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}"), F.hll_sketch_agg(text(c), LOG_K).alias(f"s{i}")]
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"z{i}").alias("n_nulls"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)])
    return (df.groupBy(F.col(f"`{batch}`").alias("batch")).agg(*aggs)
            .select("batch", F.lit(name).alias("table_name"), F.col("n").alias("n_rows"), F.inline(each))
            .select("batch", "table_name", "column_name", "n_rows", "n_nulls", "sketch"))


def merged_profile(sketches: DataFrame) -> DataFrame:
    """``table_name, column_name, n_rows, n_nulls, approx_distinct`` of all batches, from their sketches."""
    return sketches.groupBy("table_name", "column_name").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("approx_distinct"))


def key_profile(tables: dict[str, DataFrame], sketches: DataFrame) -> DataFrame:
    """``merged_profile`` with ``is_key_candidate``, exact: only columns without NULLs whose sketch
    leaves it possible that they are unique are counted on their values; the
    sketches (a row a batch and column) rule the others out."""
    merged = merged_profile(sketches)
    rows = merged.collect()  # a row a column
    wanted: dict[str, list[str]] = {}
    for r in rows:
        if not r["n_nulls"] and r["n_rows"] and r["approx_distinct"] * (1 + SKETCH_SLACK) + 2 >= r["n_rows"]:
            wanted.setdefault(r["table_name"], []).append(r["column_name"])
    keys = {(r["table_name"], r["column_name"]) for r in _profile_subset(tables, wanted) if r["is_key_candidate"]}
    return sketches.sparkSession.createDataFrame([(*r, (r["table_name"], r["column_name"]) in keys) for r in rows],
                                                 T.StructType([*merged.schema.fields, T.StructField("is_key_candidate", T.BooleanType())]))


# ---------------------------------------------------------------- PRF-1 from file statistics

def footer_statistics(spark: SparkSession, path: str) -> DataFrame:
    """``column_name, n_rows, n_values, min_value, max_value`` (as text) of a parquet table, from
    the files' footers where they hold it: Spark's aggregate push-down answers
    count, min and max of numbers, dates and booleans without reading a column.
    Minimum and maximum of other types are NULL (footers cut texts short); a column of
    a nested type is left out.  Where a file lacks statistics Spark reads the column.

    The push-down needs the other parquet reader, so this runs in a session of its
    own beside the caller's."""
    own = footer_session(spark)
    df = own.read.parquet(path)
    rows = footer_aggregate(df).first()
    names = _footer_columns(df)
    out = [(c, rows["n"], rows[f"v{i}"], rows[f"lo{i}"] if whole else None, rows[f"hi{i}"] if whole else None) for i, (c, whole) in enumerate(names)]
    text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    return spark.createDataFrame([(c, n, v, text(lo), text(hi)) for c, n, v, lo, hi in out],
                                 "column_name string, n_rows bigint, n_values bigint, min_value string, max_value string")


def footer_session(spark: SparkSession) -> SparkSession:
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def _footer_columns(df: DataFrame) -> list[tuple[str, bool]]:
    """(column, whether footers hold its exact minimum and maximum)."""
    whole = (*_INTEGRAL, T.FloatType, T.DoubleType, T.BooleanType, T.DateType)
    return [(f.name, isinstance(f.dataType, whole)) for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def footer_aggregate(df: DataFrame) -> DataFrame:
    """One row: n, and per column v (values), lo and hi."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (c, whole) in enumerate(_footer_columns(df)):
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"v{i}"))
        if whole:
            aggs += [F.min(F.col(f"`{c}`")).alias(f"lo{i}"), F.max(F.col(f"`{c}`")).alias(f"hi{i}")]
    return df.agg(*aggs)


def _stem(column: str) -> str:
    """Column name without a short table prefix: ``c_custkey`` -> ``custkey``."""
    m = re.match(r"^[A-Za-z]{1,3}_(.+)$", column)
    return (m.group(1) if m else column).lower()


def _type_family(dt: T.DataType) -> str:
    if isinstance(dt, _INTEGRAL):
        return "integral"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, T.DecimalType) and dt.scale == 0:
        return "integral"
    return dt.simpleString()


def fk_candidates(tables: dict[str, DataFrame], profile_rows: list) -> list[tuple[str, str, str, str]]:
    """Column pairs (child_table, child_column, parent_table, parent_column) worth
    an inclusion test: the parent is a key candidate, both names share a
    key-like stem and the types are of one family."""
    keys = [(r["table_name"], r["column_name"]) for r in profile_rows if r["is_key_candidate"]]
    types = {(t, f.name): f.dataType for t, df in tables.items() for f in df.schema.fields}
    out = []
    for pt, pc in keys:
        stem = _stem(pc)
        if not re.match(KEY_STEM_PATTERN, stem):
            continue
        for (ct, cc), dt in types.items():
            if ct == pt or _stem(cc) != stem:
                continue
            if _type_family(dt) != _type_family(types[(pt, pc)]):
                continue
            out.append((ct, cc, pt, pc))
    return sorted(out)


def _common_type(a: T.DataType, b: T.DataType) -> str:
    if _type_family(a) == "integral" and _type_family(b) == "integral":
        return "decimal(38,0)" if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType) else "bigint"
    return a.simpleString() if a == b else "string"


def inclusion_test(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """PRF-3: for every candidate pair, distinct non-null child values and how
    many of them have no parent.

    All pairs are tested by one aggregation and no join.  A parent column is a
    domain; its own values and those of all its child columns are stacked as
    (domain, child bit or 0 for the parent, value), each table unpivoted in one scan,
    and grouped by (domain, value) with map-side combining: a value's bits
    say which children hold it and whether the parent does.  Counts per
    (domain, child) follow from that.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = ("child_table string, child_column string, parent_table string, parent_column string, "
              "child_distinct bigint, orphan_values bigint, is_fk boolean")
    if not pairs:
        return spark.createDataFrame([], schema)
    domains: dict[tuple, list] = {}  # (parent, type, part) -> its children; at most 62 bits a part
    for ct, cc, pt, pc in pairs:
        typ = _common_type(tables[ct].schema[cc].dataType, tables[pt].schema[pc].dataType)
        part = 0
        while len(domains.setdefault((pt, pc, typ, part), [])) >= 62:
            part += 1
        domains[pt, pc, typ, part].append((ct, cc))
    stacked: dict[str, dict[str, list]] = {}  # by type and table
    names = []
    for d, ((pt, pc, typ, _), children) in enumerate(domains.items()):
        for bit, (t, c) in enumerate([(pt, pc), *children]):
            value = F.col(f"`{c}`").cast(typ)
            stacked.setdefault(typ, {}).setdefault(t, []).append(
                F.struct(F.lit(d).alias("d"), F.lit(1 << bit).cast("bigint").alias("bit"), value.alias("v")))
            if bit:
                names.append((d, bit, t, c, pt, pc))
    counts = []
    for by_table in stacked.values():
        rows = None
        for t, structs in by_table.items():
            one = tables[t].select(F.inline(F.array(*structs)))
            rows = one if rows is None else rows.unionByName(one)
        bits = rows.where("v IS NOT NULL").groupBy("d", "v").agg(F.bit_or("bit").alias("bits"))
        last = F.lit(1)  # of a domain's children
        for d, children in enumerate(domains.values()):
            last = F.when(F.col("d") == d, F.lit(len(children))).otherwise(last) if len(children) > 1 else last
        each = F.filter(F.sequence(F.lit(1), last), lambda b: F.getbit("bits", b) == 1)
        counts.append(bits.select("d", F.explode(each).alias("b"), (F.getbit("bits", F.lit(0)) == 0).alias("orphan"))
                      .groupBy("d", "b").agg(F.count(F.lit(1)).alias("child_distinct"), F.count_if("orphan").alias("orphan_values")))
    found = counts[0]
    for x in counts[1:]:
        found = found.unionByName(x)
    told = spark.createDataFrame(names, "d int, b int, child_table string, child_column string, parent_table string, parent_column string")
    res = told.join(found, ["d", "b"], "left").select(  # one row a pair on either side
        "child_table", "child_column", "parent_table", "parent_column",
        F.coalesce("child_distinct", F.lit(0)).alias("child_distinct"), F.coalesce("orphan_values", F.lit(0)).alias("orphan_values"))
    return res.withColumn("is_fk", (F.col("orphan_values") == 0) & (F.col("child_distinct") > 0))


def parent_candidate_columns(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Columns ``fk_candidates`` could ever pick as a parent, from names and types
    alone: a key-like stem shared with a column of the same type family in
    another table.  Only these need the uniqueness profile for FK discovery,
    so the profile skips measures, names and dates - exactly, since a column
    outside this set is never a candidate whatever its data."""
    fields = [(t, f.name, f.dataType) for t, df in tables.items() for f in df.schema.fields]
    owners: dict[tuple[str, str], set[str]] = {}
    for t, c, dt in fields:
        owners.setdefault((_stem(c), _type_family(dt)), set()).add(t)
    out: dict[str, list[str]] = {}
    for t, c, dt in fields:
        stem = _stem(c)
        if re.match(KEY_STEM_PATTERN, stem) and owners[(stem, _type_family(dt))] - {t}:
            out.setdefault(t, []).append(c)
    return out


def _profile_subset(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> list:
    """Per-column profile rows of the named columns only (one job, one row per column)."""
    chosen = {t: tables[t] for t, cols in columns.items() if cols}
    return column_profile(chosen, columns).collect() if chosen else []


def discover_foreign_keys(tables: dict[str, DataFrame], profile_rows: list | None = None) -> DataFrame:
    """PRF-2 then PRF-3: profile, pick candidate pairs, test inclusion.

    Two Spark jobs.  The profile covers only the possible parents
    (``parent_candidate_columns``) and is the only thing collected, one row
    per column.  Pass ``profile_rows`` to reuse a profile already taken."""
    if profile_rows is None:
        profile_rows = _profile_subset(tables, parent_candidate_columns(tables))
    return inclusion_test(tables, fk_candidates(tables, [r for r in profile_rows if r["is_key_candidate"]]))


def discover_related(tables: dict[str, DataFrame], seeds: list[str]) -> DataFrame:
    """DIS-1 .. DIS-4 end to end: profile the seeds' columns and the possible
    FK parents (one job), test the candidate pairs by inclusion (one job),
    then pick related tables (``related_tables``).

    The profile and the relationships are one row per column and per
    candidate pair - schema-sized - and are brought back as small frames so
    the four discovery phases do not re-run the scans."""
    spark = next(iter(tables.values())).sparkSession
    wanted = parent_candidate_columns(tables)
    for t in seeds:
        if t in tables:
            wanted[t] = list(tables[t].columns)
    prof = _profile_subset(tables, wanted)
    fk = discover_foreign_keys(tables, prof)
    rel = spark.createDataFrame(fk.collect(), fk.schema)
    key_cols = {(r["table_name"], r["column_name"]) for r in prof if r["is_key_candidate"]}
    cols = spark.createDataFrame(
        [(t, c, (t, c) in key_cols) for t, df in tables.items() for c in df.columns],
        "table_name string, column_name string, is_key_candidate boolean")
    return related_tables(spark, seeds, rel, cols)


# ---------------------------------------------------------------- DIS-1 .. DIS-4

def related_tables(spark: SparkSession, seeds: list[str], relationships: DataFrame,
                   columns: DataFrame) -> DataFrame:
    """Tables related to ``seeds``: ``table_name, reason`` in the reference's order
    of phases, each phase skipping tables already chosen.

    ``relationships``: ``child_table, child_column, parent_table, parent_column, is_fk``
    (e.g. from ``discover_foreign_keys``).  ``columns``: ``table_name,
    column_name, is_key_candidate`` (e.g. ``column_profile``; a unique or key
    column of a seed counts like the reference's primary/unique flag).

    1. seed (DIS-0) 2. outbound: parents of seed FKs (DIS-1); 3. bridges whose
    FKs reach >= 2 seeds (DIS-2); 4. bridges sharing an id-like column name
    with >= 2 seeds (DIS-3); 5. inbound: tables with an FK into a seed (DIS-4).
    Phases 3 and 4 need two seeds.  No table is left out (the reference caps at 15 for prompt size).
    """
    # Every phase's candidates depend on the seeds only, never on what an
    # earlier phase chose; "each phase skips tables already chosen" is thus
    # "each table takes the first phase it qualifies for": one union of
    # candidates and one aggregate, instead of a chain of anti joins.
    seed_df = spark.createDataFrame([(s,) for s in seeds], "table_name string")
    fk = relationships.where("is_fk")
    to_seed = fk.join(seed_df.withColumnRenamed("table_name", "parent_table"), "parent_table")
    phases = [
        seed_df.withColumn("phase", F.lit(0)),
        fk.join(seed_df.withColumnRenamed("table_name", "child_table"), "child_table")
        .select(F.col("parent_table").alias("table_name"), F.lit(1).alias("phase")),
    ]
    if len(set(seeds)) >= 2:
        phases.append(to_seed.groupBy(F.col("child_table").alias("table_name"))
                      .agg(F.countDistinct("parent_table").alias("n")).where("n >= 2")
                      .select("table_name", F.lit(2).alias("phase")))
        cols = columns.select("table_name", F.lower("column_name").alias("cname"), "is_key_candidate")
        seed_keys = (cols.join(seed_df, "table_name")
                     .where(F.col("is_key_candidate") | F.col("cname").rlike(ID_LIKE_PATTERN))
                     .select(F.col("table_name").alias("seed"), "cname"))
        phases.append(cols.where(F.col("cname").rlike(ID_LIKE_PATTERN)).join(seed_keys, "cname")
                      .groupBy("table_name").agg(F.countDistinct("seed").alias("n")).where("n >= 2")
                      .select("table_name", F.lit(3).alias("phase")))
    phases.append(to_seed.select(F.col("child_table").alias("table_name"), F.lit(4).alias("phase")))
    cand = phases[0]
    for p in phases[1:]:
        cand = cand.unionByName(p)
    reason = F.element_at(F.array(*[F.lit(r) for r in PHASE_REASONS]), F.col("phase") + 1)
    chosen = cand.groupBy("table_name").agg(F.min("phase").alias("phase")) \
        .select("table_name", reason.alias("reason"))
    return chosen
