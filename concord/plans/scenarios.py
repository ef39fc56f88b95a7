"""Reconciliation scenarios over the driver's test tables.

Each scenario pairs a *source* query over a table with a *target* that Spark
derives from the same table with deterministic faults injected (rows dropped,
rows added, values changed), the way a faulty ETL load would differ from its
input.  Every scenario reads whole tables; nothing is sampled or capped.

The functions named after queries take ``(spark, sf_dir)`` and return a
lazy DataFrame; ``__spark_entry__`` registers them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dq, transforms as xf
from ..operators import alignment, checks, checksum, checktree, diff, keys, lookups, profile, tolerance
from ..operators.result import one_row_join
from ..session import run_folder
from ..sources import drift, files
from . import mapping, report, suite

TPCH_TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


# ---------------------------------------------------------------- sources and derived targets

def orders_source(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("key_col"), F.col("o_orderstatus").alias("val"),
                    xf.to_decimal("o_totalprice", 12, 2).alias("amount"), "o_orderdate")


def orders_target(spark, sf_dir) -> DataFrame:
    """Load of ``orders`` with faults: keys divisible by 97 lost, a copy with key
    ``-(k+1)`` added for keys divisible by 101, status overwritten for keys
    divisible by 89, amount +1 for keys divisible by 53."""
    src = orders_source(spark, sf_dir)
    k = F.col("key_col")
    changed = src.select(
        "key_col",
        F.when(k % 89 == 0, F.lit("X")).otherwise(F.col("val")).alias("val"),
        F.when(k % 53 == 0, F.col("amount") + 1).otherwise(F.col("amount"))
        .cast("decimal(12,2)").alias("amount"),
        "o_orderdate")
    kept = changed.where(k % 97 != 0)
    added = src.where(k % 101 == 0).withColumn("key_col", -(k + 1))
    return kept.unionByName(added)


def customer_source(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("key_col"), "c_name", "c_acctbal", "c_mktsegment")


def customer_target(spark, sf_dir) -> DataFrame:
    """Customer load with a float column (balance) and padded / null-token text."""
    c = customer_source(spark, sf_dir)
    k = F.col("key_col")
    return c.select(
        "key_col",
        F.when(k % 41 == 0, F.concat(F.lit("\t"), F.col("c_name"), F.lit(" ")))
        .when(k % 43 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 47 == 0, F.col("c_acctbal") + F.lit(0.5)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 59 == 0, F.lit("NULL")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


def lineitem_source(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("key_col"), "l_linenumber",
                     xf.to_decimal("l_quantity", 12, 2).alias("qty"))


def lineitem_target(spark, sf_dir) -> DataFrame:
    """Line load keyed by order (keys repeat on both sides): lines of parts
    divisible by 91 lost, quantity +1 where (order + line) divisible by 37,
    lines of orders divisible by 113 loaded twice."""
    li = table(spark, sf_dir, "lineitem")
    base = li.where(F.col("l_partkey") % 91 != 0).select(
        F.col("l_orderkey").alias("key_col"), "l_linenumber",
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 37 == 0, F.col("l_quantity") + 1)
        .otherwise(F.col("l_quantity")).cast("decimal(12,2)").alias("qty"))
    again = base.where(F.col("key_col") % 113 == 0)
    return base.unionByName(again)


def part_source(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size",
                    xf.to_decimal("p_retailprice", 12, 2).alias("p_retailprice"))


def part_target(spark, sf_dir) -> DataFrame:
    p = part_source(spark, sf_dir)
    k = F.col("p_partkey")
    return p.where(k % 67 != 0).withColumn(
        "p_retailprice",
        F.when(k % 61 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
        .cast("decimal(12,2)"))


def extended_price_source(spark, sf_dir) -> DataFrame:
    """Line prices by order (keys repeat), with the numbers that comparisons trip over:
    NULL, NaN, 1e30 and 1e-13 in place of some."""
    p = F.col("l_partkey")
    price = (F.when(p % 83 == 0, F.lit(None).cast("double")).when(p % 89 == 0, F.lit(float("nan"))).when(p % 97 == 0, F.lit(1e30))
             .when(p % 101 == 0, F.lit(1e-13)).otherwise(F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key_col"), "l_linenumber", "l_partkey", "l_returnflag", price.alias("price"))


def extended_price_target(spark, sf_dir) -> DataFrame:
    """The load: prices off by a ten-millionth where (order + line) is divisible by 3, by half a
    cent where divisible by 5, by 7 where divisible by 37, 1e-13 read as 0; lines of
    parts divisible by 91 lost, those of orders divisible by 113 loaded twice."""
    src = extended_price_source(spark, sf_dir)
    k, v = F.col("key_col") + F.col("l_linenumber"), F.col("price")
    base = src.where(F.col("l_partkey") % 91 != 0).withColumn(
        "price", F.when(F.col("l_partkey") % 101 == 0, F.lit(0.0)).when(k % 37 == 0, v + 7).when(k % 5 == 0, v + 0.005).when(k % 3 == 0, v * (1 + 1e-7)).otherwise(v))
    return base.unionByName(base.where(F.col("key_col") % 113 == 0))


def customer_history(spark, sf_dir) -> DataFrame:
    """SCD2 customer dimension derived from ``customer``: two versions per
    customer, the first closed at a per-customer date, the second open and
    current.  ``cust_sk`` = 2*custkey (+1 for the current version)."""
    c = table(spark, sf_dir, "customer")
    cut = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") * 7 % 2400).cast("int"))
    v1 = c.select((F.col("c_custkey") * 2).alias("cust_sk"), F.col("c_custkey").alias("cust_id"),
                  F.lit("1990-01-01").cast("date").alias("valid_from"), cut.alias("valid_to"),
                  F.lit(0).alias("is_current"))
    v2 = c.select((F.col("c_custkey") * 2 + 1).alias("cust_sk"), F.col("c_custkey").alias("cust_id"),
                  cut.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
                  F.lit(1).alias("is_current"))
    return v1.unionByName(v2)


def customer_history_faulty(spark, sf_dir) -> DataFrame:
    """The history with gaps (first version ends 90 days early where the key is divisible by 11)
    and overlaps (200 days late where divisible by 13)."""
    k = F.col("cust_id")
    first = F.col("is_current") == 0
    to = F.when(first & (k % 11 == 0), F.date_sub("valid_to", 90)).when(first & (k % 13 == 0), F.date_add("valid_to", 200)).otherwise(F.col("valid_to"))
    return customer_history(spark, sf_dir).withColumn("valid_to", to)


# ---------------------------------------------------------------- comparison queries

def keyed_diff_orders(spark, sf_dir):
    return diff.keyed_diff(orders_source(spark, sf_dir), orders_target(spark, sf_dir))


def keyed_diff_multi(spark, sf_dir):
    return diff.keyed_diff(customer_source(spark, sf_dir), customer_target(spark, sf_dir))


def keyed_diff_dup_keys(spark, sf_dir):
    d = diff.keyed_diff(lineitem_source(spark, sf_dir), lineitem_target(spark, sf_dir))
    return d.select("key_col", "n_source", "n_target", "matched_pairs", "mismatch_pairs", "mismatch_type")


def keyed_diff_dup_alignment(spark, sf_dir):
    return alignment.aligned_rows(lineitem_source(spark, sf_dir), lineitem_target(spark, sf_dir))


def keyed_diff_tolerance(spark, sf_dir):
    return tolerance.tolerance_diff(extended_price_source(spark, sf_dir), extended_price_target(spark, sf_dir), "price", same=["l_returnflag"],
                                    absolute=0.01, relative=1e-6)


def checksum_tree_diff(spark, sf_dir):
    return checktree.tree_diff(orders_source(spark, sf_dir), orders_target(spark, sf_dir))


def diff_class_counts(spark, sf_dir):
    d = diff.keyed_diff(lineitem_source(spark, sf_dir), lineitem_target(spark, sf_dir))
    return d.groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n_keys"),
                                          F.sum("mismatch_pairs").alias("mismatch_pairs"))


def keyed_diff_check(spark, sf_dir):
    # the counts only: the sample is checked by keyed_diff_sample
    r = diff.keyed_diff_result("value_match_orders", orders_source(spark, sf_dir), orders_target(spark, sf_dir),
                               sample_size=0)
    return r.select("check_name", "check_type", "passed", "source_value", "target_value", "mismatch_count")


def keyed_diff_sample(spark, sf_dir):
    """SNK-2 and CMP-2a of the orders check: the JSON sample (first 100
    mismatching keys in key order, all fields, explicit nulls) and the counts
    per mismatch type and per compared column."""
    r = diff.keyed_diff_result("value_match_orders", orders_source(spark, sf_dir), orders_target(spark, sf_dir))
    return r.select("check_name", "mismatch_sample", "mismatch_breakdown")


def _customers_with_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("val"))


def _customer_dim_load(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_mktsegment") != "MACHINERY").select(F.col("c_custkey").alias("val"))


def set_diff_customers(spark, sf_dir):
    return diff.set_diff(_customers_with_orders(spark, sf_dir), _customer_dim_load(spark, sf_dir))


def set_diff_check(spark, sf_dir):
    # the counts only: the sample is checked by set_diff_sample
    r = diff.set_diff_result("set_customers", _customers_with_orders(spark, sf_dir),
                             _customer_dim_load(spark, sf_dir), sample_each=0)
    return r.select("check_name", "check_type", "passed", "source_value", "target_value", "mismatch_count")


def set_diff_sample(spark, sf_dir):
    """SNK-2 of the set check: the first 50 missing and first 50 extra values as JSON."""
    r = diff.set_diff_result("set_customers", _customers_with_orders(spark, sf_dir),
                             _customer_dim_load(spark, sf_dir))
    return r.select("check_name", "mismatch_sample")


def row_set_diff_parts(spark, sf_dir):
    return diff.row_set_diff(part_source(spark, sf_dir), part_target(spark, sf_dir))


def scalar_row_count(spark, sf_dir):
    r = diff.row_count_result("row_count_orders", orders_source(spark, sf_dir), orders_target(spark, sf_dir))
    return r.select("check_name", "check_type", "passed", "source_value", "target_value", "mismatch_count")


def scalar_sum(spark, sf_dir):
    s = lineitem_source(spark, sf_dir).agg(F.sum("qty").alias("total_qty"))
    t = lineitem_target(spark, sf_dir).agg(F.sum("qty").alias("total_qty"))
    r = diff.scalar_result("sum_qty_lineitem", s, t, check_type="value_match")
    return r.select("check_name", "check_type", "passed", "source_value", "target_value", "mismatch_count")


# ---------------------------------------------------------------- checksums

def checksum_table(spark, sf_dir):
    return checksum.checksum(table(spark, sf_dir, "customer"))


def checksum_match(spark, sf_dir):
    return checksum.checksum_pair(orders_source(spark, sf_dir), orders_target(spark, sf_dir))


def checksum_gate_check(spark, sf_dir):
    """CHK-4: checksums first, the comparison only when they differ.  The
    customers reloaded in another order agree (``Checksum Match``, no
    comparison runs); the faulty orders load does not, so it is compared."""
    cust = customer_source(spark, sf_dir)
    k = F.col("key_col")
    reloaded = cust.where(k % 2 == 1).unionByName(cust.where(k % 2 == 0))  # same rows, other order
    out = [suite.compare_result(spark, "customers_reloaded", "value_match", cust, reloaded, use_checksum=True,
                                sample_size=0),
           suite.compare_result(spark, "orders_loaded", "value_match", orders_source(spark, sf_dir),
                                orders_target(spark, sf_dir), use_checksum=True, sample_size=0)]
    return out[0].unionByName(out[1]).select("check_name", "check_type", "passed", "source_value",
                                             "target_value", "mismatch_count")


def checksum_gate_swapped(spark, sf_dir):
    """CHK-4 goes by column name: the same texts under swapped names are compared
    (and differ), other column order alone agrees, NULL is no text."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key_col"), F.coalesce("o_orderstatus", F.lit("")).alias("a"),
        F.coalesce("o_orderpriority", F.lit("")).alias("b"))
    gone = F.col("key_col") % 5 == 0
    with_null = o.withColumn("a", F.when(~gone, F.col("a")))
    with_mark = o.withColumn("a", F.when(~gone, F.col("a")).otherwise(F.lit("\\N")))
    sides = {"columns_swapped": (o, o.select("key_col", F.col("a").alias("b"), F.col("b").alias("a"))),
             "columns_reordered": (o, o.select("b", "a", "key_col")), "null_or_text": (with_null, with_mark)}
    return _stacked([suite.compare_result(spark, n, "value_match", s, t, use_checksum=True, samples=False)
                     for n, (s, t) in sides.items()]).select("check_name", "passed", "source_value", "mismatch_count")


def _stacked(frames) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scalar_shape_check(spark, sf_dir):
    """CMP-1 on sides that are not one row and one column: errors, never a PASS."""
    n = table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders")
    ids, count = n.select("n_nationkey"), o.agg(F.count(F.lit(1)).alias("n"))
    null = o.agg(F.max(F.when(F.lit(False), F.col("o_orderkey"))).alias("n"))
    sides = {"many_rows": (ids, ids), "no_row_and_null": (ids.where("n_nationkey < 0"), null),
             "two_columns": (n.select("n_nationkey", "n_name"), count), "both_null": (null, null), "equal": (count, count),
             "unequal": (count, count.select((F.col("n") + 1).alias("n")))}
    return _stacked([diff.scalar_result(k, s, t, "scalar") for k, (s, t) in sides.items()]).select(
        "check_name", "passed", "mismatch_count", "error_message")


def target_rows_check(spark, sf_dir):
    """TGT-1 / TGT-2 through the suite: one column of violating rows is rows, also
    when it is a single row with id 0; a global aggregate is a count; an
    explicit kind decides alone."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_to_check")
    bad = "FROM orders_to_check WHERE o_totalprice < 2000"
    low = "(SELECT min(o_orderkey) FROM orders_to_check)"
    cases = [("one_row_with_id_0", f"SELECT o_orderkey - {low} AS id FROM orders_to_check WHERE o_orderkey = {low}", None),
             ("many_rows", f"SELECT o_orderkey AS id {bad}", None), ("no_row", "SELECT o_orderkey AS id FROM orders_to_check WHERE o_orderkey IS NULL", None),
             ("a_count", f"SELECT count(*) AS cnt {bad}", None), ("a_count_named_rows", f"SELECT count(*) AS cnt {bad}", "rows")]
    out = suite.suite_results(spark, [{"id": i, "name": n, "type": "dq_check", "target_sql": q, "target_kind": k}
                                      for i, (n, q, k) in enumerate(cases)])
    return out.select("check_name", "passed", "target_value", "mismatch_count", "mismatch_sample")


def keyed_diff_repeated_missing(spark, sf_dir):
    """CMP-2b: the rows of orders lost as a whole (divisible by 29) and of orders
    added (negated keys of those divisible by 31), whose keys repeat."""
    s = lineitem_source(spark, sf_dir)
    k = F.col("key_col")
    t = s.where(k % 29 != 0).unionByName(s.where(k % 31 == 0).withColumn("key_col", -k))
    return diff.one_sided_rows(s, t)


# ---------------------------------------------------------------- target-only checks

def _count_result(name, counted, check_type):
    r = checks.count_check_result(name, counted, check_type)
    return r.select("check_name", "check_type", "passed", "target_value", "mismatch_count")


def null_check(spark, sf_dir):
    return _count_result("null_order_date", checks.null_check(orders_fact(spark, sf_dir), "order_date"), "null_check")


def duplicate_check(spark, sf_dir):
    return checks.duplicate_groups(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def fk_check(spark, sf_dir):
    counted = checks.fk_violation_count(table(spark, sf_dir, "labels"), "doc_id",
                                        table(spark, sf_dir, "documents").where(F.col("doc_id") % 11 != 0), "doc_id")
    return _count_result("fk_labels_doc_id", counted, "dq_check")


def fk_orphans(spark, sf_dir):
    """Orphans of a derived fact: orders' customers against the dimension load
    without MACHINERY customers."""
    return checks.orphan_values(table(spark, sf_dir, "orders"), "o_custkey",
                                table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "MACHINERY"),
                                "c_custkey")


def _rule_check(spark, sf_dir, tbl, column, rule, name):
    pred = dq.rule_predicate(rule)(column)
    return _count_result(name, checks.dq_check(table(spark, sf_dir, tbl), pred), "dq_check")


def dq_positive(spark, sf_dir):
    pred = dq.rule_predicate(">0")("l_quantity")
    return _count_result("dq_l_quantity_positive", checks.dq_check(lineitem_load(spark, sf_dir), pred), "dq_check")


def dq_range(spark, sf_dir):
    return _rule_check(spark, sf_dir, "lineitem", "l_extendedprice", "0-104000 range", "dq_l_extendedprice_range")


def dq_enum(spark, sf_dir):
    return _rule_check(spark, sf_dir, "orders", "o_orderstatus", "values F, O", "dq_o_orderstatus_enum")


def dq_len(spark, sf_dir):
    return _rule_check(spark, sf_dir, "part", "p_name", "LEN≤10", "dq_p_name_len")


def dq_yyyymm(spark, sf_dir):
    pred = dq.rule_predicate("YYYYMM")("period_key")
    return _count_result("dq_period_key_yyyymm", checks.dq_check(orders_fact(spark, sf_dir), pred), "dq_check")


# ---------------------------------------------------------------- transforms

def xf_md5_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", xf.surrogate_md5("o_orderkey", "o_custkey").alias("order_sk"))


def xf_period_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", xf.period_key("o_orderdate").alias("period_key"))


def xf_net_amount(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    gross = xf.to_decimal("l_extendedprice", 12, 2)
    disc = xf.to_decimal("l_discount", 4, 2)
    return li.select("l_orderkey", "l_linenumber", gross.alias("gross_amt"),
                     xf.to_decimal(gross * (1 - disc), 12, 2).alias("net_amt"))


def xf_case_code(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    # Segment codes of this scenario.
    codes = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}
    return c.select("c_custkey", xf.code_map("c_mktsegment", codes).alias("segment_code"))


def xf_substr(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", xf.substr("p_name", 1, 5).alias("short_name"))


def xf_lpad_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", xf.prefix_pad("c_custkey", "C", 9).alias("customer_code"))


def xf_date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    return o.select("o_orderkey", xf.parse_date(text, "yyyy-MM-dd").alias("order_date"))


def xf_cast(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", xf.cast_to("o_totalprice", "decimal(10,0)").alias("price_whole"),
                    xf.cast_to(F.substring("o_orderpriority", 1, 1), "int").alias("priority_rank"))


def xf_scd2_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = lookups.scd2_lookup(o, customer_history(spark, sf_dir), "o_custkey", "cust_id", "o_orderdate",
                              "cust_sk")
    return out.select("o_orderkey", "cust_sk")


def xf_scd2_asof(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = lookups.scd2_asof(o, customer_history_faulty(spark, sf_dir), "o_custkey", "cust_id", "o_orderdate", "cust_sk")
    return out.select("o_orderkey", "cust_sk")


def scd2_faults(spark, sf_dir):
    return lookups.scd2_faults(customer_history_faulty(spark, sf_dir), "cust_id")


def xf_scd2_current(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = lookups.scd2_lookup(o, customer_history(spark, sf_dir), "o_custkey", "cust_id", "o_orderdate",
                              "cust_sk", mode="current")
    return out.select("o_orderkey", "cust_sk")


def xf_dim_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    out = lookups.dim_lookup(c, n, "c_nationkey", "n_nationkey", {"n_name": "nation_name"})
    return out.select("c_custkey", "nation_name")


def xf_bridge_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    out = lookups.bridge_join(p, li, s, "p_partkey", "l_partkey", "l_suppkey", "s_suppkey")
    return out.select("l_orderkey", "l_linenumber", "p_brand", "s_name")


# ---------------------------------------------------------------- profiling / discovery

def profile_columns(spark, sf_dir):
    return profile.column_profile(tables(spark, sf_dir, TPCH_TABLES))


def fk_discovery(spark, sf_dir):
    return profile.discover_foreign_keys(tables(spark, sf_dir, TPCH_TABLES))


def bridge_discovery(spark, sf_dir):
    return profile.discover_related(tables(spark, sf_dir, TPCH_TABLES), ["orders", "part"])


def named_warehouse(spark, sf_dir) -> dict[str, DataFrame]:
    """A warehouse whose tables share plain column names, derived from the given tables:
    every way in which a table can be related to ``sales`` and ``party``, and two
    tables (``item``, ``maker``) that are not."""
    t = tables(spark, sf_dir, ["customer", "orders", "lineitem", "nation", "part", "supplier"])
    o = t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"), "o_orderstatus",
                           F.col("o_orderpriority").alias("priority_code"), F.year("o_orderdate").alias("visit_year"))
    return {
        "sales": o.select("order_id", "cust_id", "priority_code"),
        "party": t["customer"].select(F.col("c_custkey").alias("cust_id"), F.col("c_name").alias("party_name"), F.col("c_nationkey").alias("nation_id")),
        "country": t["nation"].select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("country_name")),
        "invoice": o.where("o_orderstatus = 'F'").select("order_id", "cust_id"),
        "visits": o.groupBy("cust_id", "visit_year").agg(F.count(F.lit(1)).alias("visits")),
        "line": t["lineitem"].select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"), "l_quantity"),
        "item": t["part"].select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("item_type")),
        "maker": t["supplier"].select(F.col("s_suppkey").alias("supp_id"), F.col("s_nationkey").alias("nation_id")),
    }


def related_by_name(spark, sf_dir):
    """DIS-1 .. DIS-4 with a row of every phase, found on the data."""
    return profile.discover_related(named_warehouse(spark, sf_dir), ["sales", "party"])


def _by_month(spark, sf_dir) -> dict[str, DataFrame]:
    t = tables(spark, sf_dir, ["orders", "lineitem"])
    return {"orders": t["orders"].withColumn("batch", F.date_format("o_orderdate", "yyyyMM")),
            "lineitem": t["lineitem"].withColumn("batch", F.date_format("l_shipdate", "yyyyMM"))}


def sketched_profile(spark, sf_dir):
    """Monthly batches of orders and lineitem leave sketches; the profile merges them and counts
    only possible keys on the data."""
    loads = _by_month(spark, sf_dir)
    path = run_folder(spark, "sketches")
    for name, df in loads.items():
        profile.batch_sketches(name, df, "batch").write.mode("append").parquet(path)
    got = profile.key_profile({t: df.drop("batch") for t, df in loads.items()}, spark.read.parquet(path))
    return got.drop("approx_distinct")


def footer_statistics(spark, sf_dir):
    return _stacked([profile.footer_statistics(spark, f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("table_name"), "column_name", "n_rows", "n_values",
                     F.col("min_value").cast("double").alias("min_value"), F.col("max_value").cast("double").alias("max_value")) for t in TPCH_TABLES])


def composite_keys(spark, sf_dir):
    return keys.composite_keys(spark, tables(spark, sf_dir, TPCH_TABLES))


def renamed_references(spark, sf_dir) -> dict[str, DataFrame]:
    """Tables whose references have other names than the keys: the returned parcels of
    ``lineitem`` point at a supplier, and by two columns at an order's lines."""
    t = tables(spark, sf_dir, ["customer", "nation", "supplier", "lineitem"])
    li = t["lineitem"]
    return {
        "customer": t["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
        "nation": t["nation"], "supplier": t["supplier"].select("s_suppkey", "s_name", "s_nationkey"),
        "order_line": li.select(F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line_no")).distinct(),
        "parcel": li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ref_a"), F.col("l_linenumber").alias("ref_b"),
                                                        F.col("l_suppkey").alias("maker")),
    }


def inclusion_pairs(spark, sf_dir):
    return keys.inclusion_dependencies(spark, renamed_references(spark, sf_dir))


def schema_columns(spark, sf_dir):
    return profile.schema_inventory(tables(spark, sf_dir, TPCH_TABLES))


# ---------------------------------------------------------------- fused suite and run reports

def lineitem_load(spark, sf_dir) -> DataFrame:
    """A load of ``lineitem`` whose faults grow over the year: each later month
    breaks more of the rules below.  ``batch``: the month of the shipment."""
    li = table(spark, sf_dir, "lineitem").withColumn("batch", xf.period_key("l_shipdate"))
    m, k = F.col("batch") % 100, F.col("l_orderkey") % 7
    faults = {"l_quantity": (3, -F.col("l_quantity")), "l_discount": (5, F.col("l_discount") + 1.5), "l_tax": (6, F.col("l_tax") + 0.1),
              "l_returnflag": (8, F.lit("X")), "l_linestatus": (9, F.lit("Q")), "l_shipdate": (10, F.lit(None)),
              "l_extendedprice": (11, F.col("l_extendedprice") + 200000)}
    return li.withColumns({c: F.when((m >= month) & (k == i), wrong).otherwise(F.col(c)) for i, (c, (month, wrong)) in enumerate(faults.items())})


def lineitem_rules():
    """Rules of the lineitem load, as rule text per column (mapping-document style)."""
    return [("l_quantity", ">0"), ("l_discount", "0-1 range"), ("l_tax", "0-0.08 range"),
            ("l_returnflag", "values A, N, R"), ("l_linestatus", "values O, F"),
            ("l_shipdate", "NOT NULL"), ("l_extendedprice", "0-104000 range")]


def _rule_predicates():
    return {f"{c}: {r}": dq.rule_predicate(r)(c) for c, r in lineitem_rules()}


def fused_suite(spark, sf_dir):
    return checks.violation_counts(lineitem_load(spark, sf_dir), _rule_predicates())


def batch_results(spark, sf_dir):
    """Every rule checked per monthly load batch of lineitem (run id = yyyymm)."""
    return suite.batch_check_results(lineitem_load(spark, sf_dir).withColumnRenamed("batch", "run_id"), "run_id", _rule_predicates())


def run_summary(spark, sf_dir):
    return report.run_counters(batch_results(spark, sf_dir))


def run_page(spark, sf_dir):
    return report.run_page(report.run_counters(batch_results(spark, sf_dir)), offset=0, limit=20)


def pass_rate(spark, sf_dir):
    return report.pass_rate(report.run_counters(batch_results(spark, sf_dir)))


def dashboard(spark, sf_dir):
    return report.dashboard(report.run_counters(batch_results(spark, sf_dir)), latest=10)


def report_csv(spark, sf_dir):
    """SNK-3 written and read back: the run of all batch checks as its header lines and
    its result lines; names and errors hold quotes, commas and line breaks."""
    checked = batch_results(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in _rule_predicates()])
    failed = ~F.col("passed")
    results = checked.select(
        (F.col("run_id") * 10 + F.array_position(names, F.col("check_name"))).alias("test_case_id"),
        F.concat(F.col("run_id").cast("string"), F.lit(': "'), "check_name", F.lit('"')).alias("test_case_name"),
        F.lit("dq_check").alias("test_case_type"), "passed", F.col("rows").cast("string").alias("source_value"),
        F.when(failed, F.col("mismatch_count").cast("string")).alias("target_value"), "mismatch_count",
        F.when(failed, F.concat(F.lit('broken, "'), "check_name", F.lit('"\nin '), F.col("run_id").cast("string"))).alias("error_message"))
    run = one_row_join(report.run_counters(results.withColumn("run_id", F.lit(1))).withColumnRenamed("run_id", "id"),
                       checked.agg(F.max("run_id").alias("started_at"))).withColumn("mapping_name", F.lit(None).cast("string"))
    path = run_folder(spark, "report")
    report.write_report_csv(run, results, path)
    header, lines = report.read_report_csv(spark, path)
    columns = ["case_id", "case_name", "case_type", "status", "source_value", "target_value", "mismatches", "error"]
    head = header.select(F.lit("header").alias("section"), F.col("label").alias("case_id"), F.col("value").alias("case_name"),
                         *[F.lit(None).cast("string").alias(c) for c in columns[2:]])
    return head.unionByName(lines.select(F.lit("results").alias("section"), *[F.col(a).alias(b) for a, b in zip(lines.columns, columns)]))


def parse_summary(spark, sf_dir):
    """RUN-6 and RUN-7: the active test cases of a metadata table and their field mappings,
    a case per order and a mapping per line."""
    k = F.col("o_orderkey")
    cases = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "invalid").alias("validation_status"),
        (k % 10 != 0).alias("is_active"))
    return report.parse_summary(table(spark, sf_dir, "lineitem"), report.active_only(cases))


def connector_usage(spark, sf_dir):
    """RUN-8 and RUN-7: the active documents of a metadata table, one per order, that use
    connector 7, and how."""
    documents = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 25).alias("source_connector_id"),
        (F.col("o_orderkey") % 25).alias("target_connector_id"), (F.col("o_orderstatus") != "P").alias("is_active"))
    return report.connector_usage(documents, 7)


# ---------------------------------------------------------------- mapping document -> suite

# The field mapping of the orders load, as mapping-document rows
# (MapID, Src Table, Src Field, Rule/Transform, Tgt Table, Tgt Field, Tgt Type, Key, DQ Rule).
ORDERS_LOAD_MAPPING = [
    ("M01", "src_orders", "o_orderkey", "MD5(o_orderkey+o_custkey)", "fact_orders", "order_sk", "char(32)", "Y",
     "NOT NULL"),
    ("M02", "src_orders", "o_custkey", "DIRECT", "fact_orders", "cust_id", "bigint", "N",
     "must exist in dim_customer"),
    ("M03", "src_orders", "o_orderdate", "YEAR()*100+MONTH()", "fact_orders", "period_key", "int", "N", "YYYYMM"),
    ("M04", "src_orders", "o_totalprice", "DIRECT", "fact_orders", "total_amt", "decimal(12,2)", "N", ">0"),
    ("M05", "src_orders", "o_orderstatus", "CASE 'F'→1, 'O'→2, 'P'→3", "fact_orders", "status_code", "int", "N",
     "ENUM 1-3"),
    ("M06", "src_orders", "o_orderpriority", "SUBSTR(o_orderpriority,1,8)", "fact_orders", "priority",
     "varchar(8)", "N", "LEN≤8"),
    ("M07", "src_orders", "o_orderdate", "CAST(o_orderdate AS DATE)", "fact_orders", "order_date", "date", "nan",
     "NOT NULL"),
]


def orders_fact(spark, sf_dir) -> DataFrame:
    """The warehouse load of ``orders`` the mapping describes, with faults: orders
    divisible by 97 lost, by 101 loaded twice; customer moved out of the
    dimension (71), month 13 (83), amount +1 (53), status code 4 (89), order
    date lost (79)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    amount = xf.to_decimal("o_totalprice", 12, 2)
    status = xf.code_map("o_orderstatus", {"F": 1, "O": 2, "P": 3})
    base = o.where(k % 97 != 0).select(
        xf.surrogate_md5("o_orderkey", "o_custkey").alias("order_sk"),
        F.when(k % 71 == 0, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey")).alias("cust_id"),
        F.when(k % 83 == 0, F.year("o_orderdate") * 100 + 13).otherwise(xf.period_key("o_orderdate"))
        .alias("period_key"),
        F.when(k % 53 == 0, amount + 1).otherwise(amount).cast("decimal(12,2)").alias("total_amt"),
        F.when(k % 89 == 0, F.lit(4)).otherwise(status).cast("int").alias("status_code"),
        xf.substr("o_orderpriority", 1, 8).alias("priority"),
        F.when(k % 79 == 0, F.lit(None).cast("date")).otherwise(F.col("o_orderdate").cast("date"))
        .alias("order_date"),
        k.alias("__k"))
    return base.unionByName(base.where(F.col("__k") % 101 == 0)).drop("__k")


def _mapping_cases(spark, sf_dir) -> list[dict]:
    """Register the load's views and turn the mapping rows into test cases."""
    views = {"src_orders": table(spark, sf_dir, "orders"), "fact_orders": orders_fact(spark, sf_dir),
             "dim_customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust_id"),
                                                                     F.col("c_name").alias("cust_name"))}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    cols = ["map_id", "source_table", "source_column", "transformation", "target_table", "target_column",
            "target_type", "is_key", "dq_rule"]
    raw = spark.createDataFrame(ORDERS_LOAD_MAPPING, ", ".join(f"{c} string" for c in cols))
    raw = mapping.clean_rows(raw.select(F.lit("orders_load").alias("document"), *cols,
                                        *[F.lit("").alias(c) for c in ("source_type", "test_notes")]))
    fields = [r.asDict() for r in mapping.field_mappings(raw).orderBy("map_id").collect()]  # one row per field
    return mapping.to_checks(fields, views)


def mapping_suite(spark, sf_dir):
    """A mapping document run end to end (MAP-3..5, CHKTYPE-1..7, suite runner):
    the rows are cleaned and defaulted by Spark, turned into test cases, and
    every case runs on the whole tables - all cases as one Spark job."""
    # counts only (no sample is output, so none is planned)
    out = suite.suite_results(spark, _mapping_cases(spark, sf_dir), samples=False)
    return out.select("check_name", "check_type", "passed", "source_value", "target_value", "mismatch_count")


def run_report(spark, sf_dir):
    """The run report's result table (SNK-3) of the mapping suite: results
    joined to their test cases (RUN-3), PASS/FAIL per line."""
    cases = _mapping_cases(spark, sf_dir)
    detail = report.run_detail(suite.suite_results(spark, cases, samples=False), mapping.checks_frame(spark, cases))
    return report.report_table(detail)


# ---------------------------------------------------------------- file sources

def file_sources(spark, sf_dir):
    """SRC-1..6 and SRC-10 over whole data: ``orders`` written by Spark as CSV,
    TSV, JSON lines and parquet into one new folder under the shared one, the
    folder registered as one view per file (delimiter sniffed, JSON lines
    detected, schemas given), and one aggregate with a bound parameter run
    on every view."""
    base = run_folder(spark, "sources")
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", xf.to_decimal("o_totalprice", 12, 2).alias("o_totalprice"),
        "o_orderpriority")
    o.write.option("header", True).csv(f"{base}/orders.csv")
    o.write.option("header", True).option("sep", "\t").csv(f"{base}/orders.tsv")
    o.write.json(f"{base}/orders.json")
    o.write.parquet(f"{base}/orders.parquet")
    out = None
    for name in files.register_path(spark, base, {f"orders.{x}": o.schema for x in ("csv", "tsv", "json")}):
        q = (f"SELECT '{name}' AS source_file, o_orderstatus, count(*) AS n_orders, "
             f"CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total_price "
             f"FROM {files.view_name(name)} WHERE o_custkey > :lo GROUP BY o_orderstatus")
        df = files.run_sql(spark, q, {"lo": 0})
        out = df if out is None else out.unionByName(df)
    return out


def source_catalog(spark, sf_dir):
    """SRC-11 .. SRC-13 over registered tables: each listed table of this query with its row
    count by a scalar statement, and how many of its sampled rows, all text, are rows of it."""
    prefix = "catalogued_"
    for t in TPCH_TABLES:
        table(spark, sf_dir, t).createOrReplaceTempView(prefix + t)
    listed = files.list_tables(spark).where(F.col("name").startswith(prefix)).collect()  # one row a table
    out = []
    for r in listed:
        df = spark.table(r["name"])
        n = files.scalar(files.run_sql(spark, f"SELECT count(*) FROM {r['name']}"))
        as_text = df.select(*[F.col(c).cast("string") for c in df.columns])
        sample = files.sample_rows(df, 5)
        seen = spark.createDataFrame([tuple(x[c] for c in df.columns) for x in sample], ", ".join(f"{c} string" for c in df.columns))
        found = seen.intersect(as_text).agg(F.count(F.lit(1)).alias("sampled_found"))  # distinct rows, NULL equal to NULL
        out.append(found.select(F.lit(r["name"][len(prefix):]).alias("table_name"), F.lit(r["is_temporary"]).alias("is_temporary"),
                                F.lit(n).cast("bigint").alias("n_rows"), F.lit(len(sample)).alias("sampled"),
                                (F.col("sampled_found") == F.lit(len({tuple(x.items()) for x in sample}))).alias("sample_is_of_table")))
    return _stacked(out)


def file_sources_single(spark, sf_dir):
    """SRC-6 and SRC-4 with an array of objects: the single file ``orders`` gives its own
    view and ``data``; a folder holds ``nation`` as one JSON array (25 rows)."""
    base = run_folder(spark, "array")
    n = table(spark, sf_dir, "nation")
    n.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(f"{base}/nations.json")
    by_view = {v: "o_orderstatus" for v in files.register_path(spark, f"{sf_dir}/orders.parquet")}
    by_view |= {v: "CAST(n_regionkey AS STRING)" for v in files.register_path(spark, base)}
    return _stacked([files.run_sql(spark, f"SELECT '{v}' AS source_file, {group} AS grp, count(*) AS n "
                                          f"FROM {files.view_name(v)} GROUP BY ALL") for v, group in by_view.items()])


def _drifting_orders(spark, sf_dir, base) -> None:
    """``orders`` by status as three kinds of CSV: whole prices; prices and a status, "n/a" for some;
    dates with semicolons, "soon" for some."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    parts = {
        "F": (",", o.select("o_orderstatus", "o_orderkey", "o_custkey", F.round("o_totalprice").cast("bigint").alias("o_totalprice"))),
        "O": (",", o.select("o_orderstatus", "o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(price).alias("o_totalprice"),
                            F.col("o_orderstatus").alias("status"))),
        "P": (";", o.select("o_orderstatus", "o_orderkey", F.when(F.col("o_orderkey") % 89 == 0, "soon").otherwise(F.col("o_orderdate").cast("date").cast("string"))
                            .alias("o_orderdate"), price.alias("o_totalprice"))),
    }
    for status, (sep, df) in parts.items():
        df.where(F.col("o_orderstatus") == status).drop("o_orderstatus").write.options(header=True, sep=sep).csv(f"{base}/{status}")


def typed_folder(spark, sf_dir):
    base = run_folder(spark, "drift")
    _drifting_orders(spark, sf_dir, base)
    got = drift.read_folder(spark, base)
    part = F.element_at(F.split("source_file", "/"), -2).alias("part")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "status", "o_orderdate"]
    rejected = [F.get_json_object("record", "$.o_orderkey").cast("bigint").alias("o_orderkey")]
    rejected += [F.lit(None).cast(got.types[c]).alias(c) for c in columns[1:]]
    return got.rows.select(part, *columns, F.lit(None).cast("string").alias("reason")).unionByName(got.rejects.select(part, *rejected, "reason"))


def idempotent_append(spark, sf_dir):
    """The batch results as one run stored twice, its failures as another, and a third run that breaks
    before its commit: read back, each committed run is there once."""
    path = run_folder(spark, "runs")
    results = batch_results(spark, sf_dir)
    report.write_run(results, path, "all batches")
    report.write_run(results, path, "all batches")
    report.write_run(results.where("NOT passed"), path, "failed/only")
    report.write_run(results, path, "broken", commit=False)
    return report.read_runs(spark, path)


# ---------------------------------------------------------------- mapping documents

# Header cells of the documents below.
_HEADER = ["MapID", "Src Table", "Src Field", "Rule/Transform", "Tgt Table", "Tgt Field", "Key", "DQ Rule"]
DOCUMENT_LINES = 100_000  # of one document at most


def _mapping_lines(spark, sf_dir, name, note="") -> DataFrame:
    """One line of a mapping document per row of a table, its cells from the row's key."""
    t = table(spark, sf_dir, name)
    key, other = t.columns[:2]
    k = F.col(key)
    cells = [F.concat(F.lit(f"{name}:"), k.cast("string")), F.lit(name), F.col(other).cast("string"),
             F.when(k % 2 == 1, F.lit("DIRECT" + note)).otherwise(F.lit("nan")), F.lit(f"dim_{name}"), F.lit(key),
             F.when(k % 7 == 0, "Y").otherwise("N"), F.when(k % 3 == 0, "NOT NULL").when(k % 3 == 1, ">0, <1000000")]
    return t.select(*[c.alias(h) for c, h in zip(cells, _HEADER)])


def mapping_docs_mixed(spark, sf_dir):
    """MAP-1 / MAP-2 over folders of documents that differ in delimiter, header, width and
    quoting, a line per row of the given tables, written by the executors: what each
    folder gives, the documents without a known header as an error."""
    base = run_folder(spark, "documents")

    def write(name, lines, sep, **options):
        lines.write.options(header=True, sep=sep, escape='"', emptyValue="", maxRecordsPerFile=DOCUMENT_LINES, **options).csv(f"{base}/{name}")
    write("customer.csv", _mapping_lines(spark, sf_dir, "customer"), ",", quoteAll=True)
    write("orders.tsv", _mapping_lines(spark, sf_dir, "orders"), "\t")
    write("lineitem.csv", _mapping_lines(spark, sf_dir, "lineitem").drop("Key"), ";")  # a column less
    write("part.csv", _mapping_lines(spark, sf_dir, "part", "\nnote"), ",")  # a line break in a cell
    edge = F.lit(None).cast("string")  # the outer pipes: a cell without text at either end
    write("supplier.txt", _mapping_lines(spark, sf_dir, "supplier").select(edge.alias(" "), "*", edge.alias("  ")), "|")
    write("region.csv", table(spark, sf_dir, "region"), ",")  # no mapping document
    found = mapping.read_text_documents(spark, base)
    return found.groupBy(F.element_at(F.split("document", "/"), -2).alias("document")).agg(
        F.count("map_id").alias("fields"), F.count_if(F.col("is_key")).alias("keys"), F.count("dq_rule").alias("rules"),
        F.count_if(F.col("error").isNull() & (F.col("transformation") == "DIRECT")).alias("direct"),
        F.count_if(F.col("transformation").contains("\nnote")).alias("with_line_break"), F.max("error").alias("error"))


def mapping_rule_checks(spark, sf_dir):
    """MAP-5 on rule cells of every kind, run on the faulty orders load: combined rules, lists,
    unique, parents under another key name; what is not understood is listed as manual."""
    views = {"src_orders": table(spark, sf_dir, "orders"), "fact_orders": orders_fact(spark, sf_dir),
             "dim_party": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party_key"), "c_name")}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    # Fixed values: (target column, DQ rule) of this scenario.
    rules = [("order_sk", "NOT NULL, unique"), ("cust_id", "must exist in dim_party"), ("total_amt", ">1000 and <200000"),
             ("status_code", "IN (1, 2, 3); NOT NULL"), ("period_key", "email format"), ("priority", "ENUM A-C"), ("order_date", "FK EXISTS")]
    rows = [{"map_id": f"R{i}", "source_table": "src_orders", "source_column": "o_orderkey", "transformation": "DIRECT", "target_table": "fact_orders",
             "target_column": c, "target_type": None, "is_key": False, "dq_rule": r} for i, (c, r) in enumerate(rules)]
    cases = [c for c in mapping.to_checks(rows, views, keys={"dim_party": "party_key"}) if c["type"] not in ("value_match", "row_count")]
    told = mapping.checks_frame(spark, cases).select(F.col("id").alias("test_case_id"), F.col("name").alias("check_name"), "validation_status", "is_active")
    ran = suite.suite_results(spark, cases, samples=False).select("test_case_id", "passed", "mismatch_count")
    return told.join(ran, "test_case_id", "left").drop("test_case_id")
