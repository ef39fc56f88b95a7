"""Independent DuckDB SQL for the scenarios (the correctness oracle).

Each text computes, with plain SQL over the driver's views, what the Spark
query of the same name in ``concord.plans.scenarios`` returns.  Where the
Spark plan is clever the SQL is brute force: the duplicate-key diff joins all
m x n row pairs and counts them, the keyed diff is a plain full outer join.
"""

from __future__ import annotations

import itertools

# Texts read as "no value".
NULL_TOKENS_SQL = "('nan', 'NaN', 'None', 'null', 'NULL')"


# ---------------------------------------------------------------- canonical text, DuckDB side

def _ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"(CASE WHEN {x} IN {NULL_TOKENS_SQL} THEN '' ELSE {x} END)"


def _strip_zeros(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def text_int(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def text_dec(x: str) -> str:
    return _strip_zeros(f"CAST({x} AS VARCHAR)")


def text_float(x: str) -> str:
    d = f"TRY_CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,12))"
    return (f"(CASE WHEN {d} IS NOT NULL AND CAST({d} AS DOUBLE) = {x} "
            f"THEN {_strip_zeros(f'CAST({d} AS VARCHAR)')} ELSE CAST({x} AS VARCHAR) END)")


def text_ts(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def canon_str(x: str) -> str:
    return _tokens(_ws(f"coalesce({x}, '')"))


def canon_other(text: str) -> str:
    return _tokens(f"regexp_replace({_ws(f'coalesce({text}, {chr(39)}{chr(39)})')}, '\\.0$', '')")


def canon_int(x):
    return canon_other(text_int(x))


def canon_dec(x):
    return canon_other(text_dec(x))


def canon_float(x):
    return canon_other(text_float(x))


def canon_ts(x):
    return canon_other(text_ts(x))


# ---------------------------------------------------------------- derived targets

ORDERS_SOURCE = """
  SELECT o_orderkey AS key_col, o_orderstatus AS val, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         o_orderdate
  FROM orders"""

ORDERS_TARGET = """
  SELECT o_orderkey AS key_col,
         CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS val,
         CAST(CASE WHEN o_orderkey % 53 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) + 1
                   ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS amount,
         o_orderdate
  FROM orders WHERE o_orderkey % 97 <> 0
  UNION ALL
  SELECT -(o_orderkey + 1), o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)), o_orderdate
  FROM orders WHERE o_orderkey % 101 = 0"""

CUSTOMER_TARGET = """
  SELECT c_custkey AS key_col,
         CASE WHEN c_custkey % 41 = 0 THEN chr(9) || c_name || ' '
              WHEN c_custkey % 43 = 0 THEN upper(c_name) ELSE c_name END AS c_name,
         CASE WHEN c_custkey % 47 = 0 THEN c_acctbal + 0.5 ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 59 = 0 THEN 'NULL' ELSE c_mktsegment END AS c_mktsegment
  FROM customer"""

LINEITEM_TARGET_BASE = """
  SELECT l_orderkey AS key_col, l_linenumber,
         CAST(CASE WHEN (l_orderkey + l_linenumber) % 37 = 0 THEN l_quantity + 1 ELSE l_quantity END
              AS DECIMAL(12,2)) AS qty
  FROM lineitem WHERE l_partkey % 91 <> 0"""

PART_SOURCE = """
  SELECT p_partkey, p_name, p_brand, p_type, p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS p_retailprice
  FROM part"""

PART_TARGET = """
  SELECT p_partkey, p_name, p_brand, p_type, p_size,
         CAST(CASE WHEN p_partkey % 61 = 0 THEN CAST(p_retailprice AS DECIMAL(12,2)) + 1
                   ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS p_retailprice
  FROM part WHERE p_partkey % 67 <> 0"""

CUSTOMER_HISTORY = """
  SELECT c_custkey * 2 AS cust_sk, c_custkey AS cust_id, DATE '1990-01-01' AS valid_from,
         DATE '1995-01-01' + CAST(c_custkey * 7 % 2400 AS INTEGER) AS valid_to, 0 AS is_current
  FROM customer
  UNION ALL
  SELECT c_custkey * 2 + 1, c_custkey, DATE '1995-01-01' + CAST(c_custkey * 7 % 2400 AS INTEGER),
         CAST(NULL AS DATE), 1
  FROM customer"""


def _unique_key_diff(src: str, tgt: str, cols: dict[str, str]) -> str:
    """Keyed diff of two sides with unique keys: full outer join on the canonical key.

    ``cols``: compared column -> canonical-text function name in this module.
    """
    canon = globals()
    s_sel = ", ".join([f"{canon_int('key_col')} AS key_col"] +
                      [f"{canon[f](c)} AS {c}" for c, f in cols.items()])
    vals = []
    for c in cols:
        vals += [f"s.{c} AS {c}_source", f"t.{c} AS {c}_target"]
    diff_any = " OR ".join(f"{c}_source <> {c}_target" for c in cols)
    changed = ", ".join(f"CASE WHEN {c}_source <> {c}_target THEN '{c}' END" for c in cols)
    out_vals = ", ".join(f"{c}_source, {c}_target" for c in cols)
    return f"""
WITH src AS ({src}), tgt AS ({tgt}),
s AS (SELECT {s_sel} FROM src),
t AS (SELECT {s_sel} FROM tgt),
j AS (SELECT coalesce(s.key_col, t.key_col) AS key_col, s.key_col IS NOT NULL AS hs,
             t.key_col IS NOT NULL AS ht, {", ".join(vals)}
      FROM s FULL OUTER JOIN t ON s.key_col = t.key_col)
SELECT key_col, CAST(hs AS BIGINT) AS n_source, CAST(ht AS BIGINT) AS n_target,
       CAST(0 AS BIGINT) AS matched_pairs, CAST(1 AS BIGINT) AS mismatch_pairs,
       CASE WHEN NOT ht THEN 'missing_in_target' WHEN NOT hs THEN 'extra_in_target'
            ELSE 'value_mismatch' END AS mismatch_type,
       {out_vals},
       CASE WHEN hs AND ht THEN concat_ws(',', {changed}) END AS changed_columns
FROM j WHERE NOT (hs AND ht) OR {diff_any}"""


KEYED_DIFF_ORDERS = _unique_key_diff(ORDERS_SOURCE, ORDERS_TARGET,
                                     {"val": "canon_str", "amount": "canon_dec", "o_orderdate": "canon_ts"})

KEYED_DIFF_MULTI = _unique_key_diff(
    "SELECT c_custkey AS key_col, c_name, c_acctbal, c_mktsegment FROM customer", CUSTOMER_TARGET,
    {"c_name": "canon_str", "c_acctbal": "canon_float", "c_mktsegment": "canon_str"})

DUP_KEY_PAIRS = f"""
WITH src AS (SELECT l_orderkey AS key_col, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS qty FROM lineitem),
tgt AS ({LINEITEM_TARGET_BASE}
  UNION ALL
  SELECT * FROM ({LINEITEM_TARGET_BASE}) b WHERE key_col % 113 = 0),
s AS (SELECT {canon_int('key_col')} AS key_col, {canon_int('l_linenumber')} AS ln, {canon_dec('qty')} AS qty FROM src),
t AS (SELECT {canon_int('key_col')} AS key_col, {canon_int('l_linenumber')} AS ln, {canon_dec('qty')} AS qty FROM tgt),
ns AS (SELECT key_col, count(*) AS n FROM s GROUP BY key_col),
nt AS (SELECT key_col, count(*) AS n FROM t GROUP BY key_col),
p AS (SELECT s.key_col,
             count(*) FILTER (WHERE s.ln = t.ln AND s.qty = t.qty) AS matched,
             count(*) FILTER (WHERE NOT (s.ln = t.ln AND s.qty = t.qty)) AS mism
      FROM s JOIN t ON s.key_col = t.key_col GROUP BY s.key_col),
k AS (SELECT key_col FROM ns UNION SELECT key_col FROM nt),
r AS (SELECT k.key_col, coalesce(ns.n, 0) AS n_source, coalesce(nt.n, 0) AS n_target,
             coalesce(p.matched, 0) AS matched_pairs,
             CASE WHEN nt.n IS NULL THEN ns.n WHEN ns.n IS NULL THEN nt.n ELSE p.mism END AS mismatch_pairs
      FROM k LEFT JOIN ns ON k.key_col = ns.key_col LEFT JOIN nt ON k.key_col = nt.key_col
             LEFT JOIN p ON k.key_col = p.key_col)
SELECT key_col, CAST(n_source AS BIGINT) AS n_source, CAST(n_target AS BIGINT) AS n_target,
       CAST(matched_pairs AS BIGINT) AS matched_pairs, CAST(mismatch_pairs AS BIGINT) AS mismatch_pairs,
       CASE WHEN n_target = 0 THEN 'missing_in_target' WHEN n_source = 0 THEN 'extra_in_target'
            WHEN n_source = 1 AND n_target = 1 THEN 'value_mismatch' ELSE 'duplicate_key' END AS mismatch_type
FROM r WHERE mismatch_pairs > 0"""

DIFF_CLASS_COUNTS = f"""
SELECT mismatch_type, CAST(count(*) AS BIGINT) AS n_keys, CAST(sum(mismatch_pairs) AS BIGINT) AS mismatch_pairs
FROM ({DUP_KEY_PAIRS}) d GROUP BY mismatch_type"""

KEYED_DIFF_CHECK = f"""
WITH d AS ({KEYED_DIFF_ORDERS}),
n AS (SELECT (SELECT count(*) FROM ({ORDERS_SOURCE}) a) AS ns, (SELECT count(*) FROM ({ORDERS_TARGET}) b) AS nt,
             (SELECT count(*) FROM d) AS mm)
SELECT 'value_match_orders' AS check_name, 'value_match' AS check_type, mm = 0 AS passed,
       CAST(ns AS VARCHAR) || ' rows' AS source_value, CAST(nt AS VARCHAR) || ' rows' AS target_value,
       CAST(mm AS BIGINT) AS mismatch_count
FROM n"""

_ORDER_DIFF_FIELDS = ["key_col", "n_source", "n_target", "matched_pairs", "mismatch_pairs", "mismatch_type",
                      "val_source", "val_target", "amount_source", "amount_target",
                      "o_orderdate_source", "o_orderdate_target", "changed_columns"]

KEYED_DIFF_SAMPLE = f"""
WITH d AS ({KEYED_DIFF_ORDERS}),
s AS (SELECT * FROM d ORDER BY key_col LIMIT 100),
b AS (SELECT
        CAST(count(*) FILTER (WHERE mismatch_type = 'missing_in_target') AS BIGINT) AS missing_in_target,
        CAST(count(*) FILTER (WHERE mismatch_type = 'extra_in_target') AS BIGINT) AS extra_in_target,
        CAST(count(*) FILTER (WHERE mismatch_type = 'value_mismatch') AS BIGINT) AS value_mismatch,
        CAST(0 AS BIGINT) AS duplicate_key,
        CAST(count(*) FILTER (WHERE val_source <> val_target) AS BIGINT) AS c_val,
        CAST(count(*) FILTER (WHERE amount_source <> amount_target) AS BIGINT) AS c_amount,
        CAST(count(*) FILTER (WHERE o_orderdate_source <> o_orderdate_target) AS BIGINT) AS c_date
      FROM d)
SELECT 'value_match_orders' AS check_name,
       (SELECT CAST(to_json(list(struct_pack({", ".join(_ORDER_DIFF_FIELDS)}) ORDER BY key_col)) AS VARCHAR)
        FROM s) AS mismatch_sample,
       CAST(to_json(struct_pack(
         by_type := struct_pack(missing_in_target := missing_in_target, extra_in_target := extra_in_target,
                                value_mismatch := value_mismatch, duplicate_key := duplicate_key),
         by_column := struct_pack(val := c_val, amount := c_amount, o_orderdate := c_date))) AS VARCHAR)
         AS mismatch_breakdown
FROM b"""

_SET_S = f"SELECT DISTINCT {canon_int('o_custkey')} AS val FROM orders"
_SET_T = f"SELECT DISTINCT {canon_int('c_custkey')} AS val FROM customer WHERE c_mktsegment <> 'MACHINERY'"

SET_DIFF_CUSTOMERS = f"""
WITH s AS ({_SET_S}), t AS ({_SET_T})
SELECT coalesce(s.val, t.val) AS val,
       CASE WHEN t.val IS NULL THEN 'missing_in_target' ELSE 'extra_in_target' END AS mismatch_type
FROM s FULL OUTER JOIN t ON s.val = t.val WHERE s.val IS NULL OR t.val IS NULL"""

SET_DIFF_CHECK = f"""
WITH s AS ({_SET_S}), t AS ({_SET_T}),
n AS (SELECT (SELECT count(*) FROM s) AS ns, (SELECT count(*) FROM t) AS nt,
             (SELECT count(*) FROM ({SET_DIFF_CUSTOMERS}) d) AS mm)
SELECT 'set_customers' AS check_name, 'value_match' AS check_type, mm = 0 AS passed,
       CAST(ns AS VARCHAR) || ' distinct values' AS source_value,
       CAST(nt AS VARCHAR) || ' distinct values' AS target_value, CAST(mm AS BIGINT) AS mismatch_count
FROM n"""


SET_DIFF_SAMPLE = f"""
WITH d AS ({SET_DIFF_CUSTOMERS}),
m AS (SELECT * FROM d WHERE mismatch_type = 'missing_in_target' ORDER BY val LIMIT 50),
e AS (SELECT * FROM d WHERE mismatch_type = 'extra_in_target' ORDER BY val LIMIT 50),
s AS (SELECT * FROM m UNION ALL SELECT * FROM e)
SELECT 'set_customers' AS check_name,
       CAST(to_json(list(struct_pack(mismatch_type, val) ORDER BY mismatch_type, val)) AS VARCHAR)
         AS mismatch_sample
FROM s"""


def _rows_text(q: str) -> str:
    cols = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    sel = ", ".join(f"CAST({c} AS VARCHAR) AS c{i}" for i, c in enumerate(cols))
    return f"SELECT DISTINCT {sel} FROM ({q}) q"


ROW_SET_DIFF_PARTS = f"""
WITH s AS ({_rows_text(PART_SOURCE)}), t AS ({_rows_text(PART_TARGET)})
SELECT {", ".join(f"coalesce(s.c{i}, t.c{i}) AS c{i}" for i in range(6))},
       CASE WHEN t.c0 IS NULL THEN 'missing_in_target' ELSE 'extra_in_target' END AS mismatch_type
FROM s FULL OUTER JOIN t ON {" AND ".join(f"s.c{i} IS NOT DISTINCT FROM t.c{i}" for i in range(6))}
WHERE s.c0 IS NULL OR t.c0 IS NULL"""


def _scalar(name: str, ctype: str, a: str, b: str) -> str:
    return f"""
WITH v AS (SELECT CAST(({a}) AS VARCHAR) AS sv, CAST(({b}) AS VARCHAR) AS tv)
SELECT '{name}' AS check_name, '{ctype}' AS check_type, sv IS NOT DISTINCT FROM tv AS passed,
       sv AS source_value, tv AS target_value,
       CAST(CASE WHEN sv IS NOT DISTINCT FROM tv THEN 0 ELSE 1 END AS BIGINT) AS mismatch_count
FROM v"""


SCALAR_ROW_COUNT = _scalar("row_count_orders", "row_count", f"SELECT count(*) FROM ({ORDERS_SOURCE}) a",
                           f"SELECT count(*) FROM ({ORDERS_TARGET}) b")

SCALAR_SUM = _scalar(
    "sum_qty_lineitem", "value_match", "SELECT sum(CAST(l_quantity AS DECIMAL(12,2))) FROM lineitem",
    f"SELECT sum(qty) FROM ({LINEITEM_TARGET_BASE} UNION ALL "
    f"SELECT * FROM ({LINEITEM_TARGET_BASE}) b WHERE key_col % 113 = 0) t")


def _row_text(parts: list[str]) -> str:
    """Row text with the columns in the order of their names."""
    return " || ".join(f"coalesce('V' || length({p}) || ':' || {p}, 'N')" for p in parts)


def _checksum(q: str, parts: list[str]) -> str:
    return f"""
SELECT count(*) AS n_rows, CAST(coalesce(sum(h1), 0) AS DECIMAL(38,0)) AS sum_hash,
       CAST(coalesce(sum(h2), 0) AS DECIMAL(38,0)) AS sum_hash_2,
       CAST(coalesce(bit_xor(h2 % 1152921504606846976), 0) AS BIGINT) AS xor_hash
FROM (SELECT CAST('0x' || substr(m, 1, 16) AS UBIGINT) AS h1, CAST('0x' || substr(m, 17, 16) AS UBIGINT) AS h2
      FROM (SELECT md5({_row_text(parts)}) AS m FROM ({q}) q) d) x"""


CHECKSUM_TABLE = _checksum("SELECT * FROM customer", [
    text_float("c_acctbal"), text_int("c_custkey"), "c_mktsegment", "c_name", text_int("c_nationkey")])

_ORDER_PARTS = [text_dec("amount"), text_int("key_col"), text_ts("o_orderdate"), "val"]

CHECKSUM_MATCH = f"""
WITH s AS ({_checksum(ORDERS_SOURCE, _ORDER_PARTS)}), t AS ({_checksum(ORDERS_TARGET, _ORDER_PARTS)}),
c AS (SELECT concat_ws(':', s.n_rows, s.sum_hash, s.sum_hash_2, s.xor_hash) AS source_checksum,
             concat_ws(':', t.n_rows, t.sum_hash, t.sum_hash_2, t.xor_hash) AS target_checksum FROM s, t)
SELECT source_checksum, target_checksum, source_checksum = target_checksum AS checksum_match FROM c"""


_CUSTOMER_SOURCE = "SELECT c_custkey AS key_col, c_name, c_acctbal, c_mktsegment FROM customer"

CHECKSUM_GATE_CHECK = f"""
SELECT 'customers_reloaded' AS check_name, 'value_match' AS check_type,
       d = 0 AS passed,
       CASE WHEN d = 0 THEN 'Checksum Match' ELSE 'sides differ' END AS source_value,
       CASE WHEN d = 0 THEN 'Checksum Match' ELSE 'sides differ' END AS target_value,
       CAST(0 AS BIGINT) AS mismatch_count
FROM (SELECT (SELECT count(*) FROM (({_CUSTOMER_SOURCE}) EXCEPT ALL
                                    (SELECT * FROM ({_CUSTOMER_SOURCE}) a WHERE key_col % 2 = 1
                                     UNION ALL SELECT * FROM ({_CUSTOMER_SOURCE}) b WHERE key_col % 2 = 0)) x) AS d) y
UNION ALL
SELECT 'orders_loaded' AS check_name, check_type, passed, source_value, target_value, mismatch_count
FROM ({KEYED_DIFF_CHECK}) k"""


def _count_check(name: str, ctype: str, count_sql: str) -> str:
    return f"""
WITH v AS ({count_sql})
SELECT '{name}' AS check_name, '{ctype}' AS check_type, cnt = 0 AS passed,
       CAST(cnt AS VARCHAR) AS target_value, CAST(cnt AS BIGINT) AS mismatch_count FROM v"""


NULL_CHECK = _count_check("null_order_date", "null_check", """
  SELECT count(*) FILTER (WHERE o_orderkey % 79 = 0)
         + count(*) FILTER (WHERE o_orderkey % 79 = 0 AND o_orderkey % 101 = 0) AS cnt
  FROM orders WHERE o_orderkey % 97 <> 0""")

DUPLICATE_CHECK = """
SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""

FK_CHECK = _count_check("fk_labels_doc_id", "dq_check", """
  SELECT count(*) AS cnt FROM labels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 11 <> 0)""")

FK_ORPHANS = """
SELECT o.o_custkey, count(*) AS cnt
FROM orders o LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') c
  ON o.o_custkey = c.c_custkey
WHERE c.c_custkey IS NULL GROUP BY o.o_custkey"""

DQ_POSITIVE = _count_check("dq_l_quantity_positive", "dq_check", """
  SELECT count(*) AS cnt FROM lineitem WHERE month(l_shipdate) >= 3 AND l_orderkey % 7 = 0 AND l_quantity >= 0
     OR NOT (month(l_shipdate) >= 3 AND l_orderkey % 7 = 0) AND l_quantity <= 0""")
DQ_RANGE = _count_check("dq_l_extendedprice_range", "dq_check",
                        "SELECT count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN 0 AND 104000)) AS cnt "
                        "FROM lineitem")
DQ_ENUM = _count_check("dq_o_orderstatus_enum", "dq_check",
                       "SELECT count(*) FILTER (WHERE NOT (o_orderstatus IN ('F', 'O'))) AS cnt FROM orders")
DQ_LEN = _count_check("dq_p_name_len", "dq_check",
                      "SELECT count(*) FILTER (WHERE length(p_name) > 10) AS cnt FROM part")
DQ_YYYYMM = _count_check("dq_period_key_yyyymm", "dq_check", """
  SELECT count(*) FILTER (WHERE o_orderkey % 83 = 0)
         + count(*) FILTER (WHERE o_orderkey % 83 = 0 AND o_orderkey % 101 = 0) AS cnt
  FROM orders WHERE o_orderkey % 97 <> 0""")

XF_MD5_KEY = ("SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR) || CAST(o_custkey AS VARCHAR)) AS order_sk "
              "FROM orders")
XF_PERIOD_KEY = ("SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS period_key "
                 "FROM orders")
XF_NET_AMOUNT = """
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) AS gross_amt,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(12,2))
         AS net_amt
FROM lineitem"""
XF_CASE_CODE = """
SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 WHEN c_mktsegment = 'BUILDING' THEN 2
                       WHEN c_mktsegment = 'FURNITURE' THEN 3 WHEN c_mktsegment = 'HOUSEHOLD' THEN 4
                       WHEN c_mktsegment = 'MACHINERY' THEN 5 END AS segment_code
FROM customer"""
XF_SUBSTR = "SELECT p_partkey, substr(p_name, 1, 5) AS short_name FROM part"
XF_LPAD_KEY = "SELECT c_custkey, 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS customer_code FROM customer"
XF_DATE_PARSE = ("SELECT o_orderkey, CAST(strptime(substr(CAST(o_orderdate AS VARCHAR), 1, 10), '%Y-%m-%d') "
                 "AS DATE) AS order_date FROM orders")
XF_CAST = ("SELECT o_orderkey, TRY_CAST(o_totalprice AS DECIMAL(10,0)) AS price_whole, "
           "TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_rank FROM orders")
XF_SCD2_LOOKUP = f"""
WITH d AS ({CUSTOMER_HISTORY})
SELECT o.o_orderkey, d.cust_sk FROM orders o LEFT JOIN d
  ON o.o_custkey = d.cust_id AND o.o_orderdate >= d.valid_from
 AND (d.valid_to IS NULL OR o.o_orderdate < d.valid_to)"""
XF_SCD2_CURRENT = f"""
WITH d AS ({CUSTOMER_HISTORY})
SELECT o.o_orderkey, d.cust_sk FROM orders o LEFT JOIN (SELECT * FROM d WHERE is_current = 1) d
  ON o.o_custkey = d.cust_id"""
XF_DIM_LOOKUP = ("SELECT c.c_custkey, n.n_name AS nation_name FROM customer c "
                 "LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey")
XF_BRIDGE_JOIN = """
SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""

# Column lists of the driver's TPC-H-style tables (TESTDATA / FIXTURES F).
TPCH_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}


def _profile_one(t: str, c: str) -> str:
    return f"""
SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) - count({c}) AS BIGINT) AS n_nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
       CAST(coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) x), 0)
            AS BIGINT) AS max_repeat
FROM {t}"""


PROFILE_COLUMNS = f"""
WITH p AS ({" UNION ALL ".join(_profile_one(t, c) for t, cols in TPCH_COLUMNS.items() for c in cols)})
SELECT *, max_repeat <= 1 AND n_distinct > 0 AS is_unique,
       max_repeat <= 1 AND n_distinct > 0 AND n_nulls = 0 AS is_key_candidate
FROM p"""

def _long_text(t: str) -> str:
    return (f"SELECT '{t}' AS t, column_name AS c, v FROM (UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) "
            f"ON COLUMNS(*) INTO NAME column_name VALUE v)")


# Key candidates, candidate pairs and inclusion tests all derived from the
# data: values unpivoted to text (NULLs dropped), a key candidate is a column
# whose non-null distinct count equals the table's row count, a pair shares
# the name stem (short table prefix removed) with a key-like parent stem and
# a type family.
_DISCOVERY_CTES = f"""
long AS ({" UNION ALL ".join(_long_text(t) for t in TPCH_COLUMNS)}),
n AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in TPCH_COLUMNS)}),
cols AS (SELECT table_name AS t, column_name AS c,
                lower(regexp_replace(column_name, '^[A-Za-z]{{1,3}}_(.+)$', '\\1')) AS stem,
                CASE WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN 'integral'
                     ELSE data_type END AS fam
         FROM information_schema.columns
         WHERE table_name IN ({", ".join(f"'{t}'" for t in TPCH_COLUMNS)})),
prof AS (SELECT t, c, count(*) AS nn, count(DISTINCT v) AS d FROM long GROUP BY t, c),
keys AS (SELECT p.t, p.c FROM prof p JOIN n ON p.t = n.t WHERE p.nn = n.n AND p.d = p.nn AND n.n > 0),
cand AS (SELECT ch.t AS child_table, ch.c AS child_column, pc.t AS parent_table, pc.c AS parent_column
         FROM keys k JOIN cols pc ON pc.t = k.t AND pc.c = k.c
              JOIN cols ch ON ch.stem = pc.stem AND ch.t <> pc.t AND ch.fam = pc.fam
         WHERE regexp_matches(pc.stem, '(id|key|code|_cd|type)$')),
cv AS (SELECT DISTINCT cand.*, l.v FROM cand JOIN long l ON l.t = cand.child_table AND l.c = cand.child_column),
pv AS (SELECT DISTINCT l.t, l.c, l.v FROM long l),
fk AS (SELECT child_table, child_column, parent_table, parent_column,
              CAST(count(*) AS BIGINT) AS child_distinct,
              CAST(count(*) FILTER (WHERE pv.v IS NULL) AS BIGINT) AS orphan_values,
              count(*) FILTER (WHERE pv.v IS NULL) = 0 AND count(*) > 0 AS is_fk
       FROM cv LEFT JOIN pv ON pv.t = cv.parent_table AND pv.c = cv.parent_column AND pv.v = cv.v
       GROUP BY child_table, child_column, parent_table, parent_column)"""

FK_DISCOVERY = f"WITH {_DISCOVERY_CTES}\nSELECT * FROM fk"

# Seeds orders and part; the phases of relationship discovery in order, each
# skipping tables chosen before it.
BRIDGE_DISCOVERY = f"""
WITH {_DISCOVERY_CTES},
seeds AS (SELECT * FROM (VALUES ('orders'), ('part')) s(table_name)),
c0 AS (SELECT table_name, 'seed' AS reason FROM seeds),
o AS (SELECT DISTINCT parent_table AS table_name, 'outbound_fk' AS reason FROM fk
      WHERE is_fk AND child_table IN (SELECT table_name FROM seeds)
        AND parent_table NOT IN (SELECT table_name FROM c0)),
c1 AS (SELECT * FROM c0 UNION ALL SELECT * FROM o),
b AS (SELECT child_table AS table_name, 'bridge_fk' AS reason FROM fk
      WHERE is_fk AND parent_table IN (SELECT table_name FROM seeds)
        AND child_table NOT IN (SELECT table_name FROM c1)
      GROUP BY child_table HAVING count(DISTINCT parent_table) >= 2),
c2 AS (SELECT * FROM c1 UNION ALL SELECT * FROM b),
seed_keys AS (SELECT cols.t AS seed, lower(cols.c) AS cname FROM cols
              WHERE cols.t IN (SELECT table_name FROM seeds)
                AND ((cols.t, cols.c) IN (SELECT t, c FROM keys)
                     OR regexp_matches(lower(cols.c), '(_id|_key|_code|_cd|type|code)$'))),
bn AS (SELECT o2.t AS table_name, 'bridge_name' AS reason
       FROM (SELECT t, lower(c) AS cname FROM cols WHERE t NOT IN (SELECT table_name FROM c2)
               AND regexp_matches(lower(c), '(_id|_key|_code|_cd|type|code)$')) o2
       JOIN seed_keys k ON o2.cname = k.cname GROUP BY o2.t HAVING count(DISTINCT k.seed) >= 2),
c3 AS (SELECT * FROM c2 UNION ALL SELECT * FROM bn),
i AS (SELECT DISTINCT child_table AS table_name, 'inbound_fk' AS reason FROM fk
      WHERE is_fk AND parent_table IN (SELECT table_name FROM seeds)
        AND child_table NOT IN (SELECT table_name FROM c3))
SELECT * FROM c3 UNION ALL SELECT * FROM i"""

_NAMED = {"sales": "SELECT o_orderkey AS order_id, o_custkey AS cust_id FROM orders",
          "party": "SELECT c_custkey AS cust_id, c_nationkey AS nation_id FROM customer",
          "country": "SELECT n_nationkey AS nation_id FROM nation",
          "invoice": "SELECT o_orderkey AS order_id, o_custkey AS cust_id FROM orders WHERE o_orderstatus = 'F'",
          "visits": "SELECT DISTINCT o_custkey AS cust_id, year(o_orderdate) AS y FROM orders",
          "line": "SELECT l_orderkey AS order_id, l_partkey AS part_id FROM lineitem",
          "item": "SELECT p_partkey AS part_id FROM part",
          "maker": "SELECT s_suppkey AS supp_id, s_nationkey AS nation_id FROM supplier"}
_NAMED_IDS = [(t, c) for t, q in _NAMED.items() for c in ("order_id", "cust_id", "nation_id", "part_id", "supp_id") if f"AS {c}" in q]

RELATED_BY_NAME = f"""
WITH v AS ({" UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS x FROM ({_NAMED[t]}) q" for t, c in _NAMED_IDS)}),
cols AS (SELECT DISTINCT t, c FROM v),
keys AS (SELECT t, c FROM v GROUP BY 1, 2 HAVING count(*) = count(DISTINCT x)),
pairs AS (SELECT a.t AS child, b.t AS parent, a.c FROM cols a JOIN keys b ON a.c = b.c AND a.t <> b.t),
fk AS (SELECT child, parent FROM pairs p WHERE NOT EXISTS (
  SELECT 1 FROM v WHERE v.t = p.child AND v.c = p.c AND v.x IS NOT NULL AND v.x NOT IN (SELECT x FROM v w WHERE w.t = p.parent AND w.c = p.c AND w.x IS NOT NULL))),
seeds AS (SELECT * FROM (VALUES ('sales'), ('party')) s(t)),
found AS (
  SELECT t, 0 AS phase FROM seeds
  UNION ALL SELECT parent, 1 FROM fk WHERE child IN (SELECT t FROM seeds)
  UNION ALL SELECT child, 2 FROM fk WHERE parent IN (SELECT t FROM seeds) GROUP BY 1 HAVING count(DISTINCT parent) >= 2
  UNION ALL SELECT a.t, 3 FROM cols a JOIN cols b ON a.c = b.c WHERE b.t IN (SELECT t FROM seeds) GROUP BY 1 HAVING count(DISTINCT b.t) >= 2
  UNION ALL SELECT child, 4 FROM fk WHERE parent IN (SELECT t FROM seeds))
SELECT t AS table_name, ['seed', 'outbound_fk', 'bridge_fk', 'bridge_name', 'inbound_fk'][min(phase) + 1] AS reason FROM found GROUP BY t"""

_SPARK_TYPE = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
               "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean"}

_NULLS = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
    for t, cols in TPCH_COLUMNS.items() for c in cols)

SCHEMA_COLUMNS = f"""
SELECT i.table_name, i.column_name, CAST(i.ordinal_position - 1 AS INTEGER) AS position,
       CASE i.data_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SPARK_TYPE.items())}
            ELSE lower(i.data_type) END AS data_type,
       i.is_nullable = 'YES' AS nullable,
       CAST(z.n_rows AS BIGINT) AS n_rows, CAST(z.n_nulls AS BIGINT) AS n_nulls
FROM information_schema.columns i JOIN ({_NULLS}) z ON z.t = i.table_name AND z.c = i.column_name
WHERE i.table_name IN ({", ".join(f"'{t}'" for t in TPCH_COLUMNS)})"""

# ---------------------------------------------------------------- verdicts of the suite layer

CHECKSUM_GATE_SWAPPED = """
WITH s AS (SELECT o_orderkey AS k, coalesce(o_orderstatus, '') AS a, coalesce(o_orderpriority, '') AS b FROM orders)
SELECT 'columns_swapped' AS check_name, false AS passed, (SELECT count(*) || ' rows' FROM s) AS source_value,
       (SELECT count(*) FROM s WHERE a <> b)::BIGINT AS mismatch_count
UNION ALL SELECT 'columns_reordered', true, 'Checksum Match', 0
UNION ALL SELECT 'null_or_text', (SELECT count(*) FROM s WHERE k % 5 = 0) = 0, (SELECT count(*) || ' rows' FROM s),
       (SELECT count(*) FROM s WHERE k % 5 = 0)::BIGINT"""

SCALAR_SHAPE_CHECK = """
WITH n AS (SELECT count(*) AS n FROM nation), e AS (SELECT 'a scalar comparison needs one row and one column on each side: ' AS e)
SELECT 'many_rows' AS check_name, false AS passed, NULL::BIGINT AS mismatch_count,
       e || n || ' and ' || n || ' rows' AS error_message FROM n, e
UNION ALL SELECT 'no_row_and_null', false, NULL, e || '0 and 1 rows' FROM e
UNION ALL SELECT 'two_columns', false, NULL, e || '2 and 1 columns' FROM e
UNION ALL SELECT 'both_null', true, 0, NULL
UNION ALL SELECT 'equal', true, 0, NULL
UNION ALL SELECT 'unequal', false, 1, NULL"""

TARGET_ROWS_CHECK = """
WITH v AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice < 2000),
first AS (SELECT id FROM v ORDER BY id LIMIT 50)
SELECT 'one_row_with_id_0' AS check_name, false AS passed, '1' AS target_value, 1::BIGINT AS mismatch_count,
       '[{"id":0}]' AS mismatch_sample
UNION ALL SELECT 'many_rows', (SELECT count(*) FROM v) = 0, (SELECT count(*)::VARCHAR FROM v), (SELECT count(*) FROM v),
       (SELECT '[' || string_agg('{"id":' || id || '}', ',' ORDER BY id) || ']' FROM first)
UNION ALL SELECT 'no_row', true, '0', 0, NULL
UNION ALL SELECT 'a_count', (SELECT count(*) FROM v) = 0, (SELECT count(*)::VARCHAR FROM v), (SELECT count(*) FROM v), NULL
UNION ALL SELECT 'a_count_named_rows', false, '1', 1,
       (SELECT '[{"cnt":' || count(*) || '}]' FROM v)"""

KEYED_DIFF_REPEATED_MISSING = f"""
WITH s AS (SELECT l_orderkey AS k, l_linenumber AS ln, CAST(l_quantity AS DECIMAL(12,2)) AS qty FROM lineitem),
t AS (SELECT * FROM s WHERE k % 29 <> 0 UNION ALL SELECT -k, ln, qty FROM s WHERE k % 31 = 0)
SELECT {canon_int('k')} AS key_col, 'missing_in_target' AS mismatch_type, {canon_int('ln')} AS l_linenumber,
       {canon_dec('qty')} AS qty, count(*) AS n_rows FROM s WHERE k NOT IN (SELECT k FROM t) GROUP BY ALL
UNION ALL
SELECT {canon_int('k')}, 'extra_in_target', {canon_int('ln')}, {canon_dec('qty')}, count(*)
FROM t WHERE k NOT IN (SELECT k FROM s) GROUP BY ALL"""

# The lineitem load rules and their SQL predicates (violation = NOT cond).
LINEITEM_RULE_SQL = [
    ("l_quantity: >0", "NOT (l_quantity > 0)"),
    ("l_discount: 0-1 range", "NOT (l_discount BETWEEN 0 AND 1)"),
    ("l_tax: 0-0.08 range", "NOT (l_tax BETWEEN 0 AND 0.08)"),
    ("l_returnflag: values A, N, R", "NOT (l_returnflag IN ('A', 'N', 'R'))"),
    ("l_linestatus: values O, F", "NOT (l_linestatus IN ('O', 'F'))"),
    ("l_shipdate: NOT NULL", "l_shipdate IS NULL"),
    ("l_extendedprice: 0-104000 range", "NOT (l_extendedprice BETWEEN 0 AND 104000)"),
]

_MONTH = "month(l_shipdate)"
LINEITEM_LOAD = f"""
SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INTEGER) AS batch,
  CASE WHEN {_MONTH} >= 3 AND l_orderkey % 7 = 0 THEN -l_quantity ELSE l_quantity END AS l_quantity,
  CASE WHEN {_MONTH} >= 5 AND l_orderkey % 7 = 1 THEN l_discount + 1.5 ELSE l_discount END AS l_discount,
  CASE WHEN {_MONTH} >= 6 AND l_orderkey % 7 = 2 THEN l_tax + 0.1 ELSE l_tax END AS l_tax,
  CASE WHEN {_MONTH} >= 8 AND l_orderkey % 7 = 3 THEN 'X' ELSE l_returnflag END AS l_returnflag,
  CASE WHEN {_MONTH} >= 9 AND l_orderkey % 7 = 4 THEN 'Q' ELSE l_linestatus END AS l_linestatus,
  CASE WHEN {_MONTH} >= 10 AND l_orderkey % 7 = 5 THEN NULL ELSE l_shipdate END AS l_shipdate,
  CASE WHEN {_MONTH} >= 11 AND l_orderkey % 7 = 6 THEN l_extendedprice + 200000 ELSE l_extendedprice END AS l_extendedprice
FROM lineitem"""

FUSED_SUITE = " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) AS violations FROM ({LINEITEM_LOAD}) l"
    for n, p in LINEITEM_RULE_SQL)

BATCH_RESULTS = " UNION ALL ".join(f"""
SELECT batch AS run_id, '{n}' AS check_name,
       CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE {p}) AS BIGINT) AS mismatch_count,
       count(*) FILTER (WHERE {p}) = 0 AS passed
FROM ({LINEITEM_LOAD}) l GROUP BY 1""" for n, p in LINEITEM_RULE_SQL)

_RULE_NUMBER = "CASE check_name " + " ".join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(LINEITEM_RULE_SQL, 1)) + " END"

REPORT_CSV = f"""
WITH b AS ({BATCH_RESULTS}),
h AS (SELECT unnest([{{'l': 'Run ID:', 'v': '1'}}, {{'l': 'Mapping Document:', 'v': 'Unknown'}}, {{'l': 'Status:', 'v': 'completed'}},
  {{'l': 'Date:', 'v': max(run_id)::VARCHAR}}, {{'l': 'Total:', 'v': count(*)::VARCHAR}}, {{'l': 'Passed:', 'v': (count(*) FILTER (WHERE passed))::VARCHAR}},
  {{'l': 'Failed:', 'v': (count(*) FILTER (WHERE NOT passed))::VARCHAR}}]) AS x FROM b)
SELECT 'header' AS section, x.l AS case_id, x.v AS case_name, NULL AS case_type, NULL AS status, NULL AS source_value, NULL AS target_value,
       NULL AS mismatches, NULL AS error FROM h
UNION ALL
SELECT 'results', (run_id * 10 + {_RULE_NUMBER})::VARCHAR, run_id || ': "' || check_name || '"', 'dq_check', CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END,
       rows::VARCHAR, CASE WHEN passed THEN '' ELSE mismatch_count::VARCHAR END, mismatch_count::VARCHAR,
       CASE WHEN passed THEN '' ELSE 'broken, "' || check_name || '"' || chr(10) || 'in ' || run_id END FROM b"""

PARSE_SUMMARY = """
SELECT (SELECT count(*) FROM lineitem) AS field_mappings_count, count(*) AS test_cases_count,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS valid_tests, count(*) FILTER (WHERE o_orderstatus = 'O') AS invalid_tests
FROM orders WHERE o_orderkey % 10 <> 0"""

CONNECTOR_USAGE = """
SELECT o_orderkey AS id, o_orderpriority AS name,
       CASE WHEN o_custkey % 25 = 7 AND o_orderkey % 25 = 7 THEN 'source & target' WHEN o_custkey % 25 = 7 THEN 'source' ELSE 'target' END AS role
FROM orders WHERE o_orderstatus <> 'P' AND 7 IN (o_custkey % 25, o_orderkey % 25)"""

SOURCE_CATALOG = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, true AS is_temporary, count(*) AS n_rows, least(5, count(*))::INTEGER AS sampled, true AS sample_is_of_table FROM {t}"
    for t in TPCH_COLUMNS)

RUN_SUMMARY = f"""
SELECT run_id, CAST(count(*) AS BIGINT) AS total_cases, CAST(count(*) FILTER (WHERE passed) AS BIGINT) AS passed_cases,
       CAST(count(*) FILTER (WHERE NOT passed) AS BIGINT) AS failed_cases, 'completed' AS status
FROM ({BATCH_RESULTS}) b GROUP BY run_id"""

RUN_PAGE = f"""
SELECT r.*, (SELECT CAST(count(*) AS BIGINT) FROM ({RUN_SUMMARY}) a) AS total
FROM (SELECT * FROM ({RUN_SUMMARY}) s ORDER BY run_id DESC LIMIT 20 OFFSET 0) r"""

PASS_RATE = f"""
SELECT run_id, total_cases, passed_cases,
       CAST(CASE WHEN total_cases > 0 THEN round(passed_cases * 100.0 / total_cases) ELSE 0 END AS INTEGER)
         AS pass_rate,
       CASE WHEN CAST(CASE WHEN total_cases > 0 THEN round(passed_cases * 100.0 / total_cases) ELSE 0 END
                      AS INTEGER) >= 80 THEN 'good'
            WHEN CAST(CASE WHEN total_cases > 0 THEN round(passed_cases * 100.0 / total_cases) ELSE 0 END
                      AS INTEGER) >= 50 THEN 'warning' ELSE 'poor' END AS band
FROM ({RUN_SUMMARY}) s"""

DASHBOARD = f"""
WITH s AS ({RUN_SUMMARY}), recent AS (SELECT * FROM s ORDER BY run_id DESC LIMIT 10)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM s) AS n_runs,
       (SELECT CAST(coalesce(sum(passed_cases), 0) AS BIGINT) FROM recent) AS passed_latest,
       (SELECT CAST(coalesce(sum(failed_cases), 0) AS BIGINT) FROM recent) AS failed_latest"""

FILE_SOURCES = """
SELECT f.name AS source_file, o_orderstatus, count(*) AS n_orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(38,2)) AS total_price
FROM orders, (VALUES ('orders.csv'), ('orders.json'), ('orders.parquet'), ('orders.tsv')) f(name)
WHERE o_custkey > 0
GROUP BY f.name, o_orderstatus"""


# ---------------------------------------------------------------- mapping suite

_FACT_ORDERS_BASE = """
  SELECT md5(concat(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR))) AS order_sk,
         CASE WHEN o_orderkey % 71 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS cust_id,
         CAST(CASE WHEN o_orderkey % 83 = 0 THEN year(o_orderdate) * 100 + 13
                   ELSE year(o_orderdate) * 100 + month(o_orderdate) END AS INTEGER) AS period_key,
         CAST(CASE WHEN o_orderkey % 53 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) + 1
                   ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS total_amt,
         CAST(CASE WHEN o_orderkey % 89 = 0 THEN 4 WHEN o_orderstatus = 'F' THEN 1
                   WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderstatus = 'P' THEN 3 END AS INTEGER) AS status_code,
         substr(o_orderpriority, 1, 8) AS priority,
         CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date,
         o_orderkey AS k
  FROM orders WHERE o_orderkey % 97 <> 0"""

FACT_ORDERS = f"""
  SELECT * EXCLUDE (k) FROM ({_FACT_ORDERS_BASE}) a
  UNION ALL
  SELECT * EXCLUDE (k) FROM ({_FACT_ORDERS_BASE}) b WHERE k % 101 = 0"""

_ORDER_SK = "md5(concat(CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR)))"


def _pairs_check(name: str, source_val: str, target_val: str) -> str:
    """Keyed value check by brute force: every source/target row pair of a key
    is formed and the unequal ones counted, plus the rows of one-sided keys."""
    return f"""
SELECT '{name}' AS check_name, 'value_match' AS check_type, mm = 0 AS passed,
       CAST(cs AS VARCHAR) || ' rows' AS source_value, CAST(ct AS VARCHAR) || ' rows' AS target_value,
       CAST(mm AS BIGINT) AS mismatch_count
FROM (
  WITH s AS (SELECT {canon_str(_ORDER_SK)} AS k, {source_val} AS v FROM orders),
       t AS (SELECT {canon_str('order_sk')} AS k, {target_val} AS v FROM ({FACT_ORDERS}) f),
       ks AS (SELECT DISTINCT k FROM s), kt AS (SELECT DISTINCT k FROM t)
  SELECT (SELECT count(*) FROM s) AS cs, (SELECT count(*) FROM t) AS ct,
         (SELECT count(*) FROM s JOIN t ON s.k = t.k WHERE s.v <> t.v)
         + (SELECT count(*) FROM s WHERE k NOT IN (SELECT k FROM kt))
         + (SELECT count(*) FROM t WHERE k NOT IN (SELECT k FROM ks)) AS mm) x"""


def _target_count(name: str, ctype: str, where: str, frm: str = None) -> str:
    return f"""
SELECT '{name}' AS check_name, '{ctype}' AS check_type, cnt = 0 AS passed, CAST(NULL AS VARCHAR) AS source_value,
       CAST(cnt AS VARCHAR) AS target_value, CAST(cnt AS BIGINT) AS mismatch_count
FROM (SELECT count(*) AS cnt FROM {frm or f'({FACT_ORDERS}) f'} WHERE {where}) x"""


MAPPING_SUITE = " UNION ALL ".join([
    _pairs_check("M01 value_match fact_orders.order_sk", canon_str(_ORDER_SK), canon_str("order_sk")),
    _target_count("M01 null_check fact_orders.order_sk", "null_check", "order_sk IS NULL"),
    f"""
SELECT 'M01 duplicate_check fact_orders.order_sk' AS check_name, 'duplicate_check' AS check_type,
       n = 0 AS passed, CAST(NULL AS VARCHAR) AS source_value, CAST(n AS VARCHAR) AS target_value,
       CAST(n AS BIGINT) AS mismatch_count
FROM (SELECT count(*) AS n FROM (SELECT order_sk FROM ({FACT_ORDERS}) f GROUP BY order_sk
                                 HAVING count(*) > 1) g) x""",
    _pairs_check("M02 value_match fact_orders.cust_id", canon_int("o_custkey"), canon_int("cust_id")),
    _target_count("M02 fk_check fact_orders.cust_id", "dq_check", "c.c_custkey IS NULL",
                  f"({FACT_ORDERS}) f LEFT JOIN customer c ON f.cust_id = c.c_custkey"),
    _pairs_check("M03 value_match fact_orders.period_key",
                 canon_int("year(o_orderdate) * 100 + month(o_orderdate)"), canon_int("period_key")),
    _target_count("M03 dq_check fact_orders.period_key", "dq_check",
                  "NOT regexp_matches(CAST(period_key AS VARCHAR), '^[0-9]{4}(0[1-9]|1[0-2])$')"),
    _pairs_check("M04 value_match fact_orders.total_amt", canon_float("o_totalprice"), canon_dec("total_amt")),
    _target_count("M04 dq_check fact_orders.total_amt", "dq_check", "NOT (total_amt > 0)"),
    _pairs_check("M05 value_match fact_orders.status_code",
                 canon_int("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END"),
                 canon_int("status_code")),
    _target_count("M05 dq_check fact_orders.status_code", "dq_check", "NOT (status_code IN (1, 2, 3))"),
    _pairs_check("M06 value_match fact_orders.priority", canon_str("substr(o_orderpriority, 1, 8)"),
                 canon_str("priority")),
    _target_count("M06 dq_check fact_orders.priority", "dq_check", "length(priority) > 8"),
    _pairs_check("M07 value_match fact_orders.order_date", canon_ts("CAST(o_orderdate AS DATE)"),
                 canon_ts("order_date")),
    _target_count("M07 null_check fact_orders.order_date", "null_check", "order_date IS NULL"),
    f"""
SELECT 'row_count src_orders -> fact_orders' AS check_name, 'row_count' AS check_type, s = t AS passed,
       CAST(s AS VARCHAR) AS source_value, CAST(t AS VARCHAR) AS target_value,
       CAST(CASE WHEN s = t THEN 0 ELSE 1 END AS BIGINT) AS mismatch_count
FROM (SELECT (SELECT count(*) FROM orders) AS s, (SELECT count(*) FROM ({FACT_ORDERS}) f) AS t) x""",
])


# Case ids in the order the mapping's checks are generated (per row: value check,
# its rule check, the identity's duplicate check; the row count last).
_MAPPING_CASE_IDS = [
    "M01 value_match fact_orders.order_sk", "M01 null_check fact_orders.order_sk",
    "M01 duplicate_check fact_orders.order_sk", "M02 value_match fact_orders.cust_id",
    "M02 fk_check fact_orders.cust_id", "M03 value_match fact_orders.period_key",
    "M03 dq_check fact_orders.period_key", "M04 value_match fact_orders.total_amt",
    "M04 dq_check fact_orders.total_amt", "M05 value_match fact_orders.status_code",
    "M05 dq_check fact_orders.status_code", "M06 value_match fact_orders.priority",
    "M06 dq_check fact_orders.priority", "M07 value_match fact_orders.order_date",
    "M07 null_check fact_orders.order_date", "row_count src_orders -> fact_orders",
]

RUN_REPORT = f"""
SELECT CAST(v.id AS INTEGER) AS "Test Case ID", r.check_name AS "Test Name", r.check_type AS "Type",
       CASE WHEN r.passed THEN 'PASS' ELSE 'FAIL' END AS "Status",
       coalesce(r.source_value, '') AS "Source Value", coalesce(r.target_value, '') AS "Target Value",
       r.mismatch_count AS "Mismatches", '' AS "Error Message"
FROM ({MAPPING_SUITE}) r
JOIN (VALUES {", ".join(f"('{n}', {k})" for k, n in enumerate(_MAPPING_CASE_IDS, 1))}) v(name, id)
  ON r.check_name = v.name"""


FILE_SOURCES_SINGLE = """
SELECT f.name AS source_file, o_orderstatus AS grp, count(*) AS n
FROM orders, (VALUES ('orders.parquet'), ('data')) f(name) GROUP BY f.name, o_orderstatus
UNION ALL SELECT 'nations.json', CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY n_regionkey"""

# document, its table, the table's key; whether the document has the key column, whether it has cells with line breaks
_DOCUMENTS = [("customer.csv", "customer", "c_custkey", True, False), ("orders.tsv", "orders", "o_orderkey", True, False),
              ("lineitem.csv", "lineitem", "l_orderkey", False, False), ("part.csv", "part", "p_partkey", True, True),
              ("supplier.txt", "supplier", "s_suppkey", True, False)]

MAPPING_DOCS_MIXED = " UNION ALL ".join(f"""
SELECT '{d}' AS document, count(*) AS fields, count(*) FILTER (WHERE {has_keys} AND {k} % 7 = 0) AS keys,
       count(*) FILTER (WHERE {k} % 3 < 2) AS rules, count(*) FILTER (WHERE NOT {noted} OR {k} % 2 = 0) AS direct,
       count(*) FILTER (WHERE {noted} AND {k} % 2 = 1) AS with_line_break, NULL::VARCHAR AS error
FROM {t}""" for d, t, k, has_keys, noted in _DOCUMENTS) + """
UNION ALL SELECT 'region.csv', 0, 0, 0, 0, 0, 'no line of the document holds two known header names'"""

_RULE_CHECKS = [
    ("R0 null_check fact_orders.order_sk", "order_sk IS NULL"), ("R2 dq_check fact_orders.total_amt (>1000)", "NOT (total_amt > 1000)"),
    ("R2 dq_check fact_orders.total_amt (<200000)", "NOT (total_amt < 200000)"),
    ("R3 dq_check fact_orders.status_code (IN (1, 2, 3))", "status_code NOT IN (1, 2, 3)"), ("R3 null_check fact_orders.status_code", "status_code IS NULL"),
    ("R1 fk_check fact_orders.cust_id", "cust_id IS NULL OR cust_id NOT IN (SELECT c_custkey FROM customer)")]

MAPPING_RULE_CHECKS = f"""
WITH f AS ({FACT_ORDERS}),
r AS ({" UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (WHERE {p}) AS n FROM f" for n, p in _RULE_CHECKS)}
  UNION ALL SELECT 'R0 duplicate_check fact_orders.order_sk', (SELECT count(*) FROM (SELECT order_sk FROM f GROUP BY 1 HAVING count(*) > 1) d))
SELECT check_name, 'valid' AS validation_status, true AS is_active, n = 0 AS passed, n::BIGINT AS mismatch_count FROM r
UNION ALL SELECT * FROM (VALUES
  ('R4 unknown fact_orders.period_key', 'manual', false, NULL::BOOLEAN, NULL::BIGINT),
  ('R5 unknown fact_orders.priority', 'manual', false, NULL, NULL), ('R6 fk fact_orders.order_date', 'manual', false, NULL, NULL)) v"""

# ---------------------------------------------------------------- drifting files, runs stored once

TYPED_FOLDER = """
SELECT o_orderstatus AS part, o_orderkey,
  CASE WHEN reason IS NULL AND o_orderstatus <> 'P' THEN o_custkey END AS o_custkey,
  CASE WHEN reason IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice) ELSE o_totalprice END END AS o_totalprice,
  CASE WHEN reason IS NULL AND o_orderstatus = 'O' THEN o_orderstatus END AS status,
  CASE WHEN reason IS NULL AND o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) END AS o_orderdate, reason
FROM (SELECT *, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 97 = 0 THEN 'o_totalprice: not double: n/a'
                     WHEN o_orderstatus = 'P' AND o_orderkey % 89 = 0 THEN 'o_orderdate: not date: soon' END AS reason FROM orders)
WHERE o_orderstatus IN ('F', 'O', 'P')"""
IDEMPOTENT_APPEND = f"""
WITH r AS ({BATCH_RESULTS})
SELECT *, 'all batches' AS run FROM r UNION ALL SELECT *, 'failed/only' FROM r WHERE NOT passed"""

# ---------------------------------------------------------------- as-of, tolerance, alignment

CUSTOMER_HISTORY_FAULTY = f"""
SELECT cust_sk, cust_id, valid_from, CASE WHEN is_current = 0 AND cust_id % 11 = 0 THEN CAST(valid_to - INTERVAL 90 DAY AS DATE)
    WHEN is_current = 0 AND cust_id % 13 = 0 THEN CAST(valid_to + INTERVAL 200 DAY AS DATE) ELSE valid_to END AS valid_to, is_current
FROM ({CUSTOMER_HISTORY})"""
XF_SCD2_ASOF = f"""
WITH d AS ({CUSTOMER_HISTORY_FAULTY}),
started AS (SELECT o.o_orderkey, o.o_orderdate, d.cust_sk, d.valid_to FROM orders o LEFT JOIN d ON o.o_custkey = d.cust_id AND o.o_orderdate >= d.valid_from
  QUALIFY row_number() OVER (PARTITION BY o.o_orderkey ORDER BY d.valid_from DESC NULLS LAST) = 1)
SELECT o_orderkey, CASE WHEN valid_to IS NULL OR o_orderdate < valid_to THEN cust_sk END AS cust_sk FROM started"""
SCD2_FAULTS = f"""
WITH d AS ({CUSTOMER_HISTORY_FAULTY}), n AS (SELECT cust_id, valid_from, valid_to, lead(valid_from) OVER (PARTITION BY cust_id ORDER BY valid_from, valid_to) AS next_from FROM d)
SELECT *, CASE WHEN valid_to <= valid_from THEN 'empty' WHEN valid_to IS NULL OR next_from < valid_to THEN 'overlap' ELSE 'gap' END AS fault
FROM n WHERE valid_to <= valid_from OR (next_from IS NOT NULL AND valid_to IS DISTINCT FROM next_from)"""

_PRICES = """
SELECT l_orderkey AS key_col, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_partkey % 83 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN 'nan'::DOUBLE
  WHEN l_partkey % 97 = 0 THEN 1e30 WHEN l_partkey % 101 = 0 THEN 1e-13 ELSE l_extendedprice END AS price FROM lineitem"""
_NEAR = """(s[i] = t[j] OR (isfinite(s[i]) AND isfinite(t[j]) AND abs(s[i] - t[j]) <= greatest(0.01::DOUBLE, 1e-6::DOUBLE * greatest(abs(s[i]), abs(t[j])))))"""
# Two sorted lists a key, walked by two pointers.
KEYED_DIFF_TOLERANCE = f"""
WITH RECURSIVE src AS ({_PRICES}),
base AS (SELECT key_col, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_partkey % 101 = 0 THEN 0.0::DOUBLE WHEN (key_col + l_linenumber) % 37 = 0 THEN price + 7
    WHEN (key_col + l_linenumber) % 5 = 0 THEN price + 0.005::DOUBLE WHEN (key_col + l_linenumber) % 3 = 0 THEN price * (1 + 1e-7::DOUBLE) ELSE price END AS price
  FROM src WHERE l_partkey % 91 <> 0),
tgt AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE key_col % 113 = 0),
both_sides AS (SELECT 1 AS side, * FROM src UNION ALL SELECT 2, * FROM tgt),
lists AS (SELECT key_col, l_returnflag, price IS NULL AS no_price, list_sort(coalesce(list(coalesce(price, 0)) FILTER (side = 1), [])) AS s,
    list_sort(coalesce(list(coalesce(price, 0)) FILTER (side = 2), [])) AS t FROM both_sides GROUP BY ALL),
walk AS (SELECT key_col, s, t, 1 AS i, 1 AS j, 0 AS matched FROM lists
  UNION ALL
  SELECT key_col, s, t, CASE WHEN {_NEAR} OR s[i] < t[j] THEN i + 1 ELSE i END, CASE WHEN {_NEAR} OR s[i] >= t[j] THEN j + 1 ELSE j END,
    CASE WHEN {_NEAR} THEN matched + 1 ELSE matched END FROM walk WHERE i <= len(s) AND j <= len(t)),
k AS (SELECT key_col, sum(len(s))::BIGINT AS n_source, sum(len(t))::BIGINT AS n_target, sum(matched)::BIGINT AS n_matched
  FROM walk WHERE i > len(s) OR j > len(t) GROUP BY key_col)
SELECT key_col::VARCHAR AS key_col, n_source, n_target, n_matched, n_source - n_matched AS unmatched_source, n_target - n_matched AS unmatched_target,
  CASE WHEN n_target = 0 THEN 'missing_in_target' WHEN n_source = 0 THEN 'extra_in_target' ELSE 'value_mismatch' END AS mismatch_type
FROM k WHERE n_matched < n_source OR n_matched < n_target"""


def _alignment_round(i: int, agreed: str) -> str:
    """Numbers the rows that are left within the agreed values and pairs equal numbers."""
    by = f"PARTITION BY side, key_col{agreed}"
    on = "".join(f" AND a.{c} = b.{c}" for c in agreed.replace(",", " ").split())
    return f"""
n{i} AS (SELECT *, row_number() OVER ({by} ORDER BY l_linenumber, qty) AS r FROM left{i}),
p{i} AS (SELECT a.key_col, a.l_linenumber AS l1, a.qty AS q1, b.l_linenumber AS l2, b.qty AS q2, a.id AS ida, b.id AS idb
  FROM (FROM n{i} WHERE side = 1) a JOIN (FROM n{i} WHERE side = 2) b ON a.key_col = b.key_col AND a.r = b.r{on}),
left{i + 1} AS (SELECT id, side, key_col, l_linenumber, qty FROM left{i} WHERE id NOT IN (SELECT ida FROM p{i}) AND id NOT IN (SELECT idb FROM p{i})),"""


KEYED_DIFF_DUP_ALIGNMENT = f"""
WITH src AS (SELECT l_orderkey AS key_col, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS qty FROM lineitem),
tgt AS ({LINEITEM_TARGET_BASE} UNION ALL SELECT * FROM ({LINEITEM_TARGET_BASE}) b WHERE key_col % 113 = 0),
numbered AS (SELECT 1 AS side, *, row_number() OVER (PARTITION BY key_col, l_linenumber, qty) AS c FROM src
  UNION ALL SELECT 2, *, row_number() OVER (PARTITION BY key_col, l_linenumber, qty) FROM tgt),
left0 AS MATERIALIZED (SELECT row_number() OVER () AS id, * EXCLUDE (c) FROM numbered QUALIFY count(*) OVER (PARTITION BY key_col, l_linenumber, qty, c) = 1),
{_alignment_round(0, ", l_linenumber")}{_alignment_round(1, ", qty")}{_alignment_round(2, "")}
lines AS (SELECT key_col, l1, q1, l2, q2 FROM p0 UNION ALL SELECT key_col, l1, q1, l2, q2 FROM p1 UNION ALL SELECT key_col, l1, q1, l2, q2 FROM p2
  UNION ALL SELECT key_col, CASE WHEN side = 1 THEN l_linenumber END, CASE WHEN side = 1 THEN qty END, CASE WHEN side = 2 THEN l_linenumber END,
    CASE WHEN side = 2 THEN qty END FROM left3)
SELECT CAST(key_col AS VARCHAR) AS key_col, CASE WHEN l2 IS NULL THEN 'missing_in_target' WHEN l1 IS NULL THEN 'extra_in_target' ELSE 'value_mismatch' END AS row_type,
  CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL THEN concat_ws(',', CASE WHEN l1 <> l2 THEN 'l_linenumber' END, CASE WHEN q1 <> q2 THEN 'qty' END) END AS changed_columns,
  CAST(l1 AS VARCHAR) AS l_linenumber_source, CAST(l2 AS VARCHAR) AS l_linenumber_target, {text_dec('q1')} AS qty_source, {text_dec('q2')} AS qty_target,
  count(*) AS n_rows FROM lines GROUP BY key_col, l1, q1, l2, q2"""

# ---------------------------------------------------------------- keys and references of several columns

_COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}


def _every_combination() -> str:
    parts = []
    for t, names in _COLUMNS.items():
        for size in (1, 2, 3):
            for cols in itertools.combinations(names.split(), size):
                tup = f"({', '.join(cols)})" if size > 1 else cols[0]
                null = " OR ".join(f"{c} IS NULL" for c in cols)
                parts.append(f"SELECT '{t}' AS table_name, {list(cols)} AS cols, {size} AS key_size, count(*) AS n_rows, "
                             f"count(*) > 0 AND count(DISTINCT {tup}) = count(*) AND count(*) FILTER ({null}) = 0 AS uniq FROM {t}")
    return " UNION ALL ".join(parts)


SKETCHED_PROFILE = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, "
    f"count(*) > 0 AND count(DISTINCT {c}) = count(*) AS is_key_candidate FROM {t}" for t in ("orders", "lineitem") for c in _COLUMNS[t].split())
_TEXTS = "name brand type segment status priority flag linestatus date".split()
FOOTER_STATISTICS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_values, "
    + ("NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value" if c.endswith(tuple(_TEXTS)) else f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value")
    + f" FROM {t}" for t, names in _COLUMNS.items() for c in names.split())

COMPOSITE_KEYS = f"""
WITH u AS MATERIALIZED ({_every_combination()}), k AS (SELECT * FROM u WHERE uniq)
SELECT table_name, array_to_string(cols, ',') AS key_columns, key_size, n_rows FROM k
WHERE NOT EXISTS (SELECT 1 FROM k s WHERE s.table_name = k.table_name AND s.key_size < k.key_size AND list_has_all(k.cols, s.cols))
"""

_REFERENCES = {  # table: columns with their kind (integer or text)
    "customer": "c_custkey:i c_name:t c_nationkey:i c_mktsegment:t", "nation": "n_nationkey:i n_name:t n_regionkey:i",
    "supplier": "s_suppkey:i s_name:t s_nationkey:i", "order_line": "order_no:i line_no:i", "parcel": "ref_a:i ref_b:i maker:i",
}


def _every_pair() -> str:
    cols = {t: [tuple(x.split(":")) for x in names.split()] for t, names in _REFERENCES.items()}
    parts = []
    for ct, pt in itertools.product(cols, repeat=2):
        for size in (1, 2) if ct != pt else (1,):
            for child in itertools.combinations(cols[ct], size):
                for parent in itertools.permutations(cols[pt], size):
                    if [k for _, k in child] != [k for _, k in parent] or (ct == pt and child == parent):
                        continue
                    c, p = ([x for x, _ in side] for side in (child, parent))
                    parts.append(
                        f"SELECT '{ct}' AS child_table, '{','.join(c)}' AS child_columns, '{pt}' AS parent_table, '{','.join(p)}' AS parent_columns, "
                        f"{size} AS n_columns, (SELECT count(DISTINCT ({', '.join(c)})) FROM {ct}) AS child_distinct, "
                        f"(SELECT count(*) = count(DISTINCT ({', '.join(p)})) FROM {pt}) AS parent_unique, "
                        f"(SELECT count(*) FROM (SELECT {', '.join(c)} FROM {ct} EXCEPT SELECT {', '.join(p)} FROM {pt})) AS orphans")
    return " UNION ALL ".join(parts)


INCLUSION_PAIRS = f"""
WITH order_line AS MATERIALIZED (SELECT DISTINCT l_orderkey AS order_no, l_linenumber AS line_no FROM lineitem),
parcel AS MATERIALIZED (SELECT l_orderkey AS ref_a, l_linenumber AS ref_b, l_suppkey AS maker FROM lineitem WHERE l_returnflag = 'R')
SELECT * EXCLUDE (orphans) FROM ({_every_pair()}) WHERE orphans = 0 AND child_distinct > 0
"""

ORACLE_SQL = {
    "file_sources_single": FILE_SOURCES_SINGLE,
    "mapping_docs_mixed": MAPPING_DOCS_MIXED,
    "mapping_rule_checks": MAPPING_RULE_CHECKS,
    "checksum_gate_swapped": CHECKSUM_GATE_SWAPPED,
    "scalar_shape_check": SCALAR_SHAPE_CHECK,
    "target_rows_check": TARGET_ROWS_CHECK,
    "keyed_diff_repeated_missing": KEYED_DIFF_REPEATED_MISSING,
    "keyed_diff_orders": KEYED_DIFF_ORDERS,
    "keyed_diff_multi": KEYED_DIFF_MULTI,
    "keyed_diff_dup_keys": DUP_KEY_PAIRS,
    "diff_class_counts": DIFF_CLASS_COUNTS,
    "keyed_diff_check": KEYED_DIFF_CHECK,
    "set_diff_customers": SET_DIFF_CUSTOMERS,
    "set_diff_check": SET_DIFF_CHECK,
    "row_set_diff_parts": ROW_SET_DIFF_PARTS,
    "scalar_row_count": SCALAR_ROW_COUNT,
    "scalar_sum": SCALAR_SUM,
    "checksum_table": CHECKSUM_TABLE,
    "checksum_match": CHECKSUM_MATCH,
    "null_check": NULL_CHECK,
    "duplicate_check": DUPLICATE_CHECK,
    "fk_check": FK_CHECK,
    "fk_orphans": FK_ORPHANS,
    "dq_positive": DQ_POSITIVE,
    "dq_range": DQ_RANGE,
    "dq_enum": DQ_ENUM,
    "dq_len": DQ_LEN,
    "dq_yyyymm": DQ_YYYYMM,
    "xf_md5_key": XF_MD5_KEY,
    "xf_period_key": XF_PERIOD_KEY,
    "xf_net_amount": XF_NET_AMOUNT,
    "xf_case_code": XF_CASE_CODE,
    "xf_substr": XF_SUBSTR,
    "xf_lpad_key": XF_LPAD_KEY,
    "xf_date_parse": XF_DATE_PARSE,
    "xf_cast": XF_CAST,
    "xf_scd2_lookup": XF_SCD2_LOOKUP,
    "xf_scd2_current": XF_SCD2_CURRENT,
    "xf_scd2_asof": XF_SCD2_ASOF,
    "scd2_faults": SCD2_FAULTS,
    "checksum_tree_diff": KEYED_DIFF_ORDERS,
    "keyed_diff_tolerance": KEYED_DIFF_TOLERANCE,
    "keyed_diff_dup_alignment": KEYED_DIFF_DUP_ALIGNMENT,
    "xf_dim_lookup": XF_DIM_LOOKUP,
    "xf_bridge_join": XF_BRIDGE_JOIN,
    "profile_columns": PROFILE_COLUMNS,
    "fk_discovery": FK_DISCOVERY,
    "sketched_profile": SKETCHED_PROFILE,
    "footer_statistics": FOOTER_STATISTICS,
    "composite_keys": COMPOSITE_KEYS,
    "inclusion_pairs": INCLUSION_PAIRS,
    "bridge_discovery": BRIDGE_DISCOVERY,
    "keyed_diff_sample": KEYED_DIFF_SAMPLE,
    "checksum_gate_check": CHECKSUM_GATE_CHECK,
    "set_diff_sample": SET_DIFF_SAMPLE,
    "mapping_suite": MAPPING_SUITE,
    "file_sources": FILE_SOURCES,
    "typed_folder": TYPED_FOLDER,
    "idempotent_append": IDEMPOTENT_APPEND,
    "run_report": RUN_REPORT,
    "schema_columns": SCHEMA_COLUMNS,
    "fused_suite": FUSED_SUITE,
    "batch_results": BATCH_RESULTS,
    "run_summary": RUN_SUMMARY,
    "run_page": RUN_PAGE,
    "pass_rate": PASS_RATE,
    "dashboard": DASHBOARD,
    "related_by_name": RELATED_BY_NAME,
    "report_csv": REPORT_CSV,
    "parse_summary": PARSE_SUMMARY,
    "connector_usage": CONNECTOR_USAGE,
    "source_catalog": SOURCE_CATALOG,
}
