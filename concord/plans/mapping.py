"""Mapping documents -> field mappings -> test cases (MAP-1 .. MAP-5).

A mapping document says which source column becomes which target column by
which rule.  Documents are read by Spark (a folder of them at once); every
line is a row, so a document never has to pass through one task whole.  The
header line of each document is recognised by its column names, which makes
the readers independent of line order and file splitting.

``to_checks`` turns the field mappings into test cases whose SQL runs on the
session's views (source and target tables registered side by side) and
which ``concord.plans.suite.run_cases`` executes.  The reference has a
language model write that SQL; here each rule text is translated by a fixed
set of patterns (``rule_to_sql``), and a rule outside them keeps the source
column unchanged and is flagged ``manual`` in ``validation_status``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dq
from ..sources.files import DELIMITER_CANDIDATES
from .suite import validate_sql

# Mapping-document header names and the field each one fills.
HEADER_ALIASES = {
    "mapid": "map_id", "map id": "map_id", "indicator": "map_id", "id": "map_id",
    "src table": "source_table", "source table": "source_table",
    "src field": "source_column", "source field": "source_column", "source column": "source_column",
    "pg type": "source_type", "src type": "source_type", "source type": "source_type",
    "rule/transform": "transformation", "rule": "transformation", "transform": "transformation",
    "transformation": "transformation",
    "tgt table": "target_table", "target table": "target_table",
    "tgt field": "target_column", "target field": "target_column", "target column": "target_column",
    "mysql type": "target_type", "tgt type": "target_type", "target type": "target_type",
    "key": "is_key",
    "dq rule": "dq_rule", "dq": "dq_rule",
    "notes": "test_notes", "test notes": "test_notes",
}
FIELDS = ["map_id", "source_table", "source_column", "source_type", "transformation", "target_table",
          "target_column", "target_type", "is_key", "dq_rule", "test_notes"]
# Cell texts read as "no value", and the dash rows of pipe tables.
NULL_TOKENS = ["nan", "NaN", "None", "null", "NULL"]
DASH_ROW = r"^[ \-|]+$"
SINGLE_PIPE = r"(?<!\|)\|(?!\|)"
TRUE_KEYS = ["y", "yes", "true", "1"]
DIRECT = "DIRECT"
NO_HEADER_ERROR = "no line of the document holds two known header names"
DIMENSION_NAME = r"(?i)(^dim_|_dim$|^d_|dimension)"


def _clean_cell(c: Column) -> Column:
    """MAP-3: trim, and a whole-cell null token becomes ''."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.isin(*NULL_TOKENS), F.lit("")).otherwise(t)


def clean_rows(rows: DataFrame) -> DataFrame:
    """MAP-3 over a frame of mapping rows: every text column trimmed, null tokens -> ''."""
    return rows.select(*[_clean_cell(F.col(f"`{f.name}`")).alias(f.name)
                         if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
                         for f in rows.schema.fields])


def _from_cell_arrays(lines: DataFrame) -> DataFrame:
    """``document, cells`` (array of cleaned text) -> one row per mapping row.

    The header line of a document is the line with the most known header
    names; cells of the other lines are picked by the header's positions.  A
    document without a line of two known names gives one row with ``error``.
    """
    known = F.array(*[F.lit(k) for k in HEADER_ALIASES])
    lower = F.transform("cells", lambda x: F.lower(x))
    hits = F.size(F.array_intersect(lower, known))
    scored = lines.withColumn("__hits", hits)
    header = scored.groupBy("document").agg(F.max_by("cells", "__hits").alias("__header"), F.max("__hits").alias("__h"))
    known_header = F.col("__h") >= 2
    # A short row a document: the lines stay where they are read.
    rows = scored.join(F.broadcast(header), "document").where(known_header & (F.col("cells") != F.col("__header")))
    hdr_lower = F.transform("__header", lambda x: F.lower(x))
    out = [F.col("document")]
    for field in FIELDS:
        names = [k for k, v in HEADER_ALIASES.items() if v == field]
        found = [F.array_position(hdr_lower, F.lit(n)) for n in names]
        pos = F.greatest(*found) if len(found) > 1 else found[0]
        out.append(F.when(pos > 0, F.get("cells", pos.cast("int") - 1)).alias(field))
    unknown = header.where(~known_header).select(
        "document", *[F.lit(None).cast("string").alias(f) for f in FIELDS], F.lit(NO_HEADER_ERROR).alias("error"))
    return rows.select(*out, F.lit(None).cast("string").alias("error")).unionByName(unknown)


def _documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``document, text`` of every file (mapping documents are written by hand: small)."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("document"), F.col("value").alias("text"))


def _document_shapes(docs: DataFrame) -> list:
    """(document, is it a pipe table, delimiter, most cells of a line) of each document; the
    delimiter from its own first line that is not blank."""
    candidates = DELIMITER_CANDIDATES

    def shapes(batches):
        for batch in batches:
            out = []
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                lines = re.split("\r\n|\r|\n", text)
                first = next((x for x in lines if x.strip(" ")), "")
                sep = max(candidates, key=first.count)  # the first of equals
                out.append((document, text.lstrip(" ").startswith("|"), sep, 1 + max(x.count(sep) for x in lines)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["document", "pipe", "sep", "width"])

    rows = docs.mapInArrow(shapes, "document string, pipe boolean, sep string, width bigint")
    return rows.collect()  # one small row a document


def read_delimited(spark: SparkSession, path: str | list[str], delimiter: str | None = None) -> DataFrame:
    """MAP-1: CSV / TSV mapping documents (a file or a folder).  Every document is
    read with its own delimiter (its first line decides, unless given), its own
    header and as many cells as its longest line has; quoted cells may hold
    the delimiter, line breaks and non-ASCII text.  Documents without a known
    header come back as rows with ``error``."""
    return _delimited(spark, _document_shapes(_documents(spark, path)), delimiter)


def _delimited(spark: SparkSession, shapes: list, delimiter: str | None = None) -> DataFrame:
    by_shape: dict[str, list] = {}
    for r in shapes:
        by_shape.setdefault(delimiter or r["sep"], []).append(r)
    lines = spark.createDataFrame([], "document string, cells array<string>")
    for sep, docs in sorted(by_shape.items()):
        width = max(r["width"] for r in docs)
        names = [f"c{i}" for i in range(width)]
        raw = (spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", sep).option("quote", '"').option("escape", '"')
               .option("header", False).option("multiLine", True).option("encoding", "UTF-8").csv([r["document"] for r in docs]))
        cells = F.array(*[_clean_cell(F.col(c)) for c in names])
        lines = lines.unionByName(raw.select(F.col("_metadata.file_path").alias("document"), cells.alias("cells")))
    return field_mappings(_from_cell_arrays(lines.where(F.exists("cells", lambda x: x != F.lit("")))))


def read_pipe_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """MAP-2: pipe-table documents (markdown style).  Blank and dash rows are
    dropped, outer pipes stripped, cells split on single pipes only, so a
    ``||`` inside a rule stays in its cell."""
    text = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("document"),
                                                                  F.trim("value").alias("line"))
    text = text.where((F.col("line") != "") & ~F.col("line").rlike(DASH_ROW))
    inner = F.regexp_replace("line", r"^\|+|\|+$", "")
    cells = F.transform(F.split(inner, SINGLE_PIPE), lambda x: _clean_cell(x))
    return field_mappings(_from_cell_arrays(text.select("document", cells.alias("cells"))))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """``.txt`` documents: pipe tables where the first line starts with a pipe,
    else delimited - each document by itself."""
    shapes = _document_shapes(_documents(spark, path))  # the one pass over whole texts
    pipes, others = [r["document"] for r in shapes if r["pipe"]], [r for r in shapes if not r["pipe"]]
    if not pipes:
        return _delimited(spark, others)
    return read_pipe_tables(spark, pipes).unionByName(_delimited(spark, others)) if others else read_pipe_tables(spark, pipes)


def field_mappings(rows: DataFrame) -> DataFrame:
    """MAP-4: defaults of a field mapping: transformation ``DIRECT`` when empty,
    ``target_sql_expr`` = target column, ``is_key`` as boolean, empty text as NULL."""
    def txt(c):
        return F.when(F.col(c) != "", F.col(c))
    return rows.select(
        "document",
        txt("map_id").alias("map_id"),
        txt("source_table").alias("source_table"),
        txt("source_column").alias("source_column"),
        txt("source_type").alias("source_type"),
        F.coalesce(txt("transformation"), F.lit(DIRECT)).alias("transformation"),
        txt("target_table").alias("target_table"),
        txt("target_column").alias("target_column"),
        txt("target_type").alias("target_type"),
        F.coalesce(F.lower(F.col("is_key")).isin(*TRUE_KEYS), F.lit(False)).alias("is_key"),
        txt("dq_rule").alias("dq_rule"),
        txt("test_notes").alias("test_notes"),
        txt("target_column").alias("target_sql_expr"),
        *([F.col("error")] if "error" in rows.columns else []),
    )


# ---------------------------------------------------------------- rule text -> SQL

def _decimal_cast(expr: str, target_type: str | None) -> str:
    m = re.match(r"(?i)^\s*(decimal|numeric)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", target_type or "")
    return f"CAST({expr} AS DECIMAL({m.group(2)},{m.group(3)}))" if m else expr


def _code_map(body: str, column: str) -> str | None:
    pairs = re.findall(r"'([^']*)'\s*(?:→|->|=>|=)\s*('?[^,']*'?)", body)
    if not pairs:
        return None
    whens = " ".join(f"WHEN '{k}' THEN {v.strip()}" for k, v in pairs)
    return f"CASE {column} {whens} END"


def rule_to_sql(rule: str | None, source_column: str, target_type: str | None = None,
                computed: Mapping[str, str] | None = None) -> str | None:
    """Source-side SQL expression for a transformation rule, or None when the
    rule is a lookup (a join, see ``to_checks``) or not understood.

    Patterns: ``DIRECT``; ``MD5(a+b)`` (``+`` joins text); ``CASE 'A'→1, ...``;
    ``YEAR(d)*100+MONTH()`` (an empty call takes the source column);
    ``SUBSTR``/``LPAD``/arithmetic as written; ``'P' || col``.  Names of
    other target columns of the same table (``computed``) are replaced by
    their own source expressions, so ``(1-disc)*gross_amt`` works.  A
    numeric result is cast to a DECIMAL target type (half-up rounding).
    """
    r = (rule or "").strip()
    if not r or r.upper() == DIRECT:
        return source_column
    if re.search(r"(?i)\blookup\b|\bjoin\b", r):
        return None
    r = re.sub(r"::\s*\w+(\s*\(\s*\d+\s*(,\s*\d+\s*)?\))?", "", r)  # drop PostgreSQL casts
    m = re.match(r"(?i)^case\s+(.*)$", r)
    if m and "when" not in r.lower():
        return _code_map(m.group(1), source_column)
    m = re.match(r"(?i)^md5\s*\((.*)\)$", r)
    if m:
        parts = [p.strip() for p in m.group(1).split("+")]
        return f"md5(concat({', '.join(f'CAST({p} AS STRING)' for p in parts)}))"
    r = re.sub(r"(?i)\b(year|month|day)\s*\(\s*\)", lambda x: f"{x.group(1)}({source_column})", r)
    for name, expr in (computed or {}).items():
        r = re.sub(rf"\b{re.escape(name)}\b", f"({expr})", r)
    if re.search(r"[*/+-]", r) and not re.search(r"(?i)\b(substr|lpad|rpad|concat)\b|\|\|", r):
        return _decimal_cast(r, target_type)
    return r


# ---------------------------------------------------------------- MAP-5 checks

CIRCLE = ": its rule and those it uses wait for one another"


def _columns_of(tables: Mapping[str, DataFrame]) -> dict[str, set[str]]:
    return {t: {c.lower() for c in df.columns} for t, df in tables.items()}


def _lookup_join(fm: dict, tables: Mapping[str, DataFrame]) -> tuple[str, str] | None:
    """For a lookup rule: (FROM clause, value expression) joining the table
    that holds both the source column and the target column.  A table with
    ``valid_from``/``valid_to`` is joined as of the first DATE column of the
    source table (start inclusive, end exclusive)."""
    cols = _columns_of(tables)
    src, sc, tc = fm["source_table"], fm["source_column"].lower(), fm["target_column"].lower()
    named = [t for t in sorted(cols, key=len, reverse=True) if re.search(rf"\b{re.escape(t)}\b", fm["transformation"] or "", re.I)]
    for t in [*named, *(t for t in sorted(cols) if t not in named)]:  # a table named in the rule goes first
        names = cols[t]
        if t == src or sc not in names or tc not in names:
            continue
        on = f"s.{sc} = d.{sc}"
        if {"valid_from", "valid_to"} <= names:
            dates = [f.name for f in tables[src].schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
            told = [d for d in dates if re.search(rf"\b{re.escape(d)}\b", fm["transformation"] or "", re.I)] or dates
            if told:
                on += (f" AND s.{told[0]} >= d.valid_from"
                       f" AND (d.valid_to IS NULL OR s.{told[0]} < d.valid_to)")
        return f"{src} s LEFT JOIN {t} d ON {on}", f"d.{tc}"
    return None


def _parent_of(rule: str, row: Mapping, tables: Mapping[str, DataFrame], keys: Mapping[str, str],
               foreign_keys: Mapping[tuple[str, str], tuple[str, str]]) -> tuple[str, str] | None:
    """(parent table, its key column) of a referential rule: the table named in the
    rule with the column of the child's name or its declared key; else the
    discovered foreign key; else the one other table, not the mapping's own
    source, with a column of that name.  None if that does not decide it."""
    tt, tc = row["target_table"], row["target_column"]
    cols = _columns_of(tables)
    named = dq.FK_RULE.match(rule.strip()).group("table")
    if named:
        t = next((x for x in tables if x.lower() == named.lower()), None)
        if t is None:
            return None
        return (t, tc) if tc.lower() in cols[t] else (t, keys[t]) if t in keys else None
    if (tt, tc) in foreign_keys:
        return foreign_keys[tt, tc]
    found = [t for t in cols if t not in (tt, row["source_table"]) and tc.lower() in cols[t]]
    return (found[0], tc) if len(found) == 1 else None


def _orphan_sql(child: str, column: str, parent: str, key: str) -> str:
    """Rows without a parent, counted over distinct child values (a hot key is one
    row before it meets the parent); NULL has no parent."""
    return (f"SELECT coalesce(sum(c.cnt), 0) AS cnt FROM (SELECT {column} AS k, count(*) AS cnt FROM {child} GROUP BY {column}) c "
            f"LEFT JOIN (SELECT DISTINCT {key} AS k, true AS present FROM {parent}) p ON c.k = p.k WHERE p.present IS NULL")


def _to_target(expr: str, target_type: str | None) -> str:
    """The source value in the target's type, so both sides are compared alike."""
    t = (target_type or "").strip().lower()
    m = re.match(r"(decimal|numeric)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", t)
    kind = (f"DECIMAL({m.group(2)},{m.group(3)})" if m else "BIGINT" if re.match(r"(tiny|small|big)?int(eger)?\b", t)
            else "DATE" if t == "date" else None)
    return f"TRY_CAST({expr} AS {kind})" if kind else expr


def _dependencies(rows: list[dict], tables: Mapping[str, DataFrame]) -> dict[int, set[int]]:
    """Of each row the rows whose target column its rule names: columns of the same target
    table, but for its own and those that the source table has itself."""
    made: dict[str, dict[str, int]] = {}
    for i, r in enumerate(rows):
        made.setdefault(r["target_table"], {}).setdefault(r["target_column"].lower(), i)
    cols = _columns_of(tables)
    out = {}
    for i, r in enumerate(rows):
        words = {w.lower() for w in re.findall(r"[A-Za-z_]\w*", r["transformation"] or "")}
        words -= cols.get(r["source_table"], set()) | {r["target_column"].lower()}
        out[i] = {made[r["target_table"]][w] for w in words if w in made[r["target_table"]]}
    return out


def in_rule_order(rows: list[dict], tables: Mapping[str, DataFrame]) -> tuple[list[int], set[int]]:
    """(row numbers, each after the rows whose columns its rule uses; rows that wait for
    one another in a circle, or for such rows).  Rows that could go next keep the document's order."""
    waits = _dependencies(rows, tables)
    order: list[int] = []
    done: set[int] = set()
    while True:
        free = next((i for i in waits if i not in done and waits[i] <= done), None)
        if free is None:
            return order, waits.keys() - done
        order.append(free)
        done.add(free)


def to_checks(field_rows: list[Mapping], tables: Mapping[str, DataFrame],
              identity: Mapping[str, str] | None = None, keys: Mapping[str, str] | None = None,
              foreign_keys: Mapping[tuple[str, str], tuple[str, str]] | None = None) -> list[dict]:
    """MAP-5: field mappings (rows of ``field_mappings``, metadata-sized) ->
    test cases ``{id, name, type, source_sql, target_sql, description,
    validation_status}``.

    * one ``value_match`` per row: keyed on the target table's identity
      (``identity`` or its first ``Key=Y`` row) when the target is not a
      dimension and the row reads the identity row's source table; otherwise a
      DISTINCT value-set comparison;
    * one ``row_count`` per source/target table pair;
    * for every rule of the DQ cell: ``null_check`` for NOT NULL, ``dq_check`` for
      a predicate, ``duplicate_check`` for a unique rule, an FK check for a
      referential one (parents from the rule, ``foreign_keys`` - such as
      PRF-3 finds - or ``keys``, the key column of a parent);
    * ``duplicate_check`` for the identity column (other Key=Y columns are
      foreign keys and may repeat).

    A rule may use columns that other rows compute, wherever they stand in the
    document; rules that wait for one another in a circle are ``manual``.
    Nothing of a document is left out: a rule or a document that is not
    understood gives an inactive case with status ``manual``.  Statements are
    analysed against the session's views; one that fails is ``invalid`` with
    the error in its description.
    """
    unread = [dict(r) for r in field_rows if r.get("error")]
    rows = [dict(r) for r in field_rows if not r.get("error")]
    keys, foreign_keys = keys or {}, foreign_keys or {}
    spark = next(iter(tables.values())).sparkSession if tables else None
    ident: dict[str, dict] = {}
    for r in rows:
        if r.get("is_key") and r["target_table"] not in ident:
            ident[r["target_table"]] = r
    for t, c in (identity or {}).items():
        ident[t] = next(r for r in rows if r["target_table"] == t and r["target_column"] == c)
    computed: dict[str, dict[str, str]] = {}
    order, circular = in_rule_order(rows, tables)
    for i in circular:
        rows[i]["__expr"], rows[i]["__circle"] = None, True
    for r in (rows[i] for i in order):
        e = rule_to_sql(r["transformation"], r["source_column"], r.get("target_type"),
                        computed.get(r["target_table"]))
        r["__expr"] = e
        if e is not None:
            computed.setdefault(r["target_table"], {})[r["target_column"]] = e
    cases: list[dict] = []

    def add(name, ctype, src, tgt, desc, status="valid", kind=None, violation=None, compared=None):
        for sql in (src, tgt) if status == "valid" and spark is not None else ():
            told, error = validate_sql(spark, sql)
            if told != "valid":
                status, desc = told, f"{desc}: {error}"
        cases.append({"id": len(cases) + 1, "name": name, "type": ctype, "source_sql": src, "target_sql": tgt,
                      "violation": violation if status == "valid" else None, "compared": compared if status == "valid" else None,
                      "target_kind": kind, "description": desc, "validation_status": status, "is_active": status != "manual"})

    for r in unread:
        add(f"document {r['document']}", "custom", None, None, r["error"], "manual")

    pairs = []
    for r in rows:
        st, tt, tc = r["source_table"], r["target_table"], r["target_column"]
        if (st, tt) not in pairs:
            pairs.append((st, tt))
        circle = r.get("__circle", False)
        lookup = _lookup_join(r, tables) if r["__expr"] is None and not circle else None
        src_from, val = (lookup if lookup else (st, r["__expr"] or r["source_column"]))
        val = _to_target(val, r.get("target_type"))
        status = "valid" if (r["__expr"] is not None or lookup) else "manual"
        idr = ident.get(tt)
        keyed = (idr is not None and idr["source_table"] == st and not re.search(DIMENSION_NAME, tt)
                 and idr["__expr"] is not None)
        mid = r.get("map_id") or tc
        if keyed:
            alias = "s." if lookup else ""
            key_expr = idr["__expr"]
            if lookup:
                key_expr = re.sub(rf"\b({'|'.join(map(re.escape, tables[st].columns))})\b", r"s.\1", key_expr)
            add(f"{mid} value_match {tt}.{tc}", "value_match",
                f"SELECT {key_expr} AS key_col, {val} AS val FROM {src_from}",
                f"SELECT {idr['target_column']} AS key_col, {tc} AS val FROM {tt}",
                f"keyed comparison on {tt}.{idr['target_column']}{' via ' + alias if lookup else ''}" + CIRCLE * circle, status,
                compared=(src_from, key_expr, tt, idr["target_column"], val, tc))
        else:
            add(f"{mid} value_match {tt}.{tc}", "value_match",
                f"SELECT DISTINCT {val} AS val FROM {src_from} WHERE {r['source_column']} IS NOT NULL"
                if not lookup else f"SELECT DISTINCT {val} AS val FROM {src_from}",
                f"SELECT DISTINCT {tc} AS val FROM {tt}", "value-set comparison" + CIRCLE * circle, status)
        rules = dq.rule_parts(r.get("dq_rule"))
        for kind, rule in rules:
            told = f" ({rule})" if len(rules) > 1 else ""
            pred = dq.rule_sql(rule, tc) if kind == "predicate" else None
            parent = _parent_of(rule, r, tables, keys, foreign_keys) if kind == "fk" else None
            if pred == f"{tc} IS NULL":
                add(f"{mid} null_check {tt}.{tc}", "null_check", None,
                    f"SELECT COUNT(*) AS cnt FROM {tt} WHERE {tc} IS NULL", "NOT NULL", kind="count", violation=(tt, pred))
            elif pred:
                add(f"{mid} dq_check {tt}.{tc}{told}", "dq_check", None,
                    f"SELECT COUNT(*) AS cnt FROM {tt} WHERE {pred}", f"rule: {rule}", kind="count", violation=(tt, pred))
            elif parent:
                add(f"{mid} fk_check {tt}.{tc}", "dq_check", None, _orphan_sql(tt, tc, *parent),
                    f"referential integrity to {parent[0]}.{parent[1]}", kind="count")
            elif kind != "unique":
                add(f"{mid} {kind} {tt}.{tc}{told}", "dq_check", None, None, f"rule not understood: {rule}", "manual")
            elif idr is not r:
                add(f"{mid} duplicate_check {tt}.{tc}", "duplicate_check", None,
                    f"SELECT {tc}, COUNT(*) AS cnt FROM {tt} GROUP BY {tc} HAVING COUNT(*) > 1", "must be unique", kind="rows")
        if idr is r:
            add(f"{mid} duplicate_check {tt}.{tc}", "duplicate_check", None,
                f"SELECT {tc}, COUNT(*) AS cnt FROM {tt} GROUP BY {tc} HAVING COUNT(*) > 1",
                "identity column must be unique", kind="rows")
    for st, tt in pairs:
        add(f"row_count {st} -> {tt}", "row_count", f"SELECT COUNT(*) AS cnt FROM {st}",
            f"SELECT COUNT(*) AS cnt FROM {tt}", "row counts of the table pair")
    return cases


def checks_frame(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """Test cases as a DataFrame (the reference's test-case table)."""
    schema = ("id int, name string, type string, source_sql string, target_sql string, "
              "description string, validation_status string, is_active boolean")
    return spark.createDataFrame([(c["id"], c["name"], c["type"], c["source_sql"], c["target_sql"], c["description"],
                                   c["validation_status"], c.get("is_active", True)) for c in cases], schema)

