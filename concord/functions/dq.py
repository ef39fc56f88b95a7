"""Data-quality rule vocabulary (DQ-1 .. DQ-7) as violation predicates.

Every builder returns a boolean ``Column`` that is TRUE for a violating row.
SQL three-valued logic is kept on purpose: ``NOT (c > 0)`` is NULL when ``c``
is NULL, and ``count_if`` does not count NULL, so a NULL value violates only
the NOT NULL rule - the same answer as ``COUNT(*) WHERE NOT (cond)``.

``rule_predicate`` maps free rule text (as written in a mapping document) to
one of these builders.  Referential rules (``FK EXISTS``, "must exist in t")
are not row predicates; they are answered by an anti join, see
``concord.operators.checks.fk_check``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a YYYYMM period key, months 01-12.
YYYYMM_PATTERN = r"^[0-9]{4}(0[1-9]|1[0-2])$"


def _number(text: str):
    return float(text) if "." in text else int(text)


def _sql_literal(v) -> str:
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def _enum_values(body: str):
    items = [x.strip().strip("'\"") for x in re.split(r"[,;/]", body) if x.strip()]
    return [_number(x) if re.fullmatch(r"-?\d+(\.\d+)?", x) else x for x in items]


def _in_list(body: str) -> str | None:
    """Violation of "one of these": an integer range ``1-5`` as bounds and a test for
    whole numbers, else the listed values; None for a range of anything else."""
    m = re.fullmatch(r"\s*(-?\d+)\s*-\s*(-?\d+)\s*", body)
    if m:
        return f"NOT ({{c}} BETWEEN {m.group(1)} AND {m.group(2)} AND {{c}} = floor({{c}}))"
    if re.fullmatch(r"\s*\w+\s*-\s*\w+\s*", body):
        return None
    return f"NOT ({{c}} IN ({', '.join(_sql_literal(v) for v in _enum_values(body))}))"


_NUM = r"(-?\d+(?:\.\d+)?)"

# Rule text -> violation predicate as SQL text over the column ``{c}``.
# Each entry: (regex, factory(match) -> template).  One table serves both
# the Column predicates and the SQL of generated test cases.
_RULES: list[tuple[str, Callable]] = [
    (r"^(not\s+null|required|mandatory)$", lambda m: "{c} IS NULL"),
    (r"^(>\s*0|must\s+be\s+positive|positive)$", lambda m: "NOT ({c} > 0)"),
    (r"^yyyymm$", lambda m: "NOT (CAST({c} AS STRING) RLIKE '" + YYYYMM_PATTERN + "')"),
    (rf"^{_NUM}\s*-\s*{_NUM}\s*range$",
     lambda m: f"NOT ({{c}} BETWEEN {m.group(1)} AND {m.group(2)})"),
    (rf"^(?:between\s+)?{_NUM}\s+(?:and|to)\s+{_NUM}$",
     lambda m: f"NOT ({{c}} BETWEEN {m.group(1)} AND {m.group(2)})"),
    (r"^in\s*\((.+)\)$", lambda m: _in_list(m.group(1))),
    (r"^enum\s+(.+)$", lambda m: _in_list(m.group(1))),
    (r"^values?\s+(.+)$", lambda m: _in_list(m.group(1))),
    (r"^(?:len|length)\s*(?:≤|<=)\s*(\d+)$", lambda m: f"char_length(CAST({{c}} AS STRING)) > {m.group(1)}"),
    (r"^max\s+length\s+(\d+)$", lambda m: f"char_length(CAST({{c}} AS STRING)) > {m.group(1)}"),
    (rf"^(?:>=|≥)\s*{_NUM}$", lambda m: f"NOT ({{c}} >= {m.group(1)})"),
    (rf"^>\s*{_NUM}$", lambda m: f"NOT ({{c}} > {m.group(1)})"),
    (rf"^(?:<=|≤)\s*{_NUM}$", lambda m: f"NOT ({{c}} <= {m.group(1)})"),
    (rf"^<\s*{_NUM}$", lambda m: f"NOT ({{c}} < {m.group(1)})"),
]

FK_RULE = re.compile(r"^(fk\s+exists|must\s+exist\s+in\s+(?P<table>[\w.]+))$", re.IGNORECASE)


UNIQUE_RULE = re.compile(r"^(unique|no\s+duplicates?|must\s+be\s+unique)$", re.IGNORECASE)


def rule_kind(text: str | None) -> str | None:
    """'fk', 'unique', 'predicate' or None (empty / not understood)."""
    if not text or not text.strip():
        return None
    t = text.strip()
    if FK_RULE.match(t):
        return "fk"
    if UNIQUE_RULE.match(t):
        return "unique"
    return "predicate" if rule_sql(t, "x") is not None else None


def _cut(text: str, mark: str) -> list[str]:
    """Split at ``mark`` (a pattern) outside brackets and quotes."""
    held = re.findall(r"\([^()]*\)|'[^']*'", text)
    for i, x in enumerate(held):
        text = text.replace(x, f"\x00{i}\x00", 1)
    parts = re.split(mark, text, flags=re.IGNORECASE)
    return [re.sub(r"\x00(\d+)\x00", lambda m: held[int(m.group(1))], x).strip() for x in parts]


def rule_parts(text: str | None) -> list[tuple[str, str]]:
    """(kind, rule) of every rule in a cell: the whole cell if it is one rule, else
    its parts at ``;``, then ``and``, then ``,``.  A part that is no rule is
    ``unknown``; nothing of the cell is left out."""
    if not text or not text.strip():
        return []
    if whole := rule_kind(text):
        return [(whole, text.strip())]
    for mark in (";", r"\band\b", ","):
        parts = [x for x in _cut(text, mark) if x]
        if len(parts) > 1:
            return [y for x in parts for y in rule_parts(x)]
    return [("unknown", text.strip())]


def rule_sql(text: str, column: str) -> str | None:
    """Violation predicate of a rule text as Spark SQL over ``column``, or None."""
    t = re.sub(r"\s+", " ", text.strip())
    for pattern, factory in _RULES:
        m = re.match(pattern, t, re.IGNORECASE)
        if m:
            found = factory(m)
            return found.replace("{c}", column) if found else None
    return None


def rule_predicate(text: str) -> Callable[[str], Column] | None:
    """Violation predicate builder for a rule text (takes a column name), or
    None if the text is not understood."""
    if rule_sql(text, "x") is None:
        return None

    def build(column: str) -> Column:
        if not isinstance(column, str):
            raise TypeError("rule predicates bind a column name; add the expression as a column first")
        return F.expr(rule_sql(text, f"`{column}`"))
    return build
