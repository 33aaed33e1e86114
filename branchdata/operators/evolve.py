"""Apply structured schema changes to a table's data.

A branch's changes to one table are a short list of statements; they are
folded on the driver into ONE projection (add with default, drop, rename,
``try_cast`` for a type change), which Spark then runs over the whole table
in a single pass.  Rebase and reset are the same fold over a different list
of changes on a different base.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.changes import ALTER_PARTS, ITEM, LEADING_COMMENTS, OBJECT_SHAPES

SQL_TYPES = {
    "text": "string", "varchar": "string", "char": "string", "int": "int", "integer": "int",
    "int4": "int", "bigint": "bigint", "int8": "bigint", "smallint": "smallint",
    "boolean": "boolean", "bool": "boolean", "real": "float", "double": "double",
    "float8": "double", "numeric": "decimal(38,18)", "decimal": "decimal(38,18)",
    "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "json": "string", "jsonb": "string", "uuid": "string", "bytea": "binary",
}


@dataclass(frozen=True)
class Change:
    op: str
    table: str | None
    column: str | None
    detail: str | None
    default: str | None
    sql: str


#: statements on a table that leave its columns and rows as they are
NO_DATA_CHANGE = ("create_index", "drop_index")


def _strip(sql: str) -> str:
    return re.sub(LEADING_COMMENTS, "", sql.strip()).strip()


def actions(sql: str) -> list[str]:
    """The single actions of a statement (see ``statement_actions``)."""
    body = _strip(sql).rstrip("; \t\r\n")
    m = re.search(ALTER_PARTS, body)
    items = [x.group(0).strip() for x in re.finditer(ITEM, m.group(2))] if m else []
    return [m.group(1) + x for x in items] if len(items) > 1 else [body]


def parse(sql: str) -> Change:
    body = _strip(sql)
    for op, rx, g_t, g_c, g_d in OBJECT_SHAPES:
        m = re.search(rx, body)
        if m:
            def grp(g):
                return m.group(g).replace('"', "").lower() if g else None
            default = None
            if op == "add_column":
                d = re.search(r"(?i)\bDEFAULT\s+(.+)$", body)
                default = re.sub(r"(?i)\s+(not\s+)?null\s*$", "", d.group(1).strip()) if d else None
            # the whole column type: precision, zone and array marks included
            whole = {"add_column": r"(?i)\bADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?\"?\w+\"?\s+(.+)$",
                     "alter_type": r"(?i)\bTYPE\s+(.+?)(?:\s+USING\b.*)?$"}.get(op)
            d = re.search(whole, body.rstrip("; \n")) if whole else None
            return Change(op, grp(g_t) and grp(g_t).rsplit(".", 1)[-1], grp(g_c), d.group(1) if d else grp(g_d), default, sql)
    return Change("other", None, None, None, None, sql)


def spark_type(sql_type: str) -> str:
    """The Spark type of a column type; precision and scale, time zones and
    arrays are kept.  An unknown type raises."""
    t = re.sub(r"\s+", " ", re.sub(r"(?i)\b(not\s+)?null\b.*$", "", sql_type).strip().lower()) or "text"
    if t.endswith("[]"):
        return f"array<{spark_type(t[:-2])}>"
    if m := re.match(r"(?:numeric|decimal) ?\( ?(\d+) ?(?:, ?(\d+) ?)?\)", t):
        return f"decimal({m[1]},{m[2] or 0})"
    base = re.match(r"\w+", t)
    name = base[0] if base else t
    if name == "timestamp" and "with time zone" in t:
        return "timestamp"
    if name == "character":
        name = "varchar"
    if name not in SQL_TYPES:
        raise ValueError(f"unknown column type: {sql_type}")
    return SQL_TYPES[name]


def fold(df: DataFrame, statements: Sequence[str], table: str | None = None,
         strict: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Fold the changes, action by action, into one ``select``.  Returns the
    new frame and the skipped actions as (sql, reason) - one that conflicts
    with the current shape, or that no column change can express, is skipped
    (or raises with ``strict``); changes of other tables and of indexes have no
    part in it.  Values that don't fit a new type raise when the frame is read
    (ANSI casts): none is lost."""
    cols: list[tuple[str, object]] = [(c, F.col(c)) for c in df.columns]
    skipped: list[tuple[str, str]] = []

    def names():
        return [n.lower() for n, _ in cols]

    for sql in (a for statement in statements for a in actions(statement)):
        ch = parse(sql)
        if ch.op in NO_DATA_CHANGE:
            continue
        if table is not None and ch.table not in (None, table.lower()):
            continue
        reason = None
        if ch.op == "add_column":
            if ch.column in names():
                reason = "column_exists"
            else:
                typ = spark_type(re.sub(r"(?i)\bDEFAULT\b.*$", "", ch.detail or "text"))
                value = F.expr(ch.default).cast(typ) if ch.default else F.lit(None).cast(typ)
                cols.append((ch.column, value))
        elif ch.op == "drop_column":
            if ch.column not in names():
                reason = "dropped_reference"
            else:
                cols = [(n, e) for n, e in cols if n.lower() != ch.column]
        elif ch.op == "rename_column":
            if ch.column not in names():
                reason = "dropped_reference"
            elif ch.detail in names():
                reason = "column_exists"
            else:
                cols = [((ch.detail if n.lower() == ch.column else n), e) for n, e in cols]
        elif ch.op == "alter_type":
            if ch.column not in names():
                reason = "dropped_reference"
            else:
                typ = spark_type(ch.detail or "text")
                cols = [(n, (e.cast(typ) if n.lower() == ch.column else e)) for n, e in cols]
        else:
            reason = "not_a_column_change"
        if reason:
            if strict:
                raise ValueError(f"{reason}: {sql}")
            skipped.append((sql, reason))
    return df.select(*[e.alias(n) for n, e in cols]), skipped


def _complete(folded: tuple[DataFrame, list[tuple[str, str]]]) -> DataFrame:
    out, skipped = folded
    if skipped:
        raise ValueError("; ".join(f"{reason}: {sql}" for sql, reason in skipped))
    return out


def apply_changes(df: DataFrame, statements: Sequence[str], table: str | None = None) -> DataFrame:
    """The changed frame; any change of the table that can't be applied raises
    (``fold`` reports such changes instead)."""
    return _complete(fold(df, statements, table))


def rebase(source: DataFrame, parent_changes: Sequence[str], branch_changes: Sequence[str],
           table: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Rebuild from the source on top of the parent's changes, then replay
    the branch's changes in order; conflicting ones of either are skipped and reported."""
    on_parent, skipped = fold(source, parent_changes, table)
    out, more = fold(on_parent, branch_changes, table)
    return out, skipped + more


def reset(source: DataFrame, statements: Sequence[str], n: int, table: str | None = None) -> DataFrame:
    """Rebuild from the source and replay all but the last ``n`` changes; one
    that can't be applied again raises."""
    return _complete(fold(source, list(statements)[: max(0, len(statements) - n)], table))
