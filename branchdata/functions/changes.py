"""Column functions over recorded change statements.

All of them are ``when`` chains, ``rlike`` and ``regexp_extract`` over the
statement text: pattern shapes, not a SQL parser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (CONFLICT_CLASSES, DDL_PREFIXES, DDL_PREFIXES_EXTENDED,
                         SEED_MARKER)
from .text import trim_ws


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ddl_regex(extended: bool = False) -> str:
    prefixes = DDL_PREFIXES + (DDL_PREFIXES_EXTENDED if extended else ())
    return "^(" + "|".join(prefixes) + ")"


def change_type(sql, marker: str = SEED_MARKER, extended: bool = False) -> Column:
    """seed if the marker occurs anywhere; ddl if the trimmed, upper-cased
    text starts with a ddl prefix; test otherwise."""
    s = _c(sql)
    return (F.when(s.contains(marker), F.lit("seed"))
             .when(F.upper(trim_ws(s)).rlike(ddl_regex(extended)), F.lit("ddl"))
             .otherwise(F.lit("test")))


def change_description(sql) -> Column:
    """Short description, first matching rule wins; word 3 names the object."""
    t = trim_ws(sql)
    up = F.upper(t)
    words = F.split(t, r"\s+")
    third = F.element_at(words, 3)
    obj = F.lower(third)
    long_text = F.when(F.length(t) > 50, F.concat(F.substring(t, 1, 50), F.lit("..."))).otherwise(t)
    alter = up.startswith("ALTER TABLE")
    return (F.when(F.size(words) < 3, t)
             .when(alter & up.contains("ADD COLUMN"), F.concat(F.lit("add column to "), obj))
             .when(alter & up.contains("DROP COLUMN"), F.concat(F.lit("drop column from "), obj))
             .when(alter & up.contains("RENAME"), F.concat(F.lit("rename in "), obj))
             .when(alter, F.concat(F.lit("alter "), obj))
             .when(up.startswith("CREATE TABLE"), F.concat(F.lit("create table "), obj))
             .when(up.startswith("DROP TABLE"), F.concat(F.lit("drop table "), obj))
             .when(up.startswith("CREATE INDEX"), F.concat(F.lit("create index "), third))
             .when(up.startswith("DROP INDEX"), F.concat(F.lit("drop index "), third))
             .when(up.startswith("INSERT"), F.lit("insert seed data"))
             .when(up.startswith("UPDATE"), F.lit("update data"))
             .otherwise(long_text))


def merge_label(change_type_col) -> Column:
    return F.when(_c(change_type_col).isin("ddl", "seed"), F.lit("travels")).otherwise(F.lit("discarded"))


# --- object extraction ------------------------------------------------------
# (operation, regex on the comment-stripped statement, group of table,
#  group of column, group of second name (new column / new type / index))
# first shape wins.  A statement of several actions, or on a constraint, is
# not read ("other"): the conflict check reports it as unverified.
OBJECT_SHAPES = (
    ("other", r"(?i)^DROP\s+(?:TABLE|INDEX)\s[\s\S]*,", 0, 0, 0),
    ("other", r"(?i)^ALTER\s+TABLE\s[\s\S]*,\s*(?:ADD|DROP|ALTER|RENAME)\s", 0, 0, 0),
    ("other", r"(?i)^ALTER\s+TABLE\s[\s\S]*\s(?:ADD|DROP)\s+(?:CONSTRAINT|PRIMARY|UNIQUE|FOREIGN|CHECK|EXCLUDE)\s", 0, 0, 0),
    ("add_column", r"(?i)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?([\w.\"]+)\s+ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?([\w\"]+)\s*([\s\S]*)$", 1, 2, 3),
    ("drop_column", r"(?i)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?([\w.\"]+)\s+DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?([\w\"]+)", 1, 2, 0),
    ("rename_column", r"(?i)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?([\w.\"]+)\s+RENAME\s+COLUMN\s+([\w\"]+)\s+TO\s+([\w\"]+)", 1, 2, 3),
    ("alter_type", r"(?i)^ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?([\w.\"]+)\s+ALTER\s+COLUMN\s+([\w\"]+)\s+(?:SET\s+DATA\s+)?TYPE\s+(\w+)", 1, 2, 3),
    ("create_table", r"(?i)^CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.\"]+)", 1, 0, 0),
    ("drop_table", r"(?i)^DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?([\w.\"]+)", 1, 0, 0),
    ("create_index", r"(?i)^CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?([\w\"]+)\s+ON\s+([\w.\"]+)", 2, 0, 1),
    ("drop_index", r"(?i)^DROP\s+INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+EXISTS\s+)?([\w.\"]+)", 0, 0, 1),
    ("truncate", r"(?i)^TRUNCATE\s+(?:TABLE\s+)?([\w.\"]+)", 1, 0, 0),
    ("insert", r"(?i)^INSERT\s+INTO\s+([\w.\"]+)", 1, 0, 0),
    ("update", r"(?i)^UPDATE\s+([\w.\"]+)", 1, 0, 0),
    ("delete", r"(?i)^DELETE\s+FROM\s+([\w.\"]+)", 1, 0, 0),
)


#: IF EXISTS on the table an ALTER names; IF [NOT] EXISTS on what a statement makes or drops
TABLE_GUARD = r"(?i)^ALTER\s+TABLE\s+IF\s+EXISTS\s"
OBJECT_GUARD = (r"(?i)^CREATE\s+(?:UNIQUE\s+)?(?:TABLE|INDEX)\s+(?:CONCURRENTLY\s+)?IF\s+NOT\s+EXISTS\s"
                r"|^DROP\s+(?:TABLE|INDEX)\s+(?:CONCURRENTLY\s+)?IF\s+EXISTS\s"
                r"|^ALTER\s+TABLE\s[\s\S]*\s(?:ADD\s+(?:COLUMN\s+)?IF\s+NOT|DROP\s+(?:COLUMN\s+)?IF)\s+EXISTS\s")


LEADING_COMMENTS = r"(?s)^(\s*(/\*.*?\*/|--[^\n]*\n))+"
#: what stands between top-level commas: quoted texts and brackets (three deep) are taken whole
ITEM = (r"(?:[^,'\"()]+|'[^']*(?:''[^']*)*'|\"[^\"]*\""
        r"|\((?:[^()']+|'[^']*(?:''[^']*)*'|\((?:[^()']+|'[^']*(?:''[^']*)*'|\([^()]*\))*\))*\))+")
ALTER_PARTS = r"(?is)^(ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?[\w.\"]+\s+)(.*)$"


def strip_comments(sql) -> Column:
    """Trimmed text without leading /* ... */ and -- comments, of any lines."""
    return trim_ws(F.regexp_replace(trim_ws(sql), LEADING_COMMENTS, ""))


def _name(c: Column) -> Column:
    return F.lower(F.translate(c, '"', ""))


def _bare(c: Column) -> Column:
    """A name without its schema."""
    return F.regexp_replace(_name(c), r"^.*\.", "")


def with_objects(df, sql_col: str = "sql_text", keep_body: bool = False):
    """Add op, table_name, column_name, detail (op 'other' if no shape
    matches; ``detail`` is the new column name, new type, or index name).

    Three small projections instead of one huge one: the comment-free body,
    then the op (each shape's regex guarded by the statement's first word),
    then one ``regexp_extract`` per output chosen by op.  Spark keeps the
    stages apart (regular expressions are not cheap to repeat), and each
    stays small enough for compiled code."""
    body = strip_comments(F.col(sql_col))
    out = df.withColumn("_body", body).withColumn(
        "_first", F.upper(F.regexp_extract(F.col("_body"), r"^(\w+)", 1)))
    b, first = F.col("_body"), F.col("_first")
    op = F.lit("other")
    for name, rx, *_ in reversed(OBJECT_SHAPES):
        keyword = rx.split("^", 1)[1].split("\\", 1)[0]
        op = F.when((first == keyword) & b.rlike(rx), F.lit(name)).otherwise(op)
    out = out.withColumn("op", op)

    def pick(group_index: int) -> Column:
        expr = F.lit(None).cast("string")
        for name, rx, *groups in OBJECT_SHAPES:
            g = groups[group_index]
            if g:
                text = F.regexp_extract(b, rx, g)
                expr = F.when(F.col("op") == name, _bare(text) if group_index == 0 or name == "drop_index"
                              else _name(text)).otherwise(expr)
        return expr
    out = out.withColumns({"table_name": pick(0), "column_name": pick(1), "detail": pick(2)})
    out = out.drop("_first")
    return out if keep_body else out.drop("_body")


def create_columns(sql) -> Column:
    """Column names listed in ``CREATE TABLE t (a INT, b NUMERIC(10, 2))``
    (lower case), over any number of lines."""
    inner = F.regexp_extract(strip_comments(sql), r"(?s)\((.*)\)", 1)
    items = F.regexp_extract_all(inner, F.lit(ITEM), F.lit(0))
    return F.filter(F.transform(items, lambda x: F.lower(F.regexp_extract(trim_ws(x), r"^\"?(\w+)", 1))),
                    lambda x: (x != "") & ~x.isin("primary", "unique", "constraint", "foreign", "check"))


def statement_actions(sql) -> Column:
    """The single actions of a statement, comments off: an ALTER TABLE of
    several is cut at its top-level commas, each action with the statement's
    head; any other statement is one action."""
    body = F.regexp_replace(strip_comments(sql), r"[;\s]+$", "")
    head = F.regexp_extract(body, ALTER_PARTS, 1)
    items = F.regexp_extract_all(F.regexp_extract(body, ALTER_PARTS, 2), F.lit(ITEM), F.lit(0))
    return F.when(F.size(items) > 1, F.transform(items, lambda x: F.concat(head, trim_ws(x)))).otherwise(F.array(body))


ACTION_BITS = 20         # an ALTER TABLE has fewer actions than 2**20


def with_actions(changes):
    """One row per action of every change (branch_id, sequence, sql_text,
    ...): ``action`` counts from 1, ``position`` orders the branch's actions,
    ``sql_text`` is the action's own text."""
    return (changes.select(*[c for c in changes.columns if c != "sql_text"],
                           F.posexplode(statement_actions("sql_text")).alias("_i", "sql_text"))
            .withColumn("action", F.col("_i") + 1)
            .withColumn("position", F.col("sequence").cast("long") * (1 << ACTION_BITS) + F.col("_i")).drop("_i"))


# --- conflicts from error text ---------------------------------------------
def conflict_class(message) -> Column:
    m = F.lower(_c(message))
    exists = m.contains("already exists")
    return (F.when(exists & m.contains("column"), F.lit("column_exists"))
             .when(exists & m.contains("relation"), F.lit("index_exists"))
             .when(exists & m.contains("table"), F.lit("table_exists"))
             .when(m.contains("does not exist"), F.lit("dropped_reference"))
             .when(m.contains("type") & m.contains("cannot"), F.lit("type_mismatch"))
             .otherwise(F.lit("unknown")))


def conflict_details(cls, message) -> list[Column]:
    """description, suggestion, auto_resolvable for a conflict class."""
    c = _c(cls)
    desc = sugg = auto = None
    for name, (d, s, a) in CONFLICT_CLASSES.items():
        cond = c == name
        desc = (F.when(cond, F.lit(d)) if desc is None else desc.when(cond, F.lit(d)))
        sv = F.lit(s) if s is not None else _c(message)
        sugg = (F.when(cond, sv) if sugg is None else sugg.when(cond, sv))
        auto = (F.when(cond, F.lit(a)) if auto is None else auto.when(cond, F.lit(a)))
    return [desc.alias("description"), sugg.alias("suggestion"), auto.alias("auto_resolvable")]


def _replace_first(c: Column, old: str, new: str) -> Column:
    return F.regexp_replace(c, "(?s)^(.*?)" + old, "$1" + new)


def auto_resolve(sql, cls) -> list[Column]:
    """(resolved_sql, resolved): index -> CREATE INDEX IF NOT EXISTS, table ->
    CREATE TABLE IF NOT EXISTS, column -> '' (skip); else unchanged, False."""
    s, c = _c(sql), _c(cls)
    idx = _replace_first(s, "CREATE INDEX ", "CREATE INDEX IF NOT EXISTS ")
    tbl = _replace_first(s, "CREATE TABLE ", "CREATE TABLE IF NOT EXISTS ")
    idx_ok = (c == "index_exists") & s.contains("CREATE INDEX ")
    tbl_ok = (c == "table_exists") & s.contains("CREATE TABLE ")
    col_ok = c == "column_exists"
    resolved_sql = (F.when(idx_ok, idx).when(tbl_ok, tbl).when(col_ok, F.lit("")).otherwise(s))
    return [resolved_sql.alias("resolved_sql"), (idx_ok | tbl_ok | col_ok).alias("resolved")]
