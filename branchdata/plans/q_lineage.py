"""Registered queries: column lineage of all branches, and tables rebuilt from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.changes import ACTION_BITS
from ..operators import lineage as L
from . import settings as S
from .q_conflicts import _BASES, _base_catalog, check_ctes
from .registry import Ctx, query
from .sqlparts import ITEM, actions_cte, body_expr, hist, trim


def _typed_catalog(spark) -> DataFrame:
    return spark.createDataFrame([(t, c, S.BASE_TYPES.get(c, "text")) for t, cols in S.BASE_CATALOG for c in cols],
                                 "table_name string, column_name string, data_type string")


def _actions(c: Ctx) -> DataFrame:
    cat, idx = _base_catalog(c.spark)
    return L.effective_actions(c.recorded.where("type = 'ddl'"), cat, idx, hot=c.hot_branches)


def _q(rx: str) -> str:
    return rx.replace("'", "''")


def _type(x: str) -> str:
    return f"nullif(lower({trim(f'''regexp_extract({x}, '{_q(L.TYPE_PART)}', 1)''')}), '')"


def _default(x: str) -> str:
    return f"nullif(regexp_extract({x}, '{_q(L.DEFAULT_PART)}', 1), '')"


_SEEDS = ", ".join(f"('{t}', '{c}', '{S.BASE_TYPES.get(c, 'text')}')" for t, cols in S.BASE_CATALOG for c in cols)
_NOT = ", ".join(f"'{x}'" for x in L.NOT_COLUMNS)

_LINEAGE_CTES = [
    *_BASES,
    actions_cte("acts", "(SELECT branch_id, sequence, sql_text FROM v_changes WHERE type = 'ddl')"),
    f"chk_l AS (SELECT branch_id, sequence * {1 << ACTION_BITS} + action - 1 AS sequence, sql_text FROM acts)",
    *check_ctes("_l"),
    "act AS (SELECT *, sequence AS pos FROM verdicts_l)",
    f"""created AS (SELECT branch_id, table_name, pos, epoch + 1 AS epoch, lower(regexp_extract(item, '{L.NAME_AND_REST}', 1)) AS col,
  regexp_extract(item, '{L.NAME_AND_REST}', 2) AS rest
  FROM (SELECT *, unnest(regexp_extract_all(regexp_extract({body_expr('sql_text')}, '(?s)\\((.*)\\)', 1), '{_q(ITEM)}')) AS item
        FROM act WHERE op = 'create_table' AND NOT table_before))""",
    f"""begun AS MATERIALIZED (
  SELECT branch_id, table_name, epoch, column_name AS col, pos, 'add' AS how, {_type('tail')} AS dtype, {_default('tail')} AS dflt,
    CAST(NULL AS VARCHAR) AS old
  FROM (SELECT *, regexp_extract(sql_text, '{L.ADD_TAIL}', 1) AS tail FROM act WHERE op = 'add_column' AND table_before AND NOT col_before)
  UNION ALL SELECT branch_id, table_name, epoch, col, pos, 'create', {_type('rest')}, {_default('rest')}, NULL FROM created
    WHERE col != '' AND col NOT IN ({_NOT})
  UNION ALL SELECT branch_id, table_name, epoch, detail, pos, 'rename', NULL, NULL, column_name FROM act
    WHERE op = 'rename_column' AND table_before AND col_before AND NOT target_before
  UNION ALL SELECT t.branch_id, t.table_name, 0, s.col, -1, 'seed', s.dtype, NULL, NULL
    FROM (SELECT DISTINCT branch_id, table_name FROM act WHERE table_name IS NOT NULL) t
    JOIN (SELECT * FROM (VALUES {_SEEDS}) AS v(table_name, col, dtype)) s ON s.table_name = t.table_name)""",
    """stops AS (
  SELECT branch_id, table_name, epoch, column_name AS col, pos FROM act
  WHERE table_before AND col_before AND (op = 'drop_column' OR (op = 'rename_column' AND NOT target_before))
  UNION ALL SELECT branch_id, table_name, epoch, col, pos FROM begun)""",
    """drops AS (SELECT DISTINCT branch_id, table_name, epoch FROM act WHERE op = 'drop_table' AND table_before)""",
    """alive AS (SELECT b.branch_id, b.table_name, b.col, b.pos FROM begun b
  WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.branch_id = b.branch_id AND s.table_name = b.table_name AND s.epoch = b.epoch
                    AND s.col = b.col AND s.pos > b.pos)
    AND NOT EXISTS (SELECT 1 FROM drops d WHERE d.branch_id = b.branch_id AND d.table_name = b.table_name AND d.epoch = b.epoch))""",
    """linked AS MATERIALIZED (SELECT r.*, (SELECT max(p.pos) FROM begun p WHERE p.branch_id = r.branch_id AND p.table_name = r.table_name
    AND p.epoch = r.epoch AND p.col = r.old AND p.pos < r.pos) AS old_at FROM begun r WHERE r.how = 'rename')""",
    """chain AS (
  SELECT branch_id, table_name, col, pos, how, dtype, dflt, col AS o_col, pos AS o_at, 0 AS renames FROM begun WHERE how != 'rename'
  UNION ALL SELECT l.branch_id, l.table_name, l.col, l.pos, c.how, c.dtype, c.dflt, c.o_col, c.o_at, c.renames + 1
  FROM linked l JOIN chain c ON c.branch_id = l.branch_id AND c.table_name = l.table_name AND c.col = l.old AND c.pos = l.old_at)""",
    f"""retyped AS (
  SELECT branch_id, table_name, o_col, o_at, arg_max(dtype, pos) AS new_type FROM (
    SELECT a.branch_id, a.table_name, c.o_col, c.o_at, a.pos,
      lower({trim(f"regexp_extract(a.sql_text, '{L.NEW_TYPE}', 1)")}) AS dtype
    FROM (SELECT a.*, (SELECT max(b.pos) FROM begun b WHERE b.branch_id = a.branch_id AND b.table_name = a.table_name AND b.epoch = a.epoch
                       AND b.col = a.column_name AND b.pos < a.pos) AS since
          FROM act a WHERE a.op = 'alter_type' AND a.table_before AND a.col_before) a
    JOIN chain c ON c.branch_id = a.branch_id AND c.table_name = a.table_name AND c.col = a.column_name AND c.pos = a.since)
  GROUP BY branch_id, table_name, o_col, o_at)""",
]


def _lineage_sql(body: str) -> str:
    return "WITH RECURSIVE" + hist(body, *_LINEAGE_CTES).removeprefix("WITH")


@query("column_lineage", _lineage_sql("""
SELECT a.branch_id, a.table_name, a.col AS column_name, c.how AS origin, c.o_col AS origin_column, c.o_at AS origin_position,
  CAST(c.renames AS BIGINT) AS renames, coalesce(t.new_type, c.dtype) AS data_type, c.dflt AS "default"
FROM alive a JOIN chain c ON c.branch_id = a.branch_id AND c.table_name = a.table_name AND c.col = a.col AND c.pos = a.pos
LEFT JOIN retyped t ON t.branch_id = a.branch_id AND t.table_name = a.table_name AND t.o_col = c.o_col AND t.o_at = c.o_at"""))
def column_lineage(c: Ctx):
    """The columns at the head of every table that any branch has changed."""
    return L.column_lineage(_actions(c), _typed_catalog(c.spark))


@query("skipped_actions", _lineage_sql(f"""
SELECT branch_id, CAST(pos // {1 << ACTION_BITS} AS INT) AS sequence, CAST(pos % {1 << ACTION_BITS} + 1 AS INT) AS action, sql_text,
  conflict_type FROM act WHERE conflict_type IS NOT NULL"""))
def skipped_actions(c: Ctx):
    """The actions of all branches that could not be applied, with the reason."""
    return L.skipped_actions(_actions(c))


def _customer(c: Ctx, *batches) -> DataFrame:
    """Customer rebuilt from the lineage of batches of changes, one after the other."""
    statements = reduce(lambda a, b: [*a, *b], batches, [])
    changes = c.spark.createDataFrame([(0, i, s) for i, s in enumerate(statements, 1)], "branch_id long, sequence int, sql_text string")
    source = c.t("customer")
    catalog = L.seed_catalog("customer", source)
    none = c.spark.createDataFrame([], "index_name string, table_name string")
    actions = L.effective_actions(changes, catalog.select("table_name", "column_name"), none, hot=None)
    return L.rebuilt(source, L.column_lineage(actions, catalog).where("table_name = 'customer'"))


@query("rebuild_from_lineage", """
SELECT c_custkey, c_name AS c_full_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, 'n/a' AS c_note,
  CAST(NULL AS INT) AS c_region FROM customer""")
def rebuild_from_lineage(c: Ctx):
    """Customer on top of the parent's changes, then the branch's, in one
    projection read off the lineage; the branch's second ADD COLUMN c_note is
    one of its skipped actions."""
    return _customer(c, S.PARENT_CUSTOMER_CHANGES, S.CUSTOMER_CHANGES)
