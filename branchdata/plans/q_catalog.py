"""Registered queries: catalogs, schema diff, type mapping, table evolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as CT
from ..operators import evolve as EV
from ..operators import extract as X
from ..sources.store import BranchStore
from ..sources.tables import DRIVER_TABLES
from . import settings as S
from .registry import Ctx, query
from .sqlparts import catalog

_CAT = catalog(list(DRIVER_TABLES))


def _branch_frames(c: Ctx):
    """The driver tables as one branch sees them: customer evolved by the
    branch's changes, lineitem dropped, a new customer_notes table."""
    frames = {t: c.t(t) for t in DRIVER_TABLES if t != "lineitem"}
    frames["customer"] = EV.apply_changes(c.t("customer"), S.CUSTOMER_CHANGES, "customer")
    frames["customer_notes"] = frames["customer"].select("c_custkey", "c_note")
    return frames


_NEW_CAT = f"""newcat AS (
  SELECT table_name, column_name, data_type FROM cat WHERE table_name NOT IN ('lineitem', 'customer')
  UNION ALL SELECT table_name, column_name, CASE WHEN column_name = 'c_nationkey' THEN 'bigint' ELSE data_type END
    FROM cat WHERE table_name = 'customer' AND column_name NOT IN ('c_acctbal', 'c_name')
  UNION ALL SELECT * FROM (VALUES ('customer', 'c_full_name', 'string'), ('customer', 'c_note', 'string'),
    ('customer_notes', 'c_custkey', 'bigint'), ('customer_notes', 'c_note', 'string')) AS v(table_name, column_name, data_type))"""

_DIFF = """diff AS (
  SELECT CASE WHEN o.table_name IS NULL THEN 'add_table' ELSE 'remove_table' END AS change_kind,
    coalesce(n.table_name, o.table_name) AS table_name, CAST(NULL AS VARCHAR) AS column_name,
    CAST(NULL AS VARCHAR) AS old_type, CAST(NULL AS VARCHAR) AS new_type
  FROM (SELECT DISTINCT table_name FROM newcat) n FULL OUTER JOIN (SELECT DISTINCT table_name FROM cat) o USING (table_name)
  WHERE n.table_name IS NULL OR o.table_name IS NULL
  UNION ALL
  SELECT CASE WHEN o.data_type IS NULL THEN 'add_column' WHEN n.data_type IS NULL THEN 'remove_column' ELSE 'change_type' END,
    coalesce(n.table_name, o.table_name), coalesce(n.column_name, o.column_name), upper(o.data_type), upper(n.data_type)
  FROM (SELECT * FROM newcat WHERE table_name IN (SELECT table_name FROM cat)) n
  FULL OUTER JOIN (SELECT * FROM cat WHERE table_name IN (SELECT table_name FROM newcat)) o
    ON n.table_name = o.table_name AND n.column_name = o.column_name
  WHERE o.data_type IS NULL OR n.data_type IS NULL OR o.data_type != n.data_type)"""


@query("schema_diff", f"WITH {_CAT}, {_NEW_CAT}, {_DIFF} SELECT * FROM diff")
def schema_diff(c: Ctx):
    new = CT.catalog_of(c.spark, _branch_frames(c))
    old = CT.catalog_of(c.spark, {t: c.t(t) for t in DRIVER_TABLES})
    return CT.schema_diff(new, old)


@query("schema_diff_summary", f"""WITH {_CAT}, {_NEW_CAT}, {_DIFF}
SELECT count(*) FILTER (WHERE change_kind IN ('add_table', 'add_column')) AS added,
  count(*) FILTER (WHERE change_kind IN ('remove_table', 'remove_column')) AS removed,
  CAST(count(DISTINCT CASE WHEN change_kind IN ('add_column', 'remove_column', 'change_type') THEN table_name END)
       + count(*) FILTER (WHERE change_kind = 'change_type') AS BIGINT) AS changed,
  count(DISTINCT CASE WHEN change_kind IN ('add_column', 'remove_column', 'change_type') THEN table_name END) AS tables_changed
FROM diff""")
def schema_diff_summary(c: Ctx):
    new = CT.catalog_of(c.spark, _branch_frames(c))
    old = CT.catalog_of(c.spark, {t: c.t(t) for t in DRIVER_TABLES})
    return CT.diff_summary(CT.schema_diff(new, old))


def _type_map_sql() -> str:
    from ..constants import TYPE_NAMES
    vals = ", ".join(f"('{k}', '{v}')" for k, v in sorted(TYPE_NAMES.items()))
    src = ("CASE WHEN data_type = 'bigint' THEN 'bigint' WHEN data_type = 'int' THEN 'integer' "
           "WHEN data_type IN ('smallint', 'tinyint') THEN 'smallint' WHEN data_type = 'string' THEN 'text' "
           "WHEN data_type = 'boolean' THEN 'boolean' WHEN data_type = 'double' THEN 'double precision' "
           "WHEN data_type = 'float' THEN 'real' WHEN data_type = 'timestamp' THEN 'timestamp with time zone' "
           "WHEN data_type = 'timestamp_ntz' THEN 'timestamp without time zone' WHEN data_type = 'date' THEN 'date' "
           "WHEN data_type = 'binary' THEN 'bytea' WHEN starts_with(data_type, 'decimal') THEN 'numeric' "
           "WHEN starts_with(data_type, 'array') THEN 'ARRAY' ELSE data_type END")
    return f"""WITH {_CAT}, m AS (SELECT * FROM (VALUES {vals}) AS t(m_source, ddl_type)),
typed AS (SELECT table_name, column_name, data_type, {src} AS source_type FROM cat)
SELECT table_name, column_name, data_type, source_type, coalesce(ddl_type, upper(source_type)) AS ddl_type
FROM typed LEFT JOIN m ON lower(source_type) = m_source"""


@query("type_mapping", _type_map_sql())
def type_mapping(c: Ctx):
    cat = CT.catalog_of(c.spark, {t: c.t(t) for t in DRIVER_TABLES})
    return CT.type_mapping(c.spark, cat)


_FK_VALUES = ", ".join(f"('{ch}', 'f')" for ch, _, _, _ in S.FOREIGN_KEYS)


@query("table_load_order", f"""WITH {_CAT}, fk AS (SELECT * FROM (VALUES {_FK_VALUES}) AS t(table_name, constraint_type)),
t AS (SELECT DISTINCT cat.table_name, EXISTS (SELECT 1 FROM fk WHERE fk.table_name = cat.table_name) AS has_fk FROM cat)
SELECT table_name, has_fk, CAST(row_number() OVER (ORDER BY has_fk, table_name) AS INT) AS load_rank FROM t""")
def table_load_order(c: Ctx):
    cat = CT.catalog_of(c.spark, {t: c.t(t) for t in DRIVER_TABLES})
    cons = c.spark.createDataFrame([(ch, "f") for ch, _, _, _ in S.FOREIGN_KEYS],
                                   "table_name string, constraint_type string")
    return CT.load_order(cat, cons)


@query("apply_changes", """
SELECT c_custkey, c_name AS c_full_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, 'n/a' AS c_note
FROM customer""")
def apply_changes(c: Ctx):
    """The branch's four schema changes folded into one projection of customer."""
    return EV.apply_changes(c.t("customer"), S.CUSTOMER_CHANGES, "customer")


@query("rebase_branch", """
SELECT c_custkey, c_name AS c_full_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, 'n/a' AS c_note,
  CAST(NULL AS INT) AS c_region FROM customer""")
def rebase_branch(c: Ctx):
    """Rebuild customer on top of the parent's changes, replay the branch's;
    the branch's duplicate ADD COLUMN c_note is skipped."""
    df, _skipped = EV.rebase(c.t("customer"), S.PARENT_CUSTOMER_CHANGES, S.CUSTOMER_CHANGES, "customer")
    return df


@query("reset_rebuild", """
SELECT c_custkey, c_name AS c_full_name, c_nationkey, c_mktsegment, 'n/a' AS c_note FROM customer""")
def reset_rebuild(c: Ctx):
    """Reset one step: rebuild from the source and replay all but the last change."""
    return EV.reset(c.t("customer"), S.CUSTOMER_CHANGES, 1, "customer")


_CREATE_SQL = f"""WITH {_CAT}, loads AS (
SELECT 'customer' AS table_name, count(*) AS rows_loaded FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'supplier', count(*) FROM supplier
UNION ALL SELECT 'part', count(*) FROM part WHERE p_size <= 10
UNION ALL SELECT 'nation', count(*) FROM nation
UNION ALL SELECT 'region', count(*) FROM region)
SELECT cat.table_name, count(*) AS n_columns, coalesce(any_value(loads.rows_loaded), 0) AS rows_loaded,
  CASE WHEN any_value(loads.rows_loaded) IS NULL THEN 'shape_only' ELSE 'ready' END AS status
FROM cat LEFT JOIN loads USING (table_name) GROUP BY cat.table_name"""


@query("create_branch", _CREATE_SQL)
def create_branch(c: Ctx):
    """Create a branch: every table's shape rebuilt (empty), configured
    tables loaded (masked subsets).  Reports what the branch store holds."""
    store = BranchStore(c.spark, c.scratch())
    branch = "branch_feature_new"
    configured = {s.table for s in S.LOAD_SPECS}
    X.write_shapes(store, branch, {t: c.t(t) for t in DRIVER_TABLES if t not in configured}, parallel_tables=3)
    X.snapshot_all(c.src, store, branch, S.LOAD_SPECS, S.MASK_RULES, parallel_tables=3)
    paths = store.ready_versions(branch)
    cat = CT.catalog_of(c.spark, {t: c.spark.read.parquet(paths[t]) for t in DRIVER_TABLES})
    ncols = cat.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    state = store.latest().filter(F.col("branch") == branch).select("table_name", "rows_loaded")
    return (ncols.join(state, "table_name", "left")
            .select("table_name", "n_columns", F.coalesce("rows_loaded", F.lit(0)).alias("rows_loaded"),
                    F.when(F.col("table_name").isin(*configured), F.lit("ready"))
                     .otherwise(F.lit("shape_only")).alias("status")))
