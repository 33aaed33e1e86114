"""Registered queries: conflict checks, resolution and merge strategies."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.changes import ACTION_BITS
from ..operators import conflicts as CF
from ..operators import merging as MG
from ..operators.extract import table_stats
from ..sources import history as H
from ..sources.tables import DRIVER_TABLES
from . import settings as S
from .registry import Ctx, query
from .sqlparts import ITEM, actions_cte, body_expr, create_cols_expr, hist, object_exprs, trim


def _base_catalog(spark):
    rows = [(t, c) for t, cols in S.BASE_CATALOG for c in cols]
    cat = spark.createDataFrame(rows, "table_name string, column_name string")
    idx = spark.createDataFrame(list(S.BASE_INDEXES), "index_name string, table_name string")
    return cat, idx


def _open_mergeable(c: Ctx):
    """Mergeable changes of the open branches (active, not main)."""
    open_ = c.branches.filter((F.col("status") == "active") & (F.col("branch_id") != 0)).select("branch_id")
    return (c.recorded.filter(F.col("type").isin("ddl", "seed"))
            .join(open_, "branch_id", "left_semi"))


def _checked(c: Ctx):
    cat, idx = _base_catalog(c.spark)
    return c._get("checked", lambda: CF.check(_open_mergeable(c), cat, idx, hot=c.hot_branches))


_BASE_T = ", ".join(f"('{t}')" for t, _ in S.BASE_CATALOG)
_BASE_C = ", ".join(f"('{t}', '{col}')" for t, cols in S.BASE_CATALOG for col in cols)
_BASE_I = ", ".join(f"('{i}')" for i, _ in S.BASE_INDEXES)
_E = object_exprs("body")
_PREV = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

_CHECK_CTES = [
    f"base_t AS (SELECT * FROM (VALUES {_BASE_T}) AS t(table_name))",
    f"base_c AS (SELECT * FROM (VALUES {_BASE_C}) AS t(table_name, col))",
    f"base_i AS (SELECT * FROM (VALUES {_BASE_I}) AS t(idx))",
    """chk AS (SELECT c.branch_id, c.sequence, c.sql_text FROM v_changes c JOIN v_branches b ON b.branch_id = c.branch_id
  WHERE b.status = 'active' AND b.branch_id != 0 AND c.type IN ('ddl', 'seed'))""",
    f"""o AS (SELECT branch_id, sequence, sql_text, {_E['op']} AS op, {_E['table_name']} AS table_name,
  {_E['column_name']} AS column_name, {_E['detail']} AS detail, {create_cols_expr('body')} AS create_cols,
  {_E['table_guard']} AS table_guard, {_E['object_guard']} AS object_guard
  FROM (SELECT *, {body_expr('sql_text')} AS body FROM chk))""",
    f"""t1 AS (SELECT o.*, coalesce(last_value(CASE WHEN op = 'create_table' THEN true WHEN op = 'drop_table' THEN false END
  IGNORE NULLS) OVER (PARTITION BY branch_id, o.table_name ORDER BY sequence {_PREV}), bt.table_name IS NOT NULL) AS table_before
  FROM o LEFT JOIN base_t bt ON bt.table_name = o.table_name)""",
    """t2 AS (SELECT *, CAST((op = 'create_table' AND NOT table_before) OR (op = 'drop_table' AND table_before) AS INT) AS acc
  FROM t1)""",
    f"""t3 AS (SELECT *, coalesce(sum(acc) OVER (PARTITION BY branch_id, table_name ORDER BY sequence {_PREV}), 0) AS epoch
  FROM t2)""",
    """openers AS (SELECT branch_id, table_name, epoch + 1 AS epoch, create_cols AS epoch_cols FROM t3
  WHERE op = 'create_table' AND acc = 1)""",
    "t4 AS (SELECT t3.*, openers.epoch_cols FROM t3 LEFT JOIN openers USING (branch_id, table_name, epoch))",
    """touch AS (
  SELECT branch_id, sequence, table_name, epoch, epoch_cols, column_name AS col,
    CASE WHEN op = 'add_column' THEN true WHEN op IN ('drop_column', 'rename_column') THEN false END AS effect, true AS main
  FROM t4 WHERE column_name IS NOT NULL
  UNION ALL
  SELECT branch_id, sequence, table_name, epoch, epoch_cols, detail, true, false FROM t4
  WHERE column_name IS NOT NULL AND op = 'rename_column' AND detail IS NOT NULL)""",
    f"""tc AS (SELECT touch.branch_id, touch.sequence, touch.main,
  coalesce(last_value(effect IGNORE NULLS) OVER (PARTITION BY branch_id, touch.table_name, epoch, touch.col ORDER BY sequence {_PREV}),
    CASE WHEN epoch = 0 THEN bc.col IS NOT NULL ELSE coalesce(list_contains(epoch_cols, touch.col), false) END) AS col_before
  FROM touch LEFT JOIN base_c bc ON bc.table_name = touch.table_name AND bc.col = touch.col)""",
    """t5 AS (SELECT t4.*, tc.col_before, tn.col_before AS target_before FROM t4
  LEFT JOIN (SELECT * FROM tc WHERE main) tc USING (branch_id, sequence)
  LEFT JOIN (SELECT * FROM tc WHERE NOT main) tn USING (branch_id, sequence))""",
    f"""t6 AS (SELECT t5.*, CASE WHEN op IN ('create_index', 'drop_index') THEN
  coalesce(last_value(CASE WHEN op = 'create_index' AND table_before THEN true WHEN op = 'drop_index' THEN false END IGNORE NULLS)
    OVER (PARTITION BY branch_id, detail ORDER BY sequence {_PREV}), bi.idx IS NOT NULL) END AS index_before
  FROM t5 LEFT JOIN base_i bi ON bi.idx = t5.detail)""",
    """verdicts AS (SELECT *,
  CASE WHEN op = 'other' THEN 'unverified'
       WHEN (table_guard OR (op = 'drop_table' AND object_guard)) AND NOT table_before THEN NULL
       WHEN op IN ('add_column','drop_column','rename_column','alter_type','drop_table','create_index','truncate','insert','update','delete')
         AND NOT table_before THEN 'dropped_reference'
       WHEN op = 'create_table' AND table_before AND NOT object_guard THEN 'table_exists'
       WHEN op = 'create_index' AND index_before AND NOT object_guard THEN 'index_exists'
       WHEN op = 'drop_index' AND NOT index_before AND NOT object_guard THEN 'dropped_reference'
       WHEN op = 'add_column' AND col_before AND NOT object_guard THEN 'column_exists'
       WHEN op IN ('drop_column', 'rename_column', 'alter_type') AND NOT col_before AND NOT object_guard THEN 'dropped_reference'
       WHEN op = 'rename_column' AND target_before THEN 'column_exists' END AS conflict_type
  FROM t6)""",
    """checked AS (SELECT branch_id, sequence, sql_text, op, table_name, column_name, detail, conflict_type,
  CASE WHEN conflict_type IS NULL THEN NULL
       WHEN conflict_type = 'unverified' THEN 'statement not recognised, review it by hand'
       WHEN op = 'drop_table' THEN 'table "' || table_name || '" does not exist'
       WHEN conflict_type = 'table_exists' THEN 'relation "' || table_name || '" already exists'
       WHEN conflict_type = 'index_exists' THEN 'relation "' || detail || '" already exists'
       WHEN op = 'drop_index' THEN 'index "' || detail || '" does not exist'
       WHEN NOT table_before THEN 'relation "' || table_name || '" does not exist'
       WHEN conflict_type = 'column_exists' THEN 'column "' || CASE WHEN op = 'rename_column' THEN detail ELSE column_name END
         || '" of relation "' || table_name || '" already exists'
       ELSE 'column "' || column_name || '" of relation "' || table_name || '" does not exist' END AS message
  FROM verdicts)""",
    """classified AS (SELECT *,
  CASE WHEN contains(lower(message), 'already exists') AND contains(lower(message), 'column') THEN 'column_exists'
       WHEN contains(lower(message), 'already exists') AND contains(lower(message), 'relation') THEN 'index_exists'
       WHEN contains(lower(message), 'already exists') AND contains(lower(message), 'table') THEN 'table_exists'
       WHEN contains(lower(message), 'does not exist') THEN 'dropped_reference'
       WHEN contains(lower(message), 'type') AND contains(lower(message), 'cannot') THEN 'type_mismatch'
       ELSE 'unknown' END AS message_class
  FROM checked WHERE message IS NOT NULL)""",
    """resolved AS (SELECT *,
  CASE WHEN message_class = 'index_exists' AND contains(sql_text, 'CREATE INDEX ')
         THEN regexp_replace(sql_text, 'CREATE INDEX ', 'CREATE INDEX IF NOT EXISTS ')
       WHEN message_class = 'table_exists' AND contains(sql_text, 'CREATE TABLE ')
         THEN regexp_replace(sql_text, 'CREATE TABLE ', 'CREATE TABLE IF NOT EXISTS ')
       WHEN message_class = 'column_exists' THEN '' ELSE sql_text END AS resolved_sql,
  (message_class = 'index_exists' AND contains(sql_text, 'CREATE INDEX '))
   OR (message_class = 'table_exists' AND contains(sql_text, 'CREATE TABLE ')) OR message_class = 'column_exists' AS resolved
  FROM classified)""",
]


def chk(body: str) -> str:
    return hist(body, *_CHECK_CTES)


_BASES, _CHAIN = _CHECK_CTES[:3], _CHECK_CTES[4:-2]


def check_ctes(suffix: str) -> list[str]:
    """The CTEs that judge the rows of ``chk<suffix>``, all with the suffix."""
    names = r"\b(chk|o|t[1-6]|openers|touch|tc|verdicts|checked)\b(?!')"
    return [re.sub(names, lambda m: m[0] + suffix, cte) for cte in _CHAIN]


# Each open branch behind its parent's changes up to the branch point, action by action.
_BEHIND_PARENT = [
    actions_cte("acts", "(SELECT branch_id, sequence, applied_at, type, sql_text FROM v_changes WHERE type IN ('ddl', 'seed'))"),
    """opened AS (SELECT b.branch_id, p.branch_id AS parent_id, b.created_at AS at FROM v_branches b
  JOIN v_branches p ON p.name = b.parent_branch WHERE b.status = 'active' AND b.branch_id != 0)""",
    """chk_p AS (
  SELECT branch_id, row_number() OVER (PARTITION BY branch_id ORDER BY own, seq, action) AS sequence, sql_text, own, seq, action
  FROM (SELECT l.branch_id, 0 AS own, a.sequence AS seq, a.action, a.sql_text FROM opened l
        JOIN acts a ON a.branch_id = l.parent_id AND a.applied_at <= l.at
        UNION ALL SELECT a.branch_id, 1, a.sequence, a.action, a.sql_text FROM acts a JOIN opened USING (branch_id)))""",
]


def opened(c: Ctx):
    """(branch_id, parent_id, at) of the open branches: their parent's id and
    the time they were branched off."""
    parents = c.branches.select(F.col("name").alias("parent_branch"), F.col("branch_id").alias("parent_id"))
    return (c.branches.filter((F.col("status") == "active") & (F.col("branch_id") != 0)).join(parents, "parent_branch")
            .select("branch_id", "parent_id", F.col("created_at").alias("at")))


@query("conflict_check_parent", hist("""
SELECT c.branch_id, CAST(k.seq AS INT) AS sequence, CAST(k.action AS INT) AS action, c.op, c.table_name, c.column_name,
  c.conflict_type, c.message
FROM checked_p c JOIN chk_p k USING (branch_id, sequence) WHERE k.own = 1""", *_BASES, *_BEHIND_PARENT, *check_ctes("_p")))
def conflict_check_parent(c: Ctx):
    """Every action of the open branches' mergeable changes checked against
    the branch's own parent as of its branch point."""
    cat, idx = _base_catalog(c.spark)
    past = c.recorded.filter(F.col("type").isin("ddl", "seed"))
    got = CF.check_against_parents(opened(c), _open_mergeable(c), past, cat, idx, hot=c.hot_branches)
    return got.drop("position")


@query("conflict_check", chk("""
SELECT branch_id, sequence, op, table_name, column_name, conflict_type FROM checked"""))
def conflict_check(c: Ctx):
    """Every mergeable change of every open branch checked in order against
    the parent catalog as changed by the earlier changes of its batch."""
    return _checked(c).select("branch_id", "sequence", "op", "table_name", "column_name", "conflict_type")


def _level(d: int) -> list[str]:
    """The CTEs that merge the branches of level ``d`` into their parents."""
    return [
        f"""kids_{d} AS (SELECT b.branch_id, p.branch_id AS parent_id, lv.level,
  p.name = 'main' OR contains(p.name, 'automobile') AS is_gated
  FROM v_branches b JOIN v_branches p ON p.name = b.parent_branch JOIN lv ON lv.branch_id = b.branch_id
  WHERE b.status = 'active' AND b.branch_id != 0 AND lv.level = {d})""",
        f"""heads_{d} AS (SELECT branch_id, max(sequence) AS head FROM hist_{d} GROUP BY branch_id)""",
        f"""sent_{d} AS (SELECT k.parent_id AS branch_id, h.branch_id AS child, h.sequence AS child_sequence, h.sql_text, h.type,
  coalesce(head, 0) AS head, coalesce(head, 0) + row_number() OVER (PARTITION BY k.parent_id ORDER BY h.branch_id, h.sequence) AS sequence
  FROM hist_{d} h JOIN kids_{d} k ON k.branch_id = h.branch_id AND NOT k.is_gated
  LEFT JOIN heads_{d} hd ON hd.branch_id = k.parent_id WHERE h.type IN ('ddl', 'seed'))""",
        actions_cte(f"acts_{d}", f"""(SELECT branch_id, sequence, sql_text FROM hist_{d} WHERE type IN ('ddl', 'seed')
  AND branch_id IN (SELECT branch_id FROM sent_{d}) UNION ALL SELECT branch_id, sequence, sql_text FROM sent_{d})"""),
        f"chk_{d} AS (SELECT branch_id, sequence * {1 << ACTION_BITS} + action - 1 AS sequence, sql_text FROM acts_{d})",
        *check_ctes(f"_{d}"),
        f"""bad_{d} AS (SELECT DISTINCT branch_id, sequence // {1 << ACTION_BITS} AS sequence FROM checked_{d}
  WHERE conflict_type IS NOT NULL)""",
        f"""kept_{d} AS (SELECT s.branch_id, head + row_number() OVER (PARTITION BY s.branch_id ORDER BY s.sequence) AS sequence,
  sql_text, type, child AS from_branch, child_sequence AS from_sequence
  FROM sent_{d} s WHERE NOT EXISTS (SELECT 1 FROM bad_{d} b WHERE b.branch_id = s.branch_id AND b.sequence = s.sequence))""",
        f"hist_{d - 1} AS (SELECT * FROM hist_{d} UNION ALL SELECT * FROM kept_{d})",
        f"""result_{d} AS (SELECT k.branch_id, k.parent_id, k.level, CASE WHEN is_gated THEN 'gated'
  WHEN coalesce(sent, 0) = 0 THEN 'nothing to merge' ELSE 'merged' END AS outcome, coalesce(sent, 0) AS sent, coalesce(applied, 0) AS applied
  FROM kids_{d} k LEFT JOIN (SELECT child, count(*) AS sent FROM sent_{d} GROUP BY child) s ON s.child = k.branch_id
  LEFT JOIN (SELECT from_branch, count(*) AS applied FROM kept_{d} GROUP BY from_branch) a ON a.from_branch = k.branch_id)"""]


_DEEPEST = 8        # of the branch trees that the expected results cover


def merged(body: str) -> str:
    levels = [cte for d in range(_DEEPEST, 0, -1) for cte in _level(d)]
    outcomes = "outcomes AS (" + " UNION ALL ".join(f"SELECT * FROM result_{d}" for d in range(1, _DEEPEST + 1)) + ")"
    sql = hist(body, """lv AS (SELECT CAST(0 AS BIGINT) AS branch_id, 0 AS level
  UNION ALL SELECT b.branch_id, lv.level + 1 FROM v_branches b JOIN v_branches p ON p.name = b.parent_branch
  JOIN lv ON lv.branch_id = p.branch_id WHERE b.branch_id != 0)""", *_BASES,
               f"""hist_{_DEEPEST} AS (SELECT branch_id, CAST(sequence AS BIGINT) AS sequence, sql_text, type,
  CAST(NULL AS BIGINT) AS from_branch, CAST(NULL AS BIGINT) AS from_sequence FROM v_changes)""", *levels, outcomes)
    return "WITH RECURSIVE" + sql.removeprefix("WITH")


def _merge(c: Ctx):
    """All open branches merged into their parents; conflicting changes stay out."""
    cat, idx = _base_catalog(c.spark)
    names = c.branches.select(F.col("name").alias("parent_branch"), F.col("branch_id").alias("up"))
    tree = (c.branches.join(names, "parent_branch", "left")
            .select("branch_id", F.when(F.col("branch_id") != F.col("up"), F.col("up")).alias("parent_id"),
                    (F.col("status") == "active").alias("is_open")))
    gates = H.protected(c.branches).join(c.branches, F.col("branch_name") == F.col("name")).select("branch_id")
    return MG.merge_apply(tree, c.recorded, cat, idx, gates, "ours", hot=c.hot_branches)


@query("merge_apply", merged("SELECT branch_id, sequence, from_branch, from_sequence, sql_text FROM hist_0 WHERE from_branch IS NOT NULL"))
def merge_apply(c: Ctx):
    """What the parents' histories gain when every open branch merges, deepest first."""
    return _merge(c)[0].select("branch_id", "sequence", "from_branch", "from_sequence", "sql_text")


@query("merge_outcomes", merged("SELECT branch_id, parent_id, level, outcome, sent, applied FROM outcomes"))
def merge_outcomes(c: Ctx):
    return _merge(c)[1]


@query("merged_statuses", merged("""SELECT b.branch_id, b.name, CASE WHEN o.outcome = 'merged' THEN 'merged' ELSE b.status END AS status
FROM v_branches b LEFT JOIN outcomes o ON o.branch_id = b.branch_id"""))
def merged_statuses(c: Ctx):
    """The branches' statuses after the merge."""
    return MG.merged_statuses(c.branches, _merge(c)[1]).select("branch_id", "name", "status")


@query("conflict_class", chk("""
SELECT branch_id, sequence, message, message_class,
  CASE message_class WHEN 'column_exists' THEN 'Column already exists in parent schema'
    WHEN 'index_exists' THEN 'Index or table already exists'
    WHEN 'table_exists' THEN 'Table already exists in parent schema'
    WHEN 'dropped_reference' THEN 'References a column or table that no longer exists'
    WHEN 'type_mismatch' THEN 'Type mismatch — cannot cast'
    ELSE 'Migration failed — manual review required' END AS description,
  CASE message_class WHEN 'column_exists' THEN 'Remove duplicate column or rename it'
    WHEN 'index_exists' THEN 'Use CREATE INDEX IF NOT EXISTS'
    WHEN 'table_exists' THEN 'Use CREATE TABLE IF NOT EXISTS'
    WHEN 'dropped_reference' THEN 'Check if parent branch dropped this object'
    WHEN 'type_mismatch' THEN 'Add explicit USING clause for type conversion'
    ELSE message END AS suggestion,
  message_class IN ('column_exists', 'index_exists', 'table_exists') AS auto_resolvable
FROM classified"""))
def conflict_class(c: Ctx):
    """Classify the error messages of the conflict log (first rule wins)."""
    log = _checked(c).filter(F.col("message").isNotNull())
    return CF.classify_messages(log).select("branch_id", "sequence", "message", "message_class",
                                            "description", "suggestion", "auto_resolvable")


@query("conflict_resolve", chk("""
SELECT branch_id, sequence, message_class, resolved_sql, resolved FROM resolved"""))
def conflict_resolve(c: Ctx):
    log = CF.classify_messages(_checked(c).filter(F.col("message").isNotNull()))
    return CF.resolve(log).select("branch_id", "sequence", "message_class", "resolved_sql", "resolved")


@query("merge_ours", chk("""
SELECT m.branch_id, m.sequence, m.sql_text FROM chk m
WHERE NOT EXISTS (SELECT 1 FROM checked k WHERE k.branch_id = m.branch_id AND k.sequence = m.sequence
                  AND k.conflict_type IS NOT NULL)"""))
def merge_ours(c: Ctx):
    return CF.merge_ours(_checked(c)).select("branch_id", "sequence", "sql_text")


@query("merge_theirs", chk("""
SELECT m.branch_id, m.sequence, coalesce(r.resolved_sql, m.sql_text) AS sql_to_apply,
  coalesce(r.resolved_sql, m.sql_text) = '' AS skip
FROM chk m LEFT JOIN resolved r ON r.branch_id = m.branch_id AND r.sequence = m.sequence"""))
def merge_theirs(c: Ctx):
    return CF.merge_theirs(_checked(c))


@query("merge_refused", chk("""
SELECT b.branch_id, b.name, count(*) AS conflicts FROM checked k JOIN v_branches b ON b.branch_id = k.branch_id
WHERE k.conflict_type IS NOT NULL GROUP BY b.branch_id, b.name"""))
def merge_refused(c: Ctx):
    return CF.merge_refused(c.branches, _checked(c))


@query("merge_plan", hist("""
SELECT b.branch_id, b.name, count(m.migration_id) AS mergeable_count,
  CAST(min(m.sequence) AS INT) AS first_sequence, CAST(max(m.sequence) AS INT) AS last_sequence,
  CASE WHEN count(m.migration_id) = 0 THEN 'nothing to merge' ELSE 'ready' END AS plan
FROM v_branches b LEFT JOIN (SELECT * FROM v_changes WHERE type IN ('ddl', 'seed')) m ON m.branch_id = b.branch_id
WHERE b.status = 'active' AND b.branch_id != 0 GROUP BY b.branch_id, b.name"""))
def merge_plan(c: Ctx):
    """Merge plan for every open branch: its mergeable changes, counted."""
    open_ = c.branches.filter((F.col("status") == "active") & (F.col("branch_id") != 0)).select("branch_id", "name")
    m = (c.recorded.filter(F.col("type").isin("ddl", "seed")).groupBy("branch_id")
         .agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi")))
    j = open_.join(m, "branch_id", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("branch_id", "name", n.alias("mergeable_count"), F.col("lo").alias("first_sequence"),
                    F.col("hi").alias("last_sequence"),
                    F.when(n == 0, F.lit("nothing to merge")).otherwise(F.lit("ready")).alias("plan"))


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in DRIVER_TABLES)


@query("change_risk", hist(f"""
SELECT branch_id, sequence, op, table_name, array_to_string(flags, ',') AS risk_flags,
  CAST(len(flags) AS INT) AS risk_count FROM (
  SELECT branch_id, sequence, op, table_name,
    list_filter([CASE WHEN op IN ('drop_column', 'drop_table') THEN 'drops_data' END,
                 CASE WHEN op = 'alter_type' THEN 'lossy_type_change' END,
                 CASE WHEN op IN ('add_column', 'drop_column', 'rename_column', 'alter_type', 'create_index', 'truncate')
                      AND coalesce(row_count, 0) >= 10000 THEN 'locks_large_table' END,
                 CASE WHEN op = 'create_index' AND NOT contains(upper(body), 'CONCURRENTLY') THEN 'blocking_index' END,
                 CASE WHEN op = 'other' THEN 'unrecognised' END], lambda x: x IS NOT NULL) AS flags
  FROM (SELECT o.*, s.row_count FROM (SELECT branch_id, sequence, body, {_E['op']} AS op, {_E['table_name']} AS table_name
        FROM (SELECT branch_id, sequence, {body_expr('sql_text')} AS body FROM v_changes WHERE type = 'ddl')) o
        LEFT JOIN stats s ON s.table_name = o.table_name))""", f"stats AS ({_COUNTS})"))
def change_risk(c: Ctx):
    """Fixed risk rules per ddl change, using the size of the touched table."""
    stats = table_stats(c.src, DRIVER_TABLES)
    ddl = c.recorded.filter(F.col("type") == "ddl")
    from ..functions.changes import with_objects
    o = (with_objects(ddl.select("branch_id", "sequence", "sql_text"), keep_body=True)
         .withColumnRenamed("_body", "body"))
    j = o.join(F.broadcast(stats), "table_name", "left")
    op = F.col("op")
    rows = F.coalesce("row_count", F.lit(0))
    flags = F.array_compact(F.array(
        F.when(op.isin("drop_column", "drop_table"), F.lit("drops_data")),
        F.when(op == "alter_type", F.lit("lossy_type_change")),
        F.when(op.isin("add_column", "drop_column", "rename_column", "alter_type", "create_index", "truncate")
               & (rows >= 10000), F.lit("locks_large_table")),
        F.when((op == "create_index") & ~F.upper("body").contains("CONCURRENTLY"), F.lit("blocking_index")),
        F.when(op == "other", F.lit("unrecognised"))))
    return j.select("branch_id", "sequence", "op", "table_name", F.array_join(flags, ",").alias("risk_flags"),
                    F.size(flags).cast("int").alias("risk_count"))


_INSERT = CF.INSERT_VALUES.replace("'", "''")
_FIRST = CF.FIRST_OF_TUPLE.replace("'", "''")


@query("merge_seed_rows", hist("""
SELECT parent_id, table_name, row_key, from_branch FROM (
  SELECT *, row_number() OVER (PARTITION BY parent_id, table_name, row_key ORDER BY late, applied_at, migration_id, from_branch) AS rn
  FROM (SELECT branch_id AS parent_id, table_name, row_key, 0 AS late, applied_at, migration_id, CAST(NULL AS VARCHAR) AS from_branch
        FROM seeds WHERE branch_id IN (SELECT parent_id FROM links)
        UNION ALL
        SELECT l.parent_id, s.table_name, s.row_key, 1, s.applied_at, s.migration_id, l.name
        FROM seeds s JOIN links l ON l.branch_id = s.branch_id)) WHERE rn = 1""",
    f"""seed_lists AS (SELECT branch_id, applied_at, migration_id,
  nullif(regexp_replace(lower(replace(regexp_extract(sql_text, '{_INSERT}', 1), '"', '')), '^.*\\.', ''), '') AS table_name,
  regexp_extract_all(regexp_extract(sql_text, '{_INSERT}', 2), '{_FIRST}', 1) AS keys
  FROM v_changes WHERE type = 'seed')""",
    """seeds AS (SELECT branch_id, applied_at, migration_id, table_name, regexp_replace(k, '^''|''$', '', 'g') AS row_key
  FROM (SELECT *, unnest(CASE WHEN len(keys) = 0 THEN [NULL] ELSE keys END) AS k FROM seed_lists))""",
    """links AS (SELECT b.branch_id, b.name, p.branch_id AS parent_id FROM v_branches b
  JOIN v_branches p ON p.name = b.parent_branch WHERE b.status = 'active' AND b.branch_id != 0)"""))
def merge_seed_rows(c: Ctx):
    """Seed rows of every open branch merged into its parent's table."""
    return CF.merge_seed_rows(c.branches, c.recorded)


_COLUMNS = CF.INSERT_COLUMNS.replace("'", "''")
_TUPLE = CF.VALUE_TUPLE.replace("'", "''")


@query("merge_seed_values", hist("""
SELECT parent_id, table_name, row_key, array_to_string(columns, ',') AS columns, array_to_string(vals, ' | ') AS row_values, from_branch FROM (
  SELECT l.parent_id, s.table_name, s.row_key, s.columns, s.vals, l.name AS from_branch,
    row_number() OVER (PARTITION BY l.parent_id, s.table_name, s.row_key ORDER BY s.applied_at, s.migration_id, s.i) AS rn
  FROM seeds s JOIN links l ON l.branch_id = s.branch_id
  WHERE NOT EXISTS (SELECT 1 FROM seeds o WHERE o.branch_id = l.parent_id AND o.table_name IS NOT DISTINCT FROM s.table_name
                    AND o.row_key IS NOT DISTINCT FROM s.row_key)) WHERE rn = 1""",
    f"""seed_lists AS (SELECT branch_id, applied_at, migration_id,
  nullif(regexp_replace(lower(replace(regexp_extract(sql_text, '{_INSERT}', 1), '"', '')), '^.*\\.', ''), '') AS table_name,
  regexp_extract_all(lower(regexp_extract(sql_text, '{_COLUMNS}', 1)), '\\w+') AS columns,
  regexp_extract_all(regexp_extract(sql_text, '{_INSERT}', 2), '{_TUPLE}', 1) AS tuples
  FROM v_changes WHERE type = 'seed')""",
    f"""seed_rows AS (SELECT * EXCLUDE (tuples), tuples[i] AS tuple FROM seed_lists, unnest(range(1, len(tuples) + 1)) AS r(i)
  UNION ALL SELECT * EXCLUDE (tuples), NULL, NULL FROM seed_lists WHERE len(tuples) = 0)""",
    f"""seeds AS (SELECT *, regexp_replace(vals[1], '^''|''$', '', 'g') AS row_key FROM (
  SELECT *, list_transform(regexp_extract_all(tuple, '{ITEM.replace("'", "''")}'), lambda x: {trim('x')}) AS vals FROM seed_rows))""",
    """links AS (SELECT b.branch_id, b.name, p.branch_id AS parent_id FROM v_branches b
  JOIN v_branches p ON p.name = b.parent_branch WHERE b.status = 'active' AND b.branch_id != 0)"""))
def merge_seed_values(c: Ctx):
    """The whole rows that the parents' tables gain from their branches' seed changes."""
    return (CF.merge_seed_values(c.branches, c.recorded)
            .withColumns({"columns": F.array_join("columns", ","), "row_values": F.array_join("row_values", " | ")}))
