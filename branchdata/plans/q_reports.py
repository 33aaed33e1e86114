"""Registered queries: branch reports, audit trail, snapshot states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as FT
from ..operators import history as HI
from ..operators import reports as R
from ..sources import history as H
from ..sources.store import BranchStore
from . import settings as S
from .registry import Ctx, query
from .sqlparts import fmt_ts, hist

_REF = S.HISTORY_REF_TS


@query("audit_changes", hist(f"""
SELECT {fmt_ts('m.applied_at')} AS timestamp, b.name AS branch, m.type, coalesce(m.description, '') AS detail
FROM v_changes m JOIN v_branches b ON b.branch_id = m.branch_id"""))
def audit_changes(c: Ctx):
    return R.audit_changes(c.recorded, c.branches)


@query("audit_snapshots", hist(f"""
SELECT {fmt_ts('s.completed_at')} AS timestamp, b.name AS branch, s.table_name, s.rows_loaded
FROM v_snapshots s JOIN v_branches b ON b.branch_id = s.branch_id WHERE s.completed_at IS NOT NULL"""))
def audit_snapshots(c: Ctx):
    return R.audit_snapshots(c.snapshots, c.branches)


_AUDIT_UNION = f"""audit AS (
SELECT {fmt_ts('created_at')} AS timestamp, 'branch_created' AS event_type, name AS branch,
  'branched from ' || parent_branch AS detail, CAST(NULL AS VARCHAR) AS migration_type, CAST(0 AS BIGINT) AS rows_loaded
FROM v_branches WHERE status != 'deleted'
UNION ALL
SELECT {fmt_ts('merged_at')}, 'branch_merged', name, 'merged into ' || parent_branch, NULL, 0
FROM v_branches WHERE status != 'deleted' AND merged_at IS NOT NULL
UNION ALL
SELECT {fmt_ts('m.applied_at')}, 'migration_applied', b.name, coalesce(m.description, ''), m.type, 0
FROM v_changes m JOIN v_branches b ON b.branch_id = m.branch_id
UNION ALL
SELECT {fmt_ts('s.completed_at')}, 'snapshot_completed', b.name, 'table: ' || s.table_name, NULL, s.rows_loaded
FROM v_snapshots s JOIN v_branches b ON b.branch_id = s.branch_id WHERE s.completed_at IS NOT NULL)"""


@query("audit_trail", hist("""
SELECT * FROM audit ORDER BY timestamp DESC, event_type, branch, detail, migration_type, rows_loaded LIMIT 100""",
                           _AUDIT_UNION))
def audit_trail(c: Ctx):
    """The 100 latest events of all four kinds, one global order."""
    return R.audit_trail(c.branches, c.recorded, c.snapshots, limit=100)


@query("audit_export", hist("SELECT * FROM audit", _AUDIT_UNION))
def audit_export(c: Ctx):
    """Write the whole audit trail as CSV with a header, read it back."""
    path = c.scratch() + "/audit_csv"
    trail = R.audit_trail(c.branches, c.recorded, c.snapshots, limit=None)
    R.export_audit(trail, path, "csv")
    return c.spark.read.schema(trail.schema).option("header", True).option("multiLine", True).csv(path)


@query("branch_list", hist("""
SELECT b.name, b.parent_branch, b.status, b.created_at,
  coalesce(m.n, 0) AS migration_count, coalesce(s.n, 0) AS snapshot_count
FROM v_branches b
LEFT JOIN (SELECT branch_id, count(DISTINCT migration_id) AS n FROM v_migrations GROUP BY 1) m ON m.branch_id = b.branch_id
LEFT JOIN (SELECT branch_id, count(*) AS n FROM v_snapshots WHERE status = 'ready' GROUP BY 1) s ON s.branch_id = b.branch_id
WHERE b.status IN ('active', 'merged')"""))
def branch_list(c: Ctx):
    return R.branch_list(c.branches, c.changes, c.snapshots, statuses=("active", "merged"))


@query("branch_totals", hist("""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'merged') AS merged
FROM v_branches WHERE status != 'deleted'"""))
def branch_totals(c: Ctx):
    return R.totals(c.branches)


@query("branch_search", hist("""
SELECT branch_id, name, parent_branch FROM v_branches
WHERE (contains(lower(name), 'building') OR contains(lower(parent_branch), 'building')) AND status = 'active'"""))
def branch_search(c: Ctx):
    return R.search(c.branches, "building", status="active")


@query("branch_parent", hist("""
SELECT b.branch_id, b.name, b.parent_branch, p.branch_id AS parent_id, p.status AS parent_status
FROM v_branches b LEFT JOIN v_branches p ON p.name = b.parent_branch"""))
def branch_parent(c: Ctx):
    return R.with_parent(c.branches)


_AHEAD = """ahead AS (
SELECT b.branch_id, b.name, b.parent_branch,
  coalesce(pc.n, 0) AS parent_changes,
  coalesce((SELECT count(*) FROM v_migrations pm WHERE pm.branch_id = p.branch_id AND pm.applied_at > b.created_at), 0)
    AS parent_changes_since
FROM v_branches b
LEFT JOIN v_branches p ON p.name = b.parent_branch AND p.status = 'active'
LEFT JOIN (SELECT branch_id, count(*) AS n FROM v_migrations GROUP BY 1) pc ON pc.branch_id = p.branch_id)"""


@query("parent_ahead", hist("SELECT branch_id, name, parent_branch, parent_changes, parent_changes_since FROM ahead",
                            _AHEAD))
def parent_ahead(c: Ctx):
    return R.parent_ahead(c.branches, c.changes)


@query("branch_divergence", hist("""
SELECT a.branch_id, a.name, coalesce(o.n, 0) AS ahead, a.parent_changes, a.parent_changes > 0 AS warn
FROM ahead a LEFT JOIN (SELECT branch_id, count(*) AS n FROM v_migrations GROUP BY 1) o ON o.branch_id = a.branch_id""",
                                 _AHEAD))
def branch_divergence(c: Ctx):
    return R.divergence(c.branches, c.changes)


_AGE_SECS = f"CAST(epoch(TIMESTAMP '{_REF}') - epoch(created_at) AS BIGINT)"


@query("age_bucket", hist(f"""
SELECT branch_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago'
  WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age
FROM (SELECT branch_id, {_AGE_SECS} AS s FROM v_branches)"""))
def age_bucket(c: Ctx):
    ref = F.lit(_REF).cast("timestamp_ntz")
    return c.branches.select("branch_id", FT.age_text(F.col("created_at"), ref).alias("age"))


@query("branch_namespace", hist("""
SELECT branch_id, 'branch_' || lower(translate(name, '/-. ', '____')) AS namespace FROM v_branches"""))
def branch_namespace(c: Ctx):
    return c.branches.select("branch_id", FT.namespace("name").alias("namespace"))


@query("namespace_collisions", hist("""
SELECT 'branch_' || lower(translate(name, '/-. ', '____')) AS namespace, count(*) AS n FROM v_branches
GROUP BY 1 HAVING count(*) > 1"""))
def namespace_collisions(c: Ctx):
    return R.namespace_collisions(c.branches)


@query("snapshot_exists", hist("""
SELECT b.branch_id, EXISTS (SELECT 1 FROM v_snapshots s WHERE s.branch_id = b.branch_id AND s.table_name = 'purchase')
  AS has_snapshot FROM v_branches b"""))
def snapshot_exists(c: Ctx):
    return R.snapshot_exists(c.branches, c.snapshots, "purchase")


_PROTECTED = "prot AS (SELECT name AS branch_name FROM v_branches WHERE name = 'main' OR contains(name, 'automobile'))"


@query("merge_gate", hist("""
SELECT b.branch_id, b.name, b.parent_branch FROM v_branches b
WHERE b.status = 'active' AND b.branch_id != 0 AND b.parent_branch IN (SELECT branch_name FROM prot)""", _PROTECTED))
def merge_gate(c: Ctx):
    return R.merge_gate(c.branches, H.protected(c.branches))


@query("latest_snapshot_state", """
SELECT user_id AS branch_id, event_type AS table_name, value AS last_value, ts AS updated_at, event_id
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_snapshot_state(c: Ctx):
    """Snapshot state events as upserts: the last one per (branch, table) wins."""
    ev = c.t("events").select(F.col("user_id").alias("branch_id"), F.col("event_type").alias("table_name"),
                              F.col("value").alias("last_value"), F.col("ts").alias("updated_at"), "event_id")
    from ..operators.history import latest_per
    return latest_per(ev, ["branch_id", "table_name"], "updated_at", "event_id") \
        .select("branch_id", "table_name", "last_value", "updated_at", "event_id")


@query("load_summary", hist("""
SELECT branch_id, CAST(coalesce(sum(rows_loaded) FILTER (WHERE status = 'ready'), 0) AS BIGINT) AS total_rows,
  coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (WHERE status = 'failed'), '') AS failed_tables
FROM v_snapshots GROUP BY branch_id"""))
def load_summary(c: Ctx):
    return R.load_summary(c.snapshots)


@query("load_progress", hist("""
SELECT branch_id, CAST(coalesce(sum(rows_loaded) FILTER (WHERE status = 'ready'), 0) AS BIGINT) AS loaded,
  CAST(sum(rows_loaded) AS BIGINT) AS total,
  round(coalesce(sum(rows_loaded) FILTER (WHERE status = 'ready'), 0) * 100.0 / nullif(sum(rows_loaded), 0), 1) AS pct
FROM v_snapshots GROUP BY branch_id"""))
def load_progress(c: Ctx):
    return R.load_progress(c.snapshots)


@query("branch_document", hist("""
SELECT b.branch_id, b.name, CAST(coalesce((m.sequence - 1) // 1000, 0) AS INT) AS part,
  count(m.migration_id) AS n_migrations, CAST(min(m.sequence) AS INT) AS first_sequence,
  CAST(max(m.sequence) AS INT) AS last_sequence,
  any_value(sn.n_snapshots) AS n_snapshots, any_value(sn.first_table) AS first_table, any_value(sn.last_table) AS last_table
FROM v_branches b
LEFT JOIN v_migrations m ON m.branch_id = b.branch_id
LEFT JOIN (SELECT branch_id, count(*) AS n_snapshots, min(table_name) AS first_table, max(table_name) AS last_table
           FROM v_snapshots GROUP BY 1) sn ON sn.branch_id = b.branch_id
WHERE b.status != 'deleted'
GROUP BY b.branch_id, b.name, 3"""))
def branch_document(c: Ctx):
    """Nested document per branch: {name, migrations[], snapshots[]}; the
    change list is split in parts of at most 1,000 (one hot branch never
    becomes one huge row).  Checked through lengths and first/last items."""
    return R.branch_documents(c.branches, c.changes, c.snapshots)


@query("apply_merge_status", hist("""
SELECT b.branch_id, b.name,
  CASE WHEN ev.branch_id IS NOT NULL THEN 'merged' ELSE b.status END AS status,
  CASE WHEN ev.branch_id IS NOT NULL THEN ev.last_change ELSE b.merged_at END AS merged_at
FROM v_branches b LEFT JOIN (
  SELECT m.branch_id, max(m.applied_at) AS last_change FROM v_changes m JOIN v_branches x ON x.branch_id = m.branch_id
  WHERE x.status = 'active' AND x.branch_id != 0 AND x.parent_branch = 'main' AND m.type IN ('ddl', 'seed')
  GROUP BY 1) ev ON ev.branch_id = b.branch_id"""))
def apply_merge_status(c: Ctx):
    """Merge every open top-level branch that has mergeable changes: a new
    version of the branch table with status and merge time updated."""
    return R.apply_merge_status(c.branches, c.recorded)


_PURGE = "purge AS (SELECT branch_id FROM v_branches WHERE status = 'deleted')"


@query("purge_branches", hist("""
SELECT 'branches' AS table_name, count(*) AS rows_before, count(*) FILTER (WHERE branch_id IN (SELECT branch_id FROM purge)) AS rows_purged
FROM v_branches
UNION ALL SELECT 'migrations', count(*), count(*) FILTER (WHERE branch_id IN (SELECT branch_id FROM purge)) FROM v_migrations
UNION ALL SELECT 'snapshots', count(*), count(*) FILTER (WHERE branch_id IN (SELECT branch_id FROM purge)) FROM v_snapshots
UNION ALL SELECT 'stashes', count(*), count(*) FILTER (WHERE branch_id IN (SELECT branch_id FROM purge)) FROM v_stashes""", _PURGE))
def purge_branches(c: Ctx):
    """Cascade delete of deleted branches over every history table:
    anti-join each table with the purge list; rows before / purged."""
    return R.purge(c.branches, {"branches": c.branches, "migrations": c.changes,
                                "snapshots": c.snapshots, "stashes": c.stashes})


@query("branch_json", hist("""
SELECT b.branch_id, coalesce(m.part, 0) AS part,
  CAST(to_json({name: b.name, parent_branch: b.parent_branch, status: b.status, migrations: coalesce(m.items, [])}) AS VARCHAR) AS document
FROM v_branches b LEFT JOIN (
  SELECT branch_id, CAST((sequence - 1) // 1000 AS INT) AS part,
    list({sequence: sequence, type: type, description: description, checksum: checksum} ORDER BY sequence) AS items
  FROM v_changes GROUP BY 1, 2) m ON m.branch_id = b.branch_id
WHERE b.status != 'deleted'"""))
def branch_json(c: Ctx):
    """The branch documents themselves, in parts."""
    return R.branch_json(c.branches, c.recorded)


@query("purged_history", hist("""
SELECT table_name, branch_id, count(*) AS rows_left FROM (
  SELECT 'migrations' AS table_name, branch_id FROM v_migrations
  UNION ALL SELECT 'snapshots', branch_id FROM v_snapshots
  UNION ALL SELECT 'stashes', branch_id FROM v_stashes
  UNION ALL SELECT 'tags', branch_id FROM v_branches
  UNION ALL SELECT 'tags', branch_id FROM v_branches)
WHERE branch_id NOT IN (SELECT branch_id FROM purge) GROUP BY 1, 2""", _PURGE))
def purged_history(c: Ctx):
    """What every history table, tags included, keeps once deleted branches are purged."""
    return R.without_purged({"migrations": c.changes, "snapshots": c.snapshots, "stashes": c.stashes,
                             "tags": HI.tags(c.branches, c.changes)}, c.branches)
