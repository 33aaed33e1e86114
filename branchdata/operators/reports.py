"""Reports over the history tables: audit trail, branch lists and rollups.

Per-branch counts are aggregated before any join (no one-to-many fan-out);
the branch table is joined to, never exploded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import TIME_FORMAT
from ..functions.text import namespace


def _fmt(c) -> F.Column:
    return F.date_format(c, TIME_FORMAT)


def audit_changes(changes: DataFrame, branches: DataFrame) -> DataFrame:
    b = branches.select("branch_id", F.col("name").alias("branch"))
    return changes.join(b, "branch_id").select(
        _fmt("applied_at").alias("timestamp"), "branch", "type",
        F.coalesce("description", F.lit("")).alias("detail"))


def audit_snapshots(snapshots: DataFrame, branches: DataFrame) -> DataFrame:
    b = branches.select("branch_id", F.col("name").alias("branch"))
    return (snapshots.filter(F.col("completed_at").isNotNull()).join(b, "branch_id")
            .select(_fmt("completed_at").alias("timestamp"), "branch", "table_name", "rows_loaded"))


def audit_union(branches: DataFrame, changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Four event kinds in one shape: timestamp, event_type, branch, detail,
    migration_type (NULL unless a change), rows_loaded (0 unless a load)."""
    live = branches.filter(F.col("status") != "deleted")
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    created = live.select(F.col("created_at").cast("timestamp").alias("at"), _fmt("created_at").alias("timestamp"), F.lit("branch_created").alias("event_type"),
                          F.col("name").alias("branch"),
                          F.concat(F.lit("branched from "), "parent_branch").alias("detail"),
                          none.alias("migration_type"), zero.alias("rows_loaded"))
    merged = live.filter(F.col("merged_at").isNotNull()).select(
        F.col("merged_at").cast("timestamp").alias("at"), _fmt("merged_at").alias("timestamp"), F.lit("branch_merged").alias("event_type"),
        F.col("name").alias("branch"), F.concat(F.lit("merged into "), "parent_branch").alias("detail"),
        none.alias("migration_type"), zero.alias("rows_loaded"))
    b = branches.select("branch_id", F.col("name").alias("branch"))
    applied = changes.join(b, "branch_id").select(
        F.col("applied_at").cast("timestamp").alias("at"), _fmt("applied_at").alias("timestamp"), F.lit("migration_applied").alias("event_type"), "branch",
        F.coalesce("description", F.lit("")).alias("detail"), F.col("type").alias("migration_type"),
        zero.alias("rows_loaded"))
    loaded = snapshots.filter(F.col("completed_at").isNotNull()).join(b, "branch_id").select(
        F.col("completed_at").cast("timestamp").alias("at"), _fmt("completed_at").alias("timestamp"), F.lit("snapshot_completed").alias("event_type"), "branch",
        F.concat(F.lit("table: "), "table_name").alias("detail"), none.alias("migration_type"),
        F.col("rows_loaded").cast("bigint").alias("rows_loaded"))
    return created.unionByName(merged).unionByName(applied).unionByName(loaded)


def audit_order() -> list:
    """Newest first by the whole time; ties broken on every column (a total order)."""
    return [F.desc("at"), F.asc("event_type"), F.asc("branch"), F.asc("detail"),
            F.asc_nulls_first("migration_type"), F.asc("rows_loaded")]


def audit_trail(branches: DataFrame, changes: DataFrame, snapshots: DataFrame,
                limit: int | None = None, branch: str | None = None,
                per_source_limit: int | None = None) -> DataFrame:
    """One global order (newest first) over all four kinds; the limit is
    applied after the sort (a top-k, no per-source cut).  ``per_source_limit``
    instead keeps the newest n of each kind (top-k per kind), then sorts."""
    u = audit_union(branches, changes, snapshots)
    if branch is not None:
        u = u.filter(F.col("branch") == branch)
    if per_source_limit is not None:
        parts = [u.filter(F.col("event_type") == kind).orderBy(*audit_order()).limit(per_source_limit)
                 for kind in ("branch_created", "branch_merged", "migration_applied", "snapshot_completed")]
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
    u = u.orderBy(*audit_order())
    return (u if limit is None else u.limit(limit)).drop("at")


def branch_list(branches: DataFrame, changes: DataFrame, snapshots: DataFrame,
                statuses: Sequence[str] = ("active", "merged")) -> DataFrame:
    m = changes.groupBy("branch_id").agg(F.count_distinct("migration_id").alias("migration_count"))
    s = (snapshots.filter(F.col("status") == "ready").groupBy("branch_id")
         .agg(F.count(F.lit(1)).alias("snapshot_count")))
    b = branches.filter(F.col("status").isin(*statuses))
    return (b.join(m, "branch_id", "left").join(s, "branch_id", "left")
             .select("name", "parent_branch", "status", "created_at",
                     F.coalesce("migration_count", F.lit(0)).alias("migration_count"),
                     F.coalesce("snapshot_count", F.lit(0)).alias("snapshot_count")))


def totals(branches: DataFrame) -> DataFrame:
    live = branches.filter(F.col("status") != "deleted")
    return live.agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(F.col("status") == "active").alias("active"),
                    F.count_if(F.col("status") == "merged").alias("merged"))


def search(branches: DataFrame, q: str, status: str | None = None) -> DataFrame:
    ql = q.lower()
    hit = F.lower("name").contains(ql) | F.lower("parent_branch").contains(ql)
    if status:
        hit = hit & (F.col("status") == status)
    return branches.filter(hit).select("branch_id", "name", "parent_branch")


def with_parent(branches: DataFrame) -> DataFrame:
    p = branches.select(F.col("name").alias("parent_branch"), F.col("branch_id").alias("parent_id"),
                        F.col("status").alias("parent_status"))
    return branches.select("branch_id", "name", "parent_branch").join(p, "parent_branch", "left") \
                   .select("branch_id", "name", "parent_branch", "parent_id", "parent_status")


def parent_ahead(branches: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of each branch's (active) parent: all of them, and those
    applied after the branch was created.

    "After creation" is a running count, not a join of every child with
    every parent change: parent changes and child creation probes are put on
    one time line per parent, and a running sum (balanced for hot parents)
    gives, at each probe, the parent changes up to that time.
    """
    from .scan import balanced_scan
    p = (branches.filter(F.col("status") == "active")
         .select(F.col("name").alias("parent_branch"), F.col("branch_id").alias("parent_id")))
    b = branches.select("branch_id", "name", "parent_branch", "created_at").join(p, "parent_branch", "left")
    per_parent = changes.groupBy(F.col("branch_id").alias("parent_id")).agg(F.count(F.lit(1)).alias("pc"))
    none = F.lit(None).cast("bigint")
    line = (changes.select(F.col("branch_id").alias("parent_id"), F.col("applied_at").alias("t"),
                           F.lit(1).alias("w"), F.lit(0).alias("kind"), none.alias("child"))
            .unionByName(b.filter(F.col("parent_id").isNotNull())
                          .select("parent_id", F.col("created_at").alias("t"), F.lit(0).alias("w"),
                                  F.lit(1).alias("kind"), F.col("branch_id").alias("child"))))
    # changes sort before a probe at the same time, so "up to" includes ties
    from ..functions.text import ntz_micros
    line = line.withColumn("_o", ntz_micros("t") * 2 + F.col("kind"))
    upto = (balanced_scan(line, ["parent_id"], "_o", sums={"_le": F.col("w")})
            .filter(F.col("kind") == 1)
            .select(F.col("child").alias("branch_id"), F.coalesce("_le", F.lit(0)).alias("_le")))
    return (b.join(per_parent, "parent_id", "left").join(upto, "branch_id", "left")
             .select("branch_id", "name", "parent_branch",
                     F.coalesce("pc", F.lit(0)).alias("parent_changes"),
                     (F.coalesce("pc", F.lit(0)) - F.coalesce("_le", F.lit(0))).alias("parent_changes_since")))


def divergence(branches: DataFrame, changes: DataFrame) -> DataFrame:
    own = changes.groupBy("branch_id").agg(F.count(F.lit(1)).alias("own"))
    a = parent_ahead(branches, changes)
    return (a.join(own, "branch_id", "left")
             .select("branch_id", "name", F.coalesce("own", F.lit(0)).alias("ahead"), "parent_changes",
                     (F.col("parent_changes") > 0).alias("warn")))


def namespace_collisions(branches: DataFrame) -> DataFrame:
    return (branches.groupBy(namespace("name").alias("namespace"))
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def snapshot_exists(branches: DataFrame, snapshots: DataFrame, table: str) -> DataFrame:
    has = snapshots.filter(F.col("table_name") == table).select("branch_id").distinct() \
                   .withColumn("has_snapshot", F.lit(True))
    return (branches.select("branch_id").join(has, "branch_id", "left")
            .select("branch_id", F.coalesce("has_snapshot", F.lit(False)).alias("has_snapshot")))


def merge_gate(branches: DataFrame, protected: DataFrame) -> DataFrame:
    open_ = branches.filter((F.col("status") == "active") & (F.col("branch_id") != 0))
    return (open_.join(protected.select(F.col("branch_name").alias("parent_branch")), "parent_branch", "left_semi")
            .select("branch_id", "name", "parent_branch"))


def load_summary(snapshots: DataFrame) -> DataFrame:
    ready = F.col("status") == "ready"
    failed = F.when(F.col("status") == "failed", F.col("table_name"))
    return snapshots.groupBy("branch_id").agg(
        F.coalesce(F.sum(F.when(ready, F.col("rows_loaded"))), F.lit(0)).cast("bigint").alias("total_rows"),
        F.array_join(F.array_sort(F.collect_list(failed)), ",").alias("failed_tables"))


def load_progress(snapshots: DataFrame) -> DataFrame:
    ready = F.col("status") == "ready"
    agg = snapshots.groupBy("branch_id").agg(
        F.coalesce(F.sum(F.when(ready, F.col("rows_loaded"))), F.lit(0)).cast("bigint").alias("loaded"),
        F.sum("rows_loaded").cast("bigint").alias("total"))
    return agg.withColumn("pct", F.round(F.col("loaded") * 100.0 / F.nullif(F.col("total"), F.lit(0)), 1))


def branch_documents(branches: DataFrame, changes: DataFrame, snapshots: DataFrame,
                     part_size: int = 1000) -> DataFrame:
    item = F.struct(F.col("sequence").cast("int").alias("sequence"), "migration_id")
    parts = (changes.groupBy("branch_id", ((F.col("sequence") - 1) / part_size).cast("int").alias("part"))
             .agg(F.array_sort(F.collect_list(item)).alias("migrations")))
    snaps = (snapshots.groupBy("branch_id")
             .agg(F.array_sort(F.collect_list(F.struct("table_name", "status", "rows_loaded"))).alias("snapshots")))
    docs = (branches.filter(F.col("status") != "deleted").select("branch_id", "name")
            .join(parts, "branch_id", "left").join(snaps, "branch_id", "left"))
    return docs.select(
        "branch_id", "name", F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce(F.size("migrations"), F.lit(0)).cast("bigint").alias("n_migrations"),
        F.element_at("migrations", 1).sequence.alias("first_sequence"),
        F.element_at("migrations", -1).sequence.alias("last_sequence"),
        F.size("snapshots").cast("bigint").alias("n_snapshots"),
        F.element_at("snapshots", 1).table_name.alias("first_table"),
        F.element_at("snapshots", -1).table_name.alias("last_table"))


def apply_merge_status(branches: DataFrame, recorded: DataFrame) -> DataFrame:
    open_top = branches.filter((F.col("status") == "active") & (F.col("branch_id") != 0)
                               & (F.col("parent_branch") == "main")).select("branch_id")
    ev = (recorded.filter(F.col("type").isin("ddl", "seed")).join(open_top, "branch_id", "left_semi")
          .groupBy("branch_id").agg(F.max("applied_at").alias("last_change")))
    j = branches.join(ev, "branch_id", "left")
    hit = F.col("last_change").isNotNull()
    return j.select("branch_id", "name",
                    F.when(hit, F.lit("merged")).otherwise(F.col("status")).alias("status"),
                    F.when(hit, F.col("last_change")).otherwise(F.col("merged_at")).alias("merged_at"))


def purge(branches: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows before and rows purged per history table; the kept rows are the
    anti-join with the purge list."""
    gone = branches.filter(F.col("status") == "deleted").select("branch_id").withColumn("_gone", F.lit(True))
    out = None
    for name, df in tables.items():
        part = (df.select("branch_id").join(gone, "branch_id", "left")
                .agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(F.col("_gone").isNotNull()).alias("rows_purged"))
                .select(F.lit(name).alias("table_name"), "rows_before", "rows_purged"))
        out = part if out is None else out.unionByName(part)
    return out


def purged(df: DataFrame, branches: DataFrame) -> DataFrame:
    """A history table without the rows of deleted branches."""
    gone = branches.filter(F.col("status") == "deleted").select("branch_id")
    return df.join(gone, "branch_id", "left_anti")


def export_audit(trail: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write an audit trail: ``csv`` with a header and six columns, ``json``
    with empty fields left out (an empty migration type and a zero row count
    become NULL, which the JSON writer omits), or ``text`` as fixed-width
    lines, one an event (line ends inside a detail become spaces; in CSV they
    stay, quoted: read it with ``multiLine``).  Executors write in parallel; nothing passes through the driver."""
    if fmt == "csv":
        trail.write.option("header", True).mode("error").csv(path)
    elif fmt == "json":
        (trail.withColumn("migration_type", F.when(F.col("migration_type") != "", F.col("migration_type")))
              .withColumn("rows_loaded", F.when(F.col("rows_loaded") != 0, F.col("rows_loaded")))
              .write.mode("error").json(path))
    elif fmt == "text":
        line = F.format_string("%-20s  %-22s  %-20s  %s", F.col("timestamp"), F.col("event_type"),
                               F.col("branch"), F.regexp_replace("detail", r"\s*[\r\n]\s*", " "))
        trail.select(line.alias("value")).write.mode("error").text(path)
    else:
        raise ValueError(f"unknown audit format {fmt!r}")


def change_log(recorded: DataFrame, branches: DataFrame, change_type: str | None = None,
               branch: str | None = None, limit: int | None = None) -> DataFrame:
    """Latest ``limit`` changes (all of them without one), optionally of one type and
    one branch: sequence, branch, type, description, time, merge label."""
    from ..functions.changes import merge_label
    m = recorded
    if change_type is not None:
        m = m.filter(F.col("type") == change_type)
    b = branches.select("branch_id", F.col("name").alias("branch"))
    if branch is not None:
        m = m.join(b.filter(F.col("branch") == branch).select("branch_id"), "branch_id", "left_semi")
    top = m.orderBy(F.desc("applied_at"), F.desc("migration_id"))
    if limit is not None:
        top = top.limit(limit)
    return (top.join(b, "branch_id")
            .select("sequence", "branch", "type", F.coalesce("description", F.lit("")).alias("description"),
                    _fmt("applied_at").alias("applied_at"), merge_label("type").alias("on_merge")))


def branch_json(branches: DataFrame, recorded: DataFrame, part_size: int = 1000) -> DataFrame:
    """The document of each branch that isn't deleted, as JSON in parts of at
    most ``part_size`` changes: (branch_id, part, document)."""
    item = F.struct(F.col("sequence").cast("int").alias("sequence"), "type", "description", "checksum")
    parts = (recorded.groupBy("branch_id", ((F.col("sequence") - 1) / part_size).cast("int").alias("part"))
             .agg(F.array_sort(F.collect_list(item)).alias("migrations")))
    docs = (branches.filter(F.col("status") != "deleted").select("branch_id", "name", "parent_branch", "status")
            .join(parts, "branch_id", "left"))
    none = F.array().cast("array<struct<sequence:int,type:string,description:string,checksum:string>>")
    return docs.select("branch_id", F.coalesce("part", F.lit(0)).alias("part"),
                       F.to_json(F.struct("name", "parent_branch", "status", F.coalesce("migrations", none).alias("migrations")))
                       .alias("document"))


def without_purged(tables: Mapping[str, DataFrame], branches: DataFrame) -> DataFrame:
    """The rows of the history tables, tags included, that are left once
    deleted branches are purged: (table_name, branch_id, rows_left)."""
    left = [purged(df.select("branch_id"), branches).groupBy("branch_id").agg(F.count(F.lit(1)).alias("rows_left"))
            .select(F.lit(name).alias("table_name"), "branch_id", "rows_left") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, left)
