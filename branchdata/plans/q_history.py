"""Registered queries: change history (classify, number, select, stash, tag)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import changes as FC
from ..functions import text as FT
from ..operators import history as HI
from ..sources.history_store import HistoryStore
from . import settings as S
from .registry import Ctx, query
from .sqlparts import cdesc, checksum, ctype, hist, trim

CUTOFF = "1999-01-01 00:00:00"


@query("change_type", hist("SELECT migration_id, type FROM v_changes"))
def change_type(c: Ctx):
    return c.changes.select("migration_id", FC.change_type(F.col("sql_text")).alias("type"))


@query("change_description", hist("SELECT migration_id, description FROM v_changes"))
def change_description(c: Ctx):
    return c.changes.select("migration_id", FC.change_description(F.col("sql_text")).alias("description"))


@query("change_checksum", hist("SELECT migration_id, checksum FROM v_changes"))
def change_checksum(c: Ctx):
    return c.changes.select("migration_id", FT.checksum16("sql_text").alias("checksum"))


@query("clone_checksum", hist("SELECT migration_id, lower(substr(hex(sql_text), 1, 16)) AS checksum FROM v_migrations"))
def clone_checksum(c: Ctx):
    return c.changes.select("migration_id", FT.hex_prefix16("sql_text").alias("checksum"))


_COLLAPSE = "regexp_replace({t}, '[ \\t\\n]+', ' ', 'g')".format(t=trim("sql_text"))


@query("text_normalise", hist(f"""
SELECT migration_id, {trim('sql_text')} AS trimmed,
  CASE WHEN length({_COLLAPSE}) > 50 THEN left({_COLLAPSE}, 50) || '...' ELSE {_COLLAPSE} END AS collapsed
FROM v_migrations"""))
def text_normalise(c: Ctx):
    return c.changes.select("migration_id", FT.trim_ws("sql_text").alias("trimmed"),
                            FT.collapse_ws("sql_text", 50).alias("collapsed"))


@query("text_truncate", hist("""
SELECT migration_id, CASE WHEN length(sql_text) > 30 THEN left(sql_text, 27) || '...' ELSE sql_text END AS cut
FROM v_migrations"""))
def text_truncate(c: Ctx):
    return c.changes.select("migration_id", FT.cut("sql_text", 30).alias("cut"))


def _objects_sql() -> str:
    from .sqlparts import body_expr, object_exprs
    e = object_exprs("body")
    return hist(f"""SELECT migration_id, {e['op']} AS op, {e['table_name']} AS table_name,
  {e['column_name']} AS column_name, {e['detail']} AS detail
FROM (SELECT migration_id, {body_expr('sql_text')} AS body FROM v_migrations)""")


@query("change_objects", _objects_sql())
def change_objects(c: Ctx):
    return (FC.with_objects(c.changes.select("migration_id", "sql_text"))
            .select("migration_id", "op", "table_name", "column_name", "detail"))


@query("assign_sequence", hist("SELECT migration_id, branch_id, sequence FROM v_migrations"))
def assign_sequence(c: Ctx):
    """Sequence per branch in arrival order (balanced for hot branches)."""
    return c.changes.select("migration_id", "branch_id", "sequence")


@query("record_changes", hist(f"""
SELECT migration_id, branch_id,
  CAST(coalesce(h.head, 0) + row_number() OVER (PARTITION BY branch_id ORDER BY applied_at, migration_id) AS INT) AS sequence,
  {trim('sql_text')} AS sql_text, type, description, checksum
FROM v_changes LEFT JOIN (SELECT branch_id AS hb, max(sequence) AS head FROM v_migrations
                          WHERE applied_at < TIMESTAMP '{CUTOFF}' GROUP BY 1) h ON h.hb = v_changes.branch_id
WHERE applied_at >= TIMESTAMP '{CUTOFF}'"""))
def record_changes(c: Ctx):
    """Record the statements that arrived after the cut-off on top of the
    history before it: trimmed, typed, described, fingerprinted, numbered
    after each branch's last sequence."""
    ch = c.changes
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    existing = ch.filter(F.col("applied_at") < cut)
    batch = ch.filter(F.col("applied_at") >= cut).select("migration_id", "branch_id", "sql_text", "applied_at")
    rec = HI.record(existing, batch)
    return rec.select("migration_id", "branch_id", "sequence", "sql_text", "type", "description", "checksum")


@query("next_sequence", hist("""
SELECT b.branch_id, CAST(coalesce(max(m.sequence), 0) + 1 AS INT) AS next_sequence
FROM v_branches b LEFT JOIN v_migrations m ON m.branch_id = b.branch_id GROUP BY b.branch_id"""))
def next_sequence(c: Ctx):
    return HI.next_sequence(c.branches, c.changes)


@query("change_count", hist("""
SELECT b.branch_id, count(m.migration_id) AS migration_count
FROM v_branches b LEFT JOIN v_migrations m ON m.branch_id = b.branch_id GROUP BY b.branch_id"""))
def change_count(c: Ctx):
    return HI.counts(c.branches, c.changes)


@query("branch_head", hist("""
SELECT b.branch_id, b.name, CAST(coalesce(max(m.sequence), 0) AS INT) AS head_sequence
FROM v_branches b LEFT JOIN v_migrations m ON m.branch_id = b.branch_id GROUP BY b.branch_id, b.name"""))
def branch_head(c: Ctx):
    return HI.heads(c.branches, c.changes)


@query("mergeable_changes", hist("""
SELECT migration_id, branch_id, sequence, type FROM v_changes WHERE type IN ('ddl', 'seed')"""))
def mergeable_changes(c: Ctx):
    return HI.mergeable(c.recorded).select("migration_id", "branch_id", "sequence", "type")


@query("change_list", hist("""
SELECT branch_id, sequence, type, description,
  CASE WHEN type IN ('ddl', 'seed') THEN 'travels' ELSE 'discarded' END AS on_merge FROM v_changes"""))
def change_list(c: Ctx):
    return (HI.with_merge_label(c.recorded)
            .select("branch_id", "sequence", "type", "description", "on_merge")
            .orderBy("branch_id", "sequence"))


@query("change_log", hist(f"""
SELECT m.sequence, b.name AS branch, m.type, coalesce(m.description, '') AS description,
  strftime(m.applied_at, '%Y-%m-%d %H:%M:%S') AS applied_at,
  CASE WHEN m.type IN ('ddl', 'seed') THEN 'travels' ELSE 'discarded' END AS on_merge
FROM v_changes m JOIN v_branches b ON b.branch_id = m.branch_id
WHERE m.type = 'ddl' ORDER BY m.applied_at DESC, m.migration_id DESC LIMIT 20"""))
def change_log(c: Ctx):
    """Latest 20 ddl changes over all branches (a top-k report)."""
    from ..operators.reports import change_log as log
    return log(c.recorded, c.branches, change_type="ddl", limit=20)


@query("reset_last_n", hist("""
SELECT m.branch_id, m.sequence, m.migration_id FROM v_migrations m
JOIN (SELECT branch_id, max(sequence) AS head FROM v_migrations GROUP BY 1) h USING (branch_id)
WHERE m.sequence > h.head - 3"""))
def reset_last_n(c: Ctx):
    return HI.last_n(c.changes, 3).select("branch_id", "sequence", "migration_id")


@query("reset_remaining", hist("""
SELECT m.branch_id, m.sequence, m.migration_id FROM v_migrations m
JOIN (SELECT branch_id, max(sequence) AS head FROM v_migrations GROUP BY 1) h USING (branch_id)
WHERE m.sequence <= h.head - 3"""))
def reset_remaining(c: Ctx):
    return HI.without_last_n(c.changes, 3).select("branch_id", "sequence", "migration_id")


_TAGS = """v_tags AS (
SELECT 'head' AS tag, b.branch_id, CAST(coalesce(max(m.sequence), 0) AS INT) AS tag_sequence
FROM v_branches b LEFT JOIN v_migrations m ON m.branch_id = b.branch_id GROUP BY b.branch_id
UNION ALL
SELECT 'half', b.branch_id, CAST(coalesce(max(m.sequence), 0) // 2 AS INT)
FROM v_branches b LEFT JOIN v_migrations m ON m.branch_id = b.branch_id GROUP BY b.branch_id)"""


@query("changes_at_tag", hist("""
SELECT t.tag, m.branch_id, m.sequence, m.migration_id FROM v_migrations m JOIN v_tags t USING (branch_id)
WHERE m.sequence <= t.tag_sequence""", _TAGS))
def changes_at_tag(c: Ctx):
    return (HI.at_tag(c.changes, HI.tags(c.branches, c.changes))
            .select("tag", "branch_id", "sequence", "migration_id"))


@query("clone_history", hist("""
SELECT b.name || '-copy' AS new_branch,
  CAST(row_number() OVER (PARTITION BY m.branch_id ORDER BY m.sequence) AS INT) AS sequence,
  m.sql_text, m.type, 'cloned from ' || b.name AS description, m.checksum,
  CAST(count(*) OVER (PARTITION BY m.branch_id) AS INT) AS branched_at_seq
FROM v_changes m JOIN v_branches b ON b.branch_id = m.branch_id WHERE b.status = 'merged'"""))
def clone_history(c: Ctx):
    """Clone every merged branch's history to '<name>-copy'."""
    src = c.branches.filter(F.col("status") == "merged")
    return HI.clone(c.recorded, src)


# ---------------------------------------------------------------- stashes


@query("stash_pack", hist("""
SELECT branch_id, CAST((sequence - 1) // 1000 AS INT) AS part, count(*) AS migration_count,
  count(*) AS n_items, arg_min(checksum, sequence) AS first_checksum, arg_max(checksum, sequence) AS last_checksum
FROM v_changes GROUP BY 1, 2"""))
def stash_pack(c: Ctx):
    """Pack each branch's changes into JSON documents (at most 1,000 changes
    each), then read the documents to check their content."""
    packed = HI.pack(c.recorded)
    items = F.from_json("payload", "struct<migrations: array<struct<sequence: int, checksum: string>>>")
    return packed.select("branch_id", "part", "migration_count", items.alias("d")).select(
        "branch_id", "part", "migration_count", F.size("d.migrations").cast("bigint").alias("n_items"),
        F.element_at("d.migrations", 1).checksum.alias("first_checksum"),
        F.element_at("d.migrations", -1).checksum.alias("last_checksum"))


@query("stash_unpack", hist("""
SELECT branch_id, sequence, sql_text, type, description, checksum FROM v_changes"""))
def stash_unpack(c: Ctx):
    """Pack then unpack: must give back exactly the recorded rows."""
    return HI.unpack(HI.pack(c.recorded)).select("branch_id", "sequence", "sql_text", "type",
                                                 "description", "checksum")


@query("stash_latest", hist("""
SELECT branch_id, stash_id, message, created_at, migration_count FROM v_stashes
QUALIFY row_number() OVER (PARTITION BY branch_id ORDER BY created_at DESC, stash_id DESC) = 1"""))
def stash_latest(c: Ctx):
    return HI.latest_per(c.stashes, ["branch_id"], "created_at", "stash_id") \
             .select("branch_id", "stash_id", "message", "created_at", "migration_count")


@query("stash_list", hist("""
SELECT branch_id, stash_id, CAST(row_number() OVER (PARTITION BY branch_id ORDER BY created_at DESC, stash_id DESC) - 1 AS INT)
  AS stash_index FROM v_stashes"""))
def stash_list(c: Ctx):
    return HI.numbered_newest_first(c.stashes).select("branch_id", "stash_id", "stash_index")


@query("stash_drop_latest", hist("""
SELECT branch_id, stash_id FROM v_stashes
QUALIFY row_number() OVER (PARTITION BY branch_id ORDER BY created_at DESC, stash_id DESC) > 1"""))
def stash_drop_latest(c: Ctx):
    latest = HI.latest_per(c.stashes, ["branch_id"], "created_at", "stash_id").select("stash_id")
    return c.stashes.join(latest, "stash_id", "left_anti").select("branch_id", "stash_id")


@query("id_prefix_match", hist("""
SELECT stash_id, left(stash_id, 8) AS short_id, branch_id FROM v_stashes WHERE starts_with(stash_id, 'ab')"""))
def id_prefix_match(c: Ctx):
    return (c.stashes.filter(F.col("stash_id").startswith("ab"))
            .select("stash_id", FT.short_id("stash_id").alias("short_id"), "branch_id"))


@query("insert_ignore", hist(f"""
SELECT branch_id, sequence, sql_text FROM v_migrations WHERE applied_at < TIMESTAMP '{CUTOFF}'
UNION ALL
SELECT i.branch_id, i.sequence, 'popped: ' || i.sql_text FROM v_migrations i
WHERE i.applied_at >= TIMESTAMP '1998-01-01 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM v_migrations e WHERE e.applied_at < TIMESTAMP '{CUTOFF}'
                  AND e.branch_id = i.branch_id AND e.sequence = i.sequence)"""))
def insert_ignore(c: Ctx):
    """Stash pop: rows come back, rows whose (branch, sequence) exists stay as they are."""
    ch = c.changes
    existing = ch.filter(F.col("applied_at") < F.lit(CUTOFF).cast("timestamp_ntz")) \
                 .select("branch_id", "sequence", "sql_text")
    incoming = (ch.filter(F.col("applied_at") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
                  .select("branch_id", "sequence", F.concat(F.lit("popped: "), "sql_text").alias("sql_text")))
    return HI.insert_ignore(existing, incoming, ["branch_id", "sequence"])


@query("sequence_name", hist("""
SELECT branch_id, 'branch_' || lower(translate(name, '/-. ', '____')) AS namespace, 'users_id_seq' AS seq_name,
  'nextval(''' || 'branch_' || lower(translate(name, '/-. ', '____')) || '.users_id_seq''::regclass)' AS branch_default
FROM v_branches"""))
def sequence_name(c: Ctx):
    """Identity default of the users table re-pointed at each branch's namespace."""
    d = F.lit("nextval('public.users_id_seq'::regclass)")
    ns = FT.namespace("name")
    return c.branches.select("branch_id", ns.alias("namespace"), FT.sequence_name(d).alias("seq_name"),
                             FT.requalify_sequence(d, ns).alias("branch_default"))


@query("change_diff", hist(f"""
SELECT c.branch_id, c.sequence, c.type, c.description FROM v_changes c
JOIN v_branches b ON b.branch_id = c.branch_id JOIN v_branches p ON p.name = b.parent_branch
WHERE NOT EXISTS (SELECT 1 FROM v_migrations pm WHERE pm.branch_id = p.branch_id
                  AND {trim('pm.sql_text')} = {trim('c.sql_text')})"""))
def change_diff(c: Ctx):
    """Changes a branch has and its parent lacks, compared on trimmed text."""
    return HI.diff_vs_parent(c.recorded, c.branches).select("branch_id", "sequence", "type", "description")


@query("history_sinks", hist("""
SELECT 'branches' AS table_name, branch_id, count(*) AS n, max(status) AS detail FROM v_branches GROUP BY branch_id
UNION ALL SELECT 'changes', branch_id, count(*), max(checksum) FROM v_changes GROUP BY branch_id
UNION ALL SELECT 'tags', branch_id, count(*), max(tag) FROM v_tags GROUP BY branch_id
UNION ALL SELECT 'stashes', branch_id, count(*), max(message) FROM v_stashes GROUP BY branch_id""", _TAGS))
def history_sinks(c: Ctx):
    """Branches, changes, tags and stashes appended to the history store: every
    table in two batches, the second sent twice; branches and tags first with
    what they were before, then as they are.  Read back per branch."""
    store = HistoryStore(c.spark, c.scratch())
    tags = HI.tags(c.branches, c.changes).select("tag", "branch_id", "tag_sequence")
    early = {"branches": c.branches.withColumn("status", F.lit("active")), "tags": tags.withColumn("tag_sequence", F.lit(0)),
             "changes": c.recorded.where("sequence <= 5"), "stashes": c.stashes.where("migration_count > 1")}
    late = {"branches": c.branches, "tags": tags, "changes": c.recorded.where("sequence > 5"), "stashes": c.stashes}
    for batch, tables in (("first", early), ("second", late), ("second", late)):
        for name, rows in tables.items():
            store.append(name, rows, batch)
    detail = {"branches": "status", "changes": "checksum", "tags": "tag", "stashes": "message"}
    return reduce(DataFrame.unionByName, [
        store.current(t).groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("detail"))
        .select(F.lit(t).alias("table_name"), "branch_id", "n", "detail") for t, d in detail.items()])
