"""Branch history tables derived from the driver tables.

The tool we mirror keeps four history tables (branches, changes, load
snapshots, stashes/tags/protections).  Tests and queries derive them from
the driver tables so that their size grows with the scale factor:

* ``branches``  one per customer; the parent of ``k`` is ``k div 5``;
  customer 0 is ``main`` and its own parent;
* ``changes``   one per order, numbered per branch in time order; the
  statement text is drawn from twelve shapes by ``o_orderkey % 12``;
* ``snapshots`` one per (user, event type) of ``events``;
* ``stashes``   one per (branch, year of its changes);
* ``tags``      per branch: ``head`` at the last change, ``half`` halfway;
* ``protected`` ``main`` and every branch of the automobile segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import DETECT, number_rows
from .tables import Source


def _branch_name(key, segment):
    return (F.when(key == 0, F.lit("main"))
             .otherwise(F.concat(F.lit("feature/"), F.lower(segment), F.lit("-"),
                                 key.cast("string"))))


def branches(src: Source) -> DataFrame:
    cust = src.table("customer").select("c_custkey", "c_mktsegment")
    orders = src.table("orders")
    first_last = (orders.groupBy("o_custkey")
                  .agg(F.min("o_orderdate").alias("first_ts"),
                       F.max("o_orderdate").alias("last_ts")))
    earliest = orders.select(F.min("o_orderdate")).scalar()
    parent = cust.select(F.col("c_custkey").alias("p_key"),
                         F.col("c_mktsegment").alias("p_seg"))
    c = cust.withColumn("p_ref", F.floor(F.col("c_custkey") / 5).cast("bigint"))
    key = F.col("c_custkey")
    return (c.join(parent, c.p_ref == parent.p_key, "inner")
             .join(first_last, c.c_custkey == first_last.o_custkey, "left")
             .select(key.alias("branch_id"),
                     _branch_name(key, F.col("c_mktsegment")).alias("name"),
                     _branch_name(F.col("p_key"), F.col("p_seg")).alias("parent_branch"),
                     F.when(key == 0, "active").when(key % 7 == 3, "merged")
                      .when(key % 11 == 5, "deleted").otherwise("active").alias("status"),
                     F.coalesce(F.col("first_ts"), earliest).alias("created_at"),
                     F.when(key % 7 == 3, F.col("last_ts")).alias("merged_at")))


def change_text(key):
    k50 = (key % 50).cast("string")
    kind, shape = key % 12, key % 24
    return (F.when(shape == 12, F.concat(F.lit("ALTER TABLE public.users ADD COLUMN IF NOT EXISTS c"), k50, F.lit(" TEXT")))
             .when(shape == 13, F.concat(F.lit("CREATE TABLE IF NOT EXISTS t"), k50, F.lit(" (id INT)")))
             .when(shape == 14, F.concat(F.lit("CREATE INDEX IF NOT EXISTS idx_"), k50, F.lit(" ON users(email)")))
             .when(shape == 16, F.concat(F.lit("/* @seed */ INSERT INTO public.prices (id, label) VALUES ("), k50,
                                         F.lit(", 'a, b'), ('k"), (key % 7).cast("string"), F.lit("', lower('c'))")))
             .when(shape == 17, F.concat(F.lit("ALTER TABLE users ADD COLUMN d"), k50, F.lit(" INT, DROP COLUMN status")))
             .when(shape == 18, F.concat(F.lit("ALTER TABLE ONLY users DROP COLUMN IF EXISTS c"), k50))
             .when(shape == 19, F.lit("ALTER TABLE users ALTER COLUMN plan TYPE varchar"))
             .when(shape == 20, F.concat(F.lit("DROP TABLE IF EXISTS t"), k50))
             .when(shape == 21, F.concat(F.lit("CREATE TABLE w"), k50,
                                         F.lit(" (\n  id INT,\n  price NUMERIC(10,2),\n  name TEXT\n)")))
             .when(shape == 23, F.concat(F.lit("/* two\n   lines */\nALTER TABLE w"), k50, F.lit("\n  DROP COLUMN name")))
             .when(shape == 22, F.concat(F.lit("ALTER TABLE users RENAME COLUMN name TO c"), k50))
             .when(kind == 0, F.concat(F.lit("ALTER TABLE users ADD COLUMN c"), k50, F.lit(" TEXT")))
             .when(kind == 1, F.concat(F.lit("CREATE TABLE t"), k50, F.lit(" (id INT)")))
             .when(kind == 2, F.concat(F.lit("CREATE INDEX idx_"), k50, F.lit(" ON users(email)")))
             .when(kind == 3, F.concat(F.lit("INSERT INTO users VALUES ("), k50, F.lit(")")))
             .when(kind == 4, F.concat(F.lit("/* @seed */ INSERT INTO plans VALUES ("), k50, F.lit(")")))
             .when(kind == 5, F.lit("UPDATE users SET name = 'x'"))
             .when(kind == 6, F.concat(F.lit("ALTER TABLE users DROP COLUMN c"), k50))
             .when(kind == 7, F.lit("TRUNCATE users"))
             .when(kind == 8, F.concat(F.lit("  drop table t"), k50, F.lit("  ")))
             .when(kind == 9, F.concat(F.lit("CREATE UNIQUE INDEX ux_"), k50, F.lit(" ON users(email)")))
             .when(kind == 10, F.lit("ALTER TABLE orders RENAME COLUMN amount TO total"))
             .otherwise(F.concat(F.lit("DELETE FROM users WHERE id = "), k50)))


def hot_branches(src: Source):
    """Keys of branches with very many changes (see ``number_rows``), found
    on the one column that defines the branch of a change; None if none."""
    from ..operators.numbering import collect_hot
    return collect_hot(src.table("orders").select(F.col("o_custkey").alias("branch_id")), ["branch_id"])


def changes(src: Source, hot=DETECT) -> DataFrame:
    """(migration_id, branch_id, sequence, sql_text, applied_at).  ``hot``:
    hot branch keys if already known (else found here)."""
    o = src.table("orders").select(
        F.col("o_orderkey").alias("migration_id"),
        F.col("o_custkey").alias("branch_id"),
        change_text(F.col("o_orderkey")).alias("sql_text"),
        F.col("o_orderdate").alias("applied_at"))
    return (number_rows(o, ["branch_id"], ["applied_at", "migration_id"], out="sequence", hot=hot)
            .select("migration_id", "branch_id", "sequence", "sql_text", "applied_at"))


def snapshots(src: Source) -> DataFrame:
    """(branch_id, table_name, status, rows_loaded, completed_at)."""
    ev = src.table("events")
    return (ev.groupBy(F.col("user_id").alias("branch_id"), F.col("event_type").alias("table_name"))
              .agg(F.count(F.lit(1)).alias("rows_loaded"), F.max("ts").alias("max_ts"))
              .select("branch_id", "table_name",
                      F.when(F.col("table_name") == "error", "failed")
                       .when(F.col("table_name") == "view", "loading")
                       .when(F.col("table_name") == "click", "paused")
                       .otherwise("ready").alias("status"),
                      "rows_loaded",
                      F.when(F.col("table_name").isin("signup", "purchase"), F.col("max_ts"))
                       .alias("completed_at")))


def stashes(changes_df: DataFrame) -> DataFrame:
    """One stash per (branch, year of change): id, branch, message, created_at,
    change count."""
    yr = F.year("applied_at")
    return (changes_df.groupBy("branch_id", yr.alias("yr"))
            .agg(F.max("applied_at").alias("created_at"),
                 F.count(F.lit(1)).alias("migration_count"))
            .select(F.sha2(F.concat_ws(":", F.col("branch_id").cast("string"),
                                       F.col("yr").cast("string")), 256).alias("stash_id"),
                    "branch_id",
                    F.concat(F.lit("wip "), F.col("yr").cast("string")).alias("message"),
                    "created_at", "migration_count"))


def protected(branches_df: DataFrame) -> DataFrame:
    return (branches_df.filter((F.col("name") == "main") | F.col("name").contains("automobile"))
            .select(F.col("name").alias("branch_name"),
                    F.lit("release line").alias("reason")))
