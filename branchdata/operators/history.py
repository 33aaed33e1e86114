"""Change history: record, classify, number, select, pack and restore.

Change rows are partitioned by branch; every per-branch step is either an
aggregate (partial aggregation first, so a hot branch is combined map-side)
or goes through ``number_rows`` (balanced numbering for hot branches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MERGEABLE_TYPES, SEED_MARKER
from ..functions.changes import change_description, change_type, merge_label
from ..functions.text import checksum16, trim_ws
from .numbering import number_rows

CHANGE_STRUCT = T.StructType([
    T.StructField("sequence", T.IntegerType()),
    T.StructField("sql", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("checksum", T.StringType()),
])


def classify(changes: DataFrame, sql_col: str = "sql_text", marker: str = SEED_MARKER,
             extended: bool = False) -> DataFrame:
    """Add type, description and checksum of each change; a type or
    description that a change brings along stays."""
    s = F.col(sql_col)

    def given(name: str, found: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), found) if name in changes.columns else found
    return changes.withColumns({
        "type": given("type", change_type(s, marker, extended)),
        "description": given("description", change_description(s)),
        "checksum": checksum16(s),
    })


def next_sequence(branches: DataFrame, changes: DataFrame) -> DataFrame:
    """(branch_id, next_sequence) = coalesce(max(sequence), 0) + 1 for every branch."""
    heads = changes.groupBy("branch_id").agg(F.max("sequence").alias("head"))
    return (branches.select("branch_id").join(heads, "branch_id", "left")
            .select("branch_id", (F.coalesce("head", F.lit(0)) + 1).cast("int").alias("next_sequence")))


def record(existing: DataFrame, batch: DataFrame, marker: str = SEED_MARKER) -> DataFrame:
    """Record a batch of statements (branch_id, migration_id, sql_text,
    applied_at): trim, drop empty ones, classify, fingerprint, and number
    them after each branch's current last sequence (in arrival order)."""
    clean = (batch.withColumn("sql_text", trim_ws("sql_text"))
                  .filter(F.length("sql_text") > 0))
    numbered = number_rows(clean, ["branch_id"], ["applied_at", "migration_id"], out="_rn")
    heads = existing.groupBy("branch_id").agg(F.max("sequence").alias("_head"))
    out = (numbered.join(heads, "branch_id", "left")
                   .withColumn("sequence", (F.coalesce("_head", F.lit(0)) + F.col("_rn")).cast("int"))
                   .drop("_rn", "_head"))
    return classify(out, "sql_text", marker)


def mergeable(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("type").isin(*MERGEABLE_TYPES))


def counts(branches: DataFrame, changes: DataFrame) -> DataFrame:
    c = changes.groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"))
    return (branches.select("branch_id").join(c, "branch_id", "left")
            .select("branch_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("migration_count")))


def heads(branches: DataFrame, changes: DataFrame) -> DataFrame:
    """(branch_id, name, head_sequence): last sequence, 0 without changes."""
    h = changes.groupBy("branch_id").agg(F.max("sequence").alias("h"))
    return (branches.select("branch_id", "name").join(h, "branch_id", "left")
            .select("branch_id", "name", F.coalesce("h", F.lit(0)).cast("int").alias("head_sequence")))


def last_n(changes: DataFrame, n: int) -> DataFrame:
    """The last ``n`` changes of every branch, by rank: sequences may have
    gaps.  Spark limits each partition to n rows a branch before the shuffle."""
    return changes.withColumn("_rank", _from_last()).filter(F.col("_rank") <= n).drop("_rank")


def _from_last():
    from pyspark.sql import Window
    return F.row_number().over(Window.partitionBy("branch_id").orderBy(F.desc("sequence")))


def without_last_n(changes: DataFrame, n: int) -> DataFrame:
    """All changes except each branch's last ``n``: the few last ones are
    found first (n a branch and partition before the shuffle) and joined away
    by branch and sequence, so a branch of many changes stays spread."""
    gone = last_n(changes, n).select("branch_id", "sequence")
    return changes.join(gone, ["branch_id", "sequence"], "left_anti").select(*changes.columns)


def tags(branches: DataFrame, changes: DataFrame) -> DataFrame:
    """Two tags per branch: ``head`` at the last change, ``half`` halfway."""
    h = heads(branches, changes)
    head = h.select(F.lit("head").alias("tag"), "branch_id", "name",
                    F.col("head_sequence").alias("tag_sequence"))
    half = h.select(F.lit("half").alias("tag"), "branch_id", "name",
                    (F.col("head_sequence") / 2).cast("int").alias("tag_sequence"))
    return head.unionByName(half)


def at_tag(changes: DataFrame, tag_rows: DataFrame) -> DataFrame:
    """State of each branch at each tag: the changes up to the tag sequence."""
    t = tag_rows.select("tag", "branch_id", "tag_sequence")
    return (changes.join(t, "branch_id")
                   .filter(F.col("sequence") <= F.col("tag_sequence")))


def clone(changes: DataFrame, sources: DataFrame, suffix: str = "-copy") -> DataFrame:
    """Copy the history of each source branch (branch_id, name) to a new
    branch ``name + suffix``: renumbered from 1 in sequence order, described
    as cloned, fingerprinted like any change, and with
    branched_at_seq = the number of copied changes."""
    src = sources.select("branch_id", "name")
    copied = changes.join(src, "branch_id")
    renum = number_rows(copied, ["branch_id"], ["sequence"], out="new_sequence")
    cnt = copied.groupBy("branch_id").agg(F.count(F.lit(1)).cast("int").alias("branched_at_seq"))
    return (renum.join(cnt, "branch_id")
                 .select(F.concat("name", F.lit(suffix)).alias("new_branch"),
                         F.col("new_sequence").alias("sequence"), "sql_text", "type",
                         F.concat(F.lit("cloned from "), F.col("name")).alias("description"),
                         checksum16("sql_text").alias("checksum"), "branched_at_seq"))


# --- stashes -----------------------------------------------------------------
def pack(changes: DataFrame, part_size: int = 1000) -> DataFrame:
    """Pack each branch's changes into JSON documents.  A document holds at
    most ``part_size`` changes (part = (sequence-1) div part_size), so no
    task or row ever holds a whole hot branch.
    (branch_id, part, migration_count, payload)."""
    part = ((F.col("sequence") - 1) / part_size).cast("int")
    item = F.struct(F.col("sequence").cast("int").alias("sequence"), F.col("sql_text").alias("sql"),
                    "type", "description", "checksum")
    return (changes.groupBy("branch_id", part.alias("part"))
            .agg(F.count(F.lit(1)).alias("migration_count"),
                 F.array_sort(F.collect_list(item)).alias("items"))
            .select("branch_id", "part", "migration_count",
                    F.to_json(F.struct(F.col("branch_id"), F.col("migration_count"),
                                       F.col("items").alias("migrations"))).alias("payload")))


def unpack(packed: DataFrame) -> DataFrame:
    """Documents back to rows: (branch_id, sequence, sql_text, type, description, checksum)."""
    schema = T.StructType([T.StructField("branch_id", T.LongType()),
                           T.StructField("migration_count", T.LongType()),
                           T.StructField("migrations", T.ArrayType(CHANGE_STRUCT))])
    doc = packed.select(F.from_json("payload", schema).alias("d"))
    return (doc.select(F.col("d.branch_id").alias("branch_id"), F.inline("d.migrations"))
               .withColumnRenamed("sql", "sql_text"))


def latest_per(df: DataFrame, keys: list[str], order_col: str, tie_col: str) -> DataFrame:
    """Latest row per key (last wins), as an aggregate: ``max_by`` combines
    map-side, so a hot key is reduced before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(order_col, tie_col))
    return df.groupBy(*keys).agg(best.alias("_s")).select(*keys, "_s.*")


def numbered_newest_first(stashes: DataFrame) -> DataFrame:
    """stash@{n} per branch, newest = 0."""
    from pyspark.sql import Window
    w = Window.partitionBy("branch_id").orderBy(F.desc("created_at"), F.desc("stash_id"))
    return stashes.withColumn("stash_index", (F.row_number().over(w) - 1).cast("int"))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert, first wins: incoming rows whose key exists are dropped, and of
    several incoming rows of one key the least (by all its columns) is kept."""
    new = incoming.join(existing.select(*keys), keys, "left_anti")
    rows = F.struct(*[F.col(c) for c in incoming.columns])
    new = new.groupBy(*keys).agg(F.min(rows).alias("_row")).select("_row.*")
    return existing.unionByName(new)


def with_merge_label(changes: DataFrame) -> DataFrame:
    return changes.withColumn("on_merge", merge_label("type"))


def diff_vs_parent(changes: DataFrame, branches: DataFrame) -> DataFrame:
    """Changes of each branch whose trimmed text its parent does not have
    (anti-join; duplicates on the branch side are kept, as a difference of
    lists).  ``main`` is its own parent, so its difference is empty."""
    parent = (branches.select("branch_id", "parent_branch")
              .join(branches.select(F.col("name").alias("parent_branch"), F.col("branch_id").alias("parent_id")),
                    "parent_branch"))
    mine = (changes.join(parent.select("branch_id", "parent_id"), "branch_id")
            .withColumn("_t", trim_ws("sql_text")))
    theirs = changes.select(F.col("branch_id").alias("parent_id"), trim_ws("sql_text").alias("_t")).distinct()
    return mine.join(theirs, ["parent_id", "_t"], "left_anti").drop("_t", "parent_id")
