"""Merge every open branch into its parent, deepest branches first.

Branches of one level of the tree are merged together: a parent's incoming
changes (child by child, each in its own order) are numbered behind the
parent's head and judged in one replay of the parent's history and all of
them, so a change is seen against what its parent holds by then, changes of
the siblings before it included.  What is kept gets the parent's next
sequences and travels on with the parent's own changes one level further up.

Gated parents take nothing; without a strategy a branch with a conflict is
refused whole (siblings behind it are still judged as if it had merged).
Both stay in the outcomes as rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.changes import ACTION_BITS, auto_resolve, conflict_class, with_actions
from .conflicts import check
from .numbering import DETECT, number_rows

STRATEGIES = ("ours", "theirs", None)


def tree_levels(links: DataFrame) -> DataFrame:
    """(branch_id, level): how far each branch of ``links`` (branch_id,
    parent_id; NULL for a root) is below its root.  Pointer jumping: every
    round doubles the path that is known, so a path of n branches takes log n
    joins, however the branches are spread.  A circle raises."""
    known = links.select("branch_id", F.col("parent_id").alias("up"),
                         F.col("parent_id").isNotNull().cast("int").alias("level")).checkpoint()
    for _ in range(known.count().bit_length() + 1):
        if known.where("up IS NOT NULL").isEmpty():
            return known.select("branch_id", "level")
        above = known.select(F.col("branch_id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
        known = (known.join(above, "up", "left")
                 .select("branch_id", F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
                 .checkpoint())
    raise ValueError("the branches' parents go round in a circle")


def _judged(own: DataFrame, incoming: DataFrame, catalog: DataFrame, indexes: DataFrame, hot) -> DataFrame:
    """``incoming`` with the message of the first action of each change that
    conflicts (NULL: none)."""
    line = (own.select("branch_id", "sequence", "sql_text")
            .unionByName(incoming.select("branch_id", "sequence", "sql_text")))
    actions = with_actions(line)
    if hot is not None:          # read several times where branches are scanned in pieces
        actions = actions.checkpoint()
    checked = check(actions.select("branch_id", F.col("position").alias("sequence"), "sql_text"), catalog, indexes, hot=hot)
    found = (checked.where("conflict_type IS NOT NULL")
             .groupBy("branch_id", F.shiftright("sequence", ACTION_BITS).alias("sequence"))
             .agg(F.min_by("message", "sequence").alias("message")))
    return incoming.join(found, ["branch_id", "sequence"], "left")


def merge_apply(branches: DataFrame, changes: DataFrame, catalog: DataFrame, indexes: DataFrame,
                gated: DataFrame, strategy: str | None = "ours", hot=DETECT) -> tuple[DataFrame, DataFrame]:
    """Merges all open branches up the tree.  ``branches``: (branch_id,
    parent_id, is_open); ``changes``: recorded histories (branch_id, sequence,
    sql_text, type); ``gated``: branch_ids that take no merge.

    Returns (added, outcomes): the changes added to the parents' histories
    (branch_id, sequence, sql_text, type, from_branch, from_sequence), and for
    each open branch (branch_id, parent_id, level, outcome, sent, applied)
    with outcome merged, refused, gated or nothing to merge."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    none = F.lit(None).cast("bigint")
    base = changes.select("branch_id", F.col("sequence").cast("bigint").alias("sequence"), "sql_text", "type",
                          none.alias("from_branch"), none.alias("from_sequence")).checkpoint()
    levels = tree_levels(branches.select("branch_id", "parent_id"))
    kids_all = (branches.where("is_open AND parent_id IS NOT NULL").select("branch_id", "parent_id").join(levels, "branch_id")
                .join(gated.select(F.col("branch_id").alias("parent_id"), F.lit(True).alias("is_gated")).distinct(),
                      "parent_id", "left")
                .select("branch_id", "parent_id", "level", F.coalesce("is_gated", F.lit(False)).alias("is_gated")).checkpoint())
    history, added, outcomes = base, base.limit(0), []
    for level in sorted((r.level for r in kids_all.select("level").distinct().collect()), reverse=True):
        kids = kids_all.where(F.col("level") == level)
        travels = history.where(F.col("type").isin("ddl", "seed"))
        sent = (travels.join(kids.where("NOT is_gated").select("branch_id", "parent_id"), "branch_id")
                .select(F.col("parent_id").alias("branch_id"), F.col("branch_id").alias("child"),
                        F.col("sequence").alias("child_sequence"), "sql_text", "type"))
        parents = sent.select("branch_id").distinct()
        heads = (history.join(parents, "branch_id", "left_semi").groupBy("branch_id").agg(F.max("sequence").alias("head")))
        incoming = (number_rows(sent, ["branch_id"], ["child", "child_sequence"], out="_n").join(heads, "branch_id", "left")
                    .withColumn("head", F.coalesce("head", F.lit(0)))
                    .withColumn("sequence", F.col("head") + F.col("_n")).checkpoint())
        judged = _judged(travels.join(incoming.select("branch_id").distinct(), "branch_id", "left_semi"), incoming,
                         catalog, indexes, hot)
        if strategy == "theirs":
            text = F.when(F.col("message").isNull(), F.col("sql_text")).otherwise(
                auto_resolve(F.col("sql_text"), conflict_class(F.col("message")))[0])
            judged = judged.withColumn("sql_text", text).withColumn("keep", F.col("sql_text") != "")
        else:
            judged = judged.withColumn("keep", F.col("message").isNull())
        judged = judged.select("branch_id", "child", "child_sequence", "sql_text", "type", "head", "sequence", "keep").checkpoint()
        counts = judged.groupBy(F.col("child").alias("branch_id")).agg(
            F.count(F.lit(1)).alias("sent"), F.count_if("keep").alias("applied"))
        result = (kids.join(counts, "branch_id", "left")
                  .withColumns({"sent": F.coalesce("sent", F.lit(0)), "applied": F.coalesce("applied", F.lit(0))}))
        refused = (F.lit(strategy is None) & (F.col("applied") < F.col("sent")))
        result = (result.withColumn("outcome", F.when(F.col("is_gated"), "gated").when(F.col("sent") == 0, "nothing to merge")
                                    .when(refused, "refused").otherwise("merged"))
                  .withColumn("applied", F.when(refused, 0).otherwise(F.col("applied"))).checkpoint())
        outcomes.append(result.select("branch_id", "parent_id", "level", "outcome", "sent", "applied"))
        kept = judged.where("keep").join(result.where("outcome = 'merged'").select(F.col("branch_id").alias("child")), "child", "left_semi")
        kept = (number_rows(kept, ["branch_id"], ["sequence"], out="_n")
                .select("branch_id", (F.col("head") + F.col("_n")).alias("sequence"), "sql_text", "type",
                        F.col("child").alias("from_branch"), F.col("child_sequence").alias("from_sequence")).checkpoint())
        history, added = history.unionByName(kept), added.unionByName(kept)
    if not outcomes:
        spark = changes.sparkSession
        return added, spark.createDataFrame([], "branch_id long, parent_id long, level int, outcome string, sent long, applied long")
    every = outcomes[0]
    for o in outcomes[1:]:
        every = every.unionByName(o)
    return added, every


def merged_statuses(branches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``branches`` with the status of those that merged set to merged."""
    done = outcomes.where("outcome = 'merged'").select("branch_id", F.lit("merged").alias("_now"))
    return (branches.join(done, "branch_id", "left")
            .withColumn("status", F.coalesce("_now", "status")).drop("_now"))
