"""Registered queries: streaming loads and the live activity view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fs import join, list_names
from ..sources.store import BranchStore
from ..streaming import keyed as KL
from ..streaming import loads as SL
from .registry import Ctx, query

FILE_ROWS = 4_000        # of the smallest staged files
FILES_PER_BATCH = 4
_EVENT_MASKS = {"events.props": "{}"}


@query("resumable_load", """
SELECT event_id, ts, user_id, event_type, value, '{}' AS props FROM events
""")
def resumable_load(c: Ctx):
    """Load events (staged as files of bounded size) with a masked column, some
    files per micro-batch; then run the same load again on the same checkpoint: the
    second run must add nothing.  Returns the stored rows."""
    root = c.scratch()
    ev = c.t("events")
    src = SL.stage(ev, join(root, "in"), FILE_ROWS)
    target, ckpt = join(root, "out"), join(root, "ckpt")
    SL.resumable_load(c.spark, src, ev.schema, target, ckpt, "events", _EVENT_MASKS,
                      files_per_batch=FILES_PER_BATCH)
    again = SL.resumable_load(c.spark, src, ev.schema, target, ckpt, "events", _EVENT_MASKS,
                      files_per_batch=FILES_PER_BATCH)
    if again:
        raise RuntimeError("resumed load re-read finished input")
    return c.spark.read.parquet(target).drop("batch")


@query("stream_progress", """
SELECT true AS all_batches, count(*) AS total_rows FROM events
""")
def stream_progress(c: Ctx):
    """Final running total of a resumable load, and whether it took as many
    micro-batches as its files ask for."""
    root = c.scratch()
    ev = c.t("events")
    src = SL.stage(ev, join(root, "in"), FILE_ROWS)
    files = sum(n.endswith(".parquet") for n in list_names(c.spark, src))
    SL.resumable_load(c.spark, src, ev.schema, join(root, "out"), join(root, "ckpt"), "events", _EVENT_MASKS,
                      files_per_batch=FILES_PER_BATCH)
    return SL.progress_rows(c.spark, join(root, "out")).agg(
        (F.count(F.lit(1)) == -(-files // FILES_PER_BATCH)).alias("all_batches"), F.max("cumulative_rows").alias("total_rows"))


@query("activity_stream", """
SELECT user_id AS branch_id, event_type, count(DISTINCT event_id) AS events FROM events GROUP BY 1, 2
""")
def activity_stream(c: Ctx):
    """Final state of the live (branch, kind) counts after the stream drains.
    The watermark spans the data (30 days) so nothing counts as late."""
    root = c.scratch()
    ev = c.t("events")
    src = SL.stage(ev, join(root, "in"), FILE_ROWS)
    SL.activity_counts(c.spark, src, ev.schema, join(root, "view"), join(root, "ckpt"),
                       watermark="30 days", files_per_batch=4)
    return SL.live_counts(c.spark, join(root, "view")).select(
        "branch_id", "event_type", F.col("events").cast("bigint").alias("events"))


@query("resume_keyed", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
  'R' AS l_returnflag, l_linestatus, l_shipdate FROM lineitem
""")
def resume_keyed(c: Ctx):
    """Load lineitem by its two-column key, a key range per micro-batch and
    one column masked: paused after two batches, then gone on with by a new
    query on the same checkpoint.  Returns the published version's rows."""
    store = BranchStore(c.spark, c.scratch())
    rows = c.t("lineitem")
    pages = 12
    per_page = -(-rows.count() // pages)

    def load():
        return KL.KeyedLoad(store, "branch_resume", "lineitem", rows, ("l_orderkey", "l_linenumber"),
                            masks={"lineitem.l_returnflag": "R"}, rows_per_page=max(per_page, 1), pages_per_batch=3)
    state = load().run(max_batches=2)
    if state != "paused" or load().run() != "ready":
        raise RuntimeError(f"the load is not where it should be: {state}")
    return store.read("branch_resume", "lineitem")
