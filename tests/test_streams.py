"""Streaming: resumable load across arriving files, and the live view."""

from pyspark.sql import functions as F

from branchdata.streaming import loads as SL
from conftest import SF001


def test_load_resumes_where_it_stopped(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    first, second = ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1")
    first.repartition(3).write.parquet(src)                     # files that arrived so far
    p1 = SL.resumable_load(spark, src, ev.schema, out, ckpt, "events", {"events.props": "{}"})
    assert SL.progress_rows(spark, out).agg({"rows": "sum"}).first()[0] == first.count()
    second.repartition(3).write.mode("append").parquet(src)     # more files arrive later
    p2 = SL.resumable_load(spark, src, ev.schema, out, ckpt, "events", {"events.props": "{}"})
    progress = SL.progress_rows(spark, out).orderBy("batch").collect()
    assert [r["batch"] for r in progress] == p1 + p2
    assert progress[-1]["cumulative_rows"] == ev.count()
    stored = spark.read.parquet(out)
    assert stored.count() == ev.count() == stored.select("event_id").distinct().count()
    assert stored.filter(F.col("props") != "{}").count() == 0


def test_live_view_counts_each_event_once(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = str(tmp_path / "in")
    ev.repartition(4).write.parquet(src)
    ev.limit(50).write.mode("append").parquet(src)              # re-delivered events
    SL.activity_counts(spark, src, ev.schema, str(tmp_path / "view"), str(tmp_path / "ckpt"),
                       watermark="30 days", files_per_batch=2)
    view = SL.live_counts(spark, str(tmp_path / "view"))
    want = ev.groupBy(F.col("user_id").alias("branch_id"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    assert view.exceptAll(want.select(*view.columns)).count() == 0 and view.count() == want.count()


def test_progress_keeps_every_batch(spark, tmp_path):
    """More batches than Spark keeps reports of."""
    ev = spark.read.parquet(f"{SF001}/events.parquet").limit(40)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ev.repartition(8).write.parquet(src)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        SL.resumable_load(spark, src, ev.schema, out, str(tmp_path / "c"), "events", files_per_batch=1)
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows = SL.progress_rows(spark, out).orderBy("batch").collect()
    assert len(rows) == 8 and rows[-1]["cumulative_rows"] == 40


def test_batches_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A table of many times the smallest file is staged as some larger files,
    whole, however many tasks read it."""
    monkeypatch.setattr(SL, "STAGED_FILES", 8)
    ev = spark.range(0, 4_000, 1, 40).selectExpr("id AS event_id")
    src = SL.stage(ev, str(tmp_path / "in"), 10)
    files = list((tmp_path / "in").glob("*.parquet"))
    assert len(files) <= 16 and spark.read.parquet(src).distinct().count() == 4_000
    assert [SL.staged_file_rows(n, 4_000) for n in (0, 32_000, 800_000, 10**9)] == [4_000, 4_000, 100_000, 1_000_000]
