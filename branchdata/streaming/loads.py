"""Incremental work on Structured Streaming.

* ``resumable_load``: a table arriving as files is loaded into a branch
  with masks applied; the checkpoint records which files are done, so a
  stopped or failed load resumes where it was and a rerun adds nothing.
* ``activity_counts``: the live activity view - events de-duplicated within
  a watermark, counted per (branch, kind); each micro-batch writes what it
  changed, and readers merge the latest (``live_counts``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masking import mask_frame
from ..sources.fs import exists, join, list_names


def split_into_files(df: DataFrame, path: str, rows_per_file: int) -> str:
    """Stage a table as Parquet files of at most ``rows_per_file`` rows (the
    'arriving' input), written by as many tasks as read it."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("error").parquet(path)
    return path


STAGED_FILES = 64             # files that a table is staged as, if they stay within:
MOST_FILE_ROWS = 1_000_000


def staged_file_rows(rows: int, least: int) -> int:
    """Rows per staged file.  A micro-batch takes a number of files and has a
    fixed cost, so the files grow with the table, up to a bound, and the
    batches don't become more and more."""
    return max(least, min(MOST_FILE_ROWS, -(-rows // STAGED_FILES)))


def stage(df: DataFrame, path: str, least_rows: int) -> str:
    """Stage a table as files of at least ``least_rows`` rows, but for the
    last one of each writing task; there are no more tasks than files."""
    rows = df.count()
    per_file = staged_file_rows(rows, least_rows)
    return split_into_files(df.coalesce(max(1, -(-rows // per_file))), path, per_file)


def resumable_load(spark: SparkSession, source_path: str, schema, target: str, checkpoint: str,
                   table: str, masks: dict | None = None, id_col: str | None = None,
                   files_per_batch: int = 2) -> list[int]:
    """Run the load until the input is drained (``availableNow``); returns
    the numbers of the micro-batches that this run finished.  A batch is
    written to a folder of its number, so one that is run again replaces
    itself; ``progress_rows`` reads the progress of all runs from there."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source_path))
    if masks:
        stream = mask_frame(stream, table, masks, id_col=id_col)
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(join(target, f"batch={batch_id}"))
        done.append(batch_id)

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return done


def progress_rows(spark: SparkSession, target: str) -> DataFrame:
    """(batch, rows, cumulative_rows) of every micro-batch of a load, from what
    it stored: no batch is ever forgotten."""
    df = (spark.read.parquet(target).groupBy(F.col("batch").cast("bigint").alias("batch"))
          .agg(F.count(F.lit(1)).alias("rows")))
    from pyspark.sql import Window
    # one row per micro-batch: a small, bounded frame
    w = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative_rows", F.sum("rows").over(w))


MERGE_EVERY = 20         # batches of changed counts between two merged states


def activity_counts(spark: SparkSession, source_path: str, schema, out_path: str, checkpoint: str,
                    watermark: str = "1 hour", files_per_batch: int = 2, merge_every: int = MERGE_EVERY) -> None:
    """Live (branch, kind) counts over an event stream.

    ``dropDuplicatesWithinWatermark`` removes re-delivered events (exact
    distinct aggregates are not allowed on streams).  Each micro-batch writes
    the counts that it changed to a folder of its number (run again, it
    replaces itself); every ``merge_every`` batches the latest counts are
    written to a new folder.  No folder that ``live_counts`` reads from is
    ever overwritten with other rows.
    """
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(source_path)
              .withColumn("event_time", F.col("ts").cast("timestamp"))
              .withWatermark("event_time", watermark)
              .dropDuplicatesWithinWatermark(["event_id"]))
    counts = (events.groupBy(F.col("user_id").alias("branch_id"), "event_type")
              .agg(F.count(F.lit(1)).alias("events")))

    def publish(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumn("batch", F.lit(batch_id).cast("bigint"))
        changed.write.mode("overwrite").parquet(join(out_path, f"changed-{batch_id:012d}"))
        if batch_id and batch_id % merge_every == 0:
            (live_counts(batch.sparkSession, out_path).withColumn("batch", F.lit(batch_id).cast("bigint"))
             .write.mode("overwrite").parquet(join(out_path, f"merged-{batch_id:012d}")))

    q = (counts.writeStream.outputMode("update").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def live_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest count of each (branch, kind): the last merged state and the
    batches written after it, complete folders only."""
    done = [n for n in list_names(spark, out_path) if exists(spark, join(out_path, n, "_SUCCESS"))]
    merged = max((n for n in done if n.startswith("merged-")), default="merged-")
    since = merged.removeprefix("merged-")
    parts = [n for n in done if n == merged or n.startswith("changed-") and n.removeprefix("changed-") > since]
    schema = "branch_id bigint, event_type string, events bigint, batch bigint"
    if not parts:
        return spark.createDataFrame([], schema).drop("batch")
    return (spark.read.schema(schema).parquet(*[join(out_path, n) for n in parts])
            .groupBy("branch_id", "event_type").agg(F.max_by("events", "batch").alias("events")))
