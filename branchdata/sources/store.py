"""Branch store: one folder per branch namespace, one versioned Parquet data
set per table, and an append-only table of load events.

Parquet has no transactions, so a table version is written to a fresh
``v=<id>`` folder first and published afterwards by appending one event row
(``status = ready``).  Readers take the latest ready event per
(branch, table), so a half-written version is never visible, and a path is
never overwritten while it may be read.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fs

EVENT_SCHEMA = T.StructType([
    T.StructField("branch", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("rows_loaded", T.LongType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("path", T.StringType()),       # of a version kept by another branch
])


class BranchStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table_dir(self, branch: str, table: str) -> str:
        return fs.join(self.root, branch, table)

    def events_path(self) -> str:
        return fs.join(self.root, "_events")

    def write(self, df: DataFrame, branch: str, table: str) -> tuple[str, int]:
        """Write a new version and publish it; returns (path, rows).

        The row count comes from the write itself (an observed metric), not
        from a second scan.
        """
        version = uuid.uuid4().hex[:12]
        path = fs.join(self.table_dir(branch, table), f"v={version}")
        from pyspark.sql import Observation
        obs = Observation(f"rows_{version}")
        df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("error").parquet(path)
        rows = int(obs.get["rows"])
        self.publish(branch, table, version, "ready", rows)
        return path, rows

    def publish(self, branch: str, table: str, version: str | None, status: str,
                rows: int = 0, error: str | None = None, path: str | None = None) -> None:
        """Append one event to the branch's commit log: one small JSON file
        per event, written by the driver and renamed into place (like a
        table-format transaction log), so concurrent loads never share a
        file and readers never see a partial entry."""
        event = {"branch": branch, "table_name": table, "version": version, "status": status,
                 "rows_loaded": int(rows), "at": datetime.now(timezone.utc).isoformat(),
                 "seq": time.time_ns(), "error": error, "path": path}
        name = f"{event['seq']:020d}-{uuid.uuid4().hex[:8]}.json"
        fs.write_text_atomically(self.spark, fs.join(self.events_path(), name), json.dumps(event) + "\n")

    def events(self) -> DataFrame:
        if not fs.exists(self.spark, self.events_path()):
            return self.spark.createDataFrame([], EVENT_SCHEMA)
        return self.spark.read.schema(EVENT_SCHEMA).json(self.events_path())

    def latest(self) -> DataFrame:
        """Latest event per (branch, table): upsert, last wins."""
        ev = self.events()
        return (ev.groupBy("branch", "table_name")
                  .agg(F.max_by(F.struct("version", "status", "rows_loaded", "at"), F.col("seq")).alias("s"))
                  .select("branch", "table_name", "s.*"))

    def ready(self) -> DataFrame:
        """Latest *ready* version per (branch, table): what readers see.  A
        reload that runs or has failed leaves the version before it in place."""
        return (self.events().filter(F.col("status") == "ready").groupBy("branch", "table_name")
                .agg(F.max_by(F.struct("version", "path", "rows_loaded"), "seq").alias("s"))
                .select("branch", "table_name", "s.*"))

    def version_path(self, ready) -> str:
        """Where a row of ``ready`` keeps its files."""
        return ready.path or fs.join(self.table_dir(ready.branch, ready.table_name), f"v={ready.version}")

    def ready_versions(self, branch: str) -> dict[str, str]:
        """table -> path of its latest ready version (one small job; one row
        per table of the branch)."""
        return {r.table_name: self.version_path(r) for r in self.ready().filter(F.col("branch") == branch).collect()}

    def read(self, branch: str, table: str) -> DataFrame:
        st = self.ready().filter((F.col("branch") == branch) & (F.col("table_name") == table)).collect()
        if not st:
            raise FileNotFoundError(f"no ready version of {branch}/{table}")
        return self.open(self.version_path(st[0]))

    def open(self, path: str) -> DataFrame:
        """The rows of a version, whose files may lie in folders of batches."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(path)

    def ready_tables(self, branch: str) -> list[str]:
        return sorted(r[0] for r in self.latest()
                      .filter((F.col("branch") == branch) & (F.col("status") == "ready")
                              & (F.col("rows_loaded") > 0))
                      .select("table_name").collect())
