"""Append-only store of the history tables: branches, changes, tags, stashes.

A batch of rows is written to a folder of its own and becomes visible by one
small commit file (as in ``store``); a batch that is sent again under the same
name replaces what an unfinished try left and is committed once, so a retry
adds nothing.  Rows are never changed: the current state of a keyed table is
the last row of each key, by the order of commits.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fs

#: the key of each history table; None: rows are events of their own
KEYS: Mapping[str, tuple[str, ...] | None] = {
    "branches": ("branch_id",), "changes": None, "tags": ("tag", "branch_id"), "stashes": ("stash_id",)}

_COMMIT = T.StructType([T.StructField("batch", T.StringType()), T.StructField("seq", T.LongType()),
                        T.StructField("columns", T.StringType())])


class HistoryStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _dir(self, table: str, *parts: str) -> str:
        if table not in KEYS:
            raise ValueError(f"not a history table: {table}")
        return fs.join(self.root, table, *parts)

    def append(self, table: str, rows: DataFrame, batch: str) -> bool:
        """Adds ``rows`` as the batch of this name; False if it is there already."""
        if not re.fullmatch(r"[\w-]+", batch):
            raise ValueError("a batch's name holds letters, digits, _ and - only")
        commit = self._dir(table, "commits", f"{batch}.json")
        if fs.exists(self.spark, commit):
            return False
        rows.write.mode("overwrite").parquet(self._dir(table, "batches", batch))
        fs.write_text_atomically(self.spark, commit, json.dumps(
            {"batch": batch, "seq": time.time_ns(), "columns": rows.schema.json()}) + "\n")
        return True

    def commits(self, table: str) -> DataFrame:
        path = self._dir(table, "commits")
        if not fs.exists(self.spark, path):
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json(path)

    def rows(self, table: str) -> DataFrame | None:
        """All committed rows with their commit's ``seq``; None before the first.
        Later batches may have more columns; earlier rows hold NULLs there."""
        done = self.commits(table).orderBy("seq").collect()          # one row a batch
        if not done:
            return None
        fields: dict[str, T.StructField] = {}
        for c in done:
            for f in T.StructType.fromJson(json.loads(c["columns"])).fields:
                fields.setdefault(f.name, f)
        paths = [self._dir(table, "batches", c.batch) for c in done]
        seqs = self.spark.createDataFrame([(c.batch, c.seq) for c in done], "_batch string, seq long")
        read = self.spark.read.schema(T.StructType(list(fields.values()))).parquet(*paths)
        batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batches/([\w-]+)/", 1)
        return read.withColumn("_batch", batch).join(F.broadcast(seqs), "_batch").drop("_batch")   # one row a batch

    def current(self, table: str) -> DataFrame | None:
        """The last row of each key (all rows of a table without key)."""
        rows, key = self.rows(table), KEYS[table]
        if rows is None or key is None:
            return rows if rows is None else rows.drop("seq")
        columns = [c for c in rows.columns if c != "seq"]
        last = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "seq").alias("r"))
        return last.select("r.*")
