"""Resumable load of a keyed table: the stream's offset is the cursor.

The table's pages (``chunk_plan``) are found once and stored.  A streaming
source then counts through them: its offset, kept in the query's checkpoint,
is the page after the last finished one, that is the key to go on behind.  A
micro-batch reads one key range of the table (the filter reaches the scan),
masks it and writes it to a folder of its own, so a batch that runs twice
replaces itself.  A load that is stopped is *paused*: its state names the last
finished key; the same call goes on there.  The finished folder is published
as the branch's version of the table.

Keys may be composite and of any ordered type; they needn't be unique (equal
keys stay in one batch), but a NULL in a key raises, as no cursor gets past it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..operators.extract import CHUNK_ROWS, chunk_plan
from ..operators.masking import mask_frame
from ..sources import fs
from ..sources.store import BranchStore


class _PageReader(SimpleDataSourceStreamReader):
    """Counts through pages; the offset is the first page not yet given."""

    def __init__(self, upto: int, step: int) -> None:
        self.upto, self.step = upto, step

    def initialOffset(self) -> dict:
        return {"page": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = max(start["page"], min(self.upto, start["page"] + self.step))
        return self.readBetweenOffsets(start, {"page": end}), {"page": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(p,) for p in range(start["page"], end["page"])])


class PageSource(DataSource):
    """``branchdata_pages``: the numbers of the pages to load."""

    @classmethod
    def name(cls) -> str:
        return "branchdata_pages"

    def schema(self) -> str:
        return "page long"

    def simpleStreamReader(self, schema) -> _PageReader:
        return _PageReader(int(self.options["upto"]), int(self.options["step"]))


def _after(key: Sequence[str], values: Sequence, or_equal: bool = False) -> Column:
    """The whole key compared with a key value, column by column."""
    first, value = F.col(key[0]), F.lit(values[0])
    if len(key) == 1:
        return first >= value if or_equal else first > value
    return (first >= value) & ((first > value) | _after(key[1:], values[1:], or_equal))


def _upto(key: Sequence[str], values: Sequence) -> Column:
    first, value = F.col(key[0]), F.lit(values[0])
    return first <= value if len(key) == 1 else (first <= value) & ((first < value) | _upto(key[1:], values[1:]))


@dataclass
class KeyedLoad:
    """One load of ``source`` into a branch; ``name`` tells loads of the same
    table apart, and the same name goes on with the same load."""

    store: BranchStore
    branch: str
    table: str
    source: DataFrame
    key: Sequence[str]
    name: str = "load"
    masks: dict | None = None
    id_col: str | None = None
    rows_per_page: int = CHUNK_ROWS
    pages_per_batch: int = 4
    control: str = field(init=False)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[\w-]+", self.name):
            raise ValueError("a load's name holds letters, digits, _ and - only")
        self.key = list(self.key)
        self.control = fs.join(self.store.root, "_loads", self.branch, self.table, self.name)

    @property
    def version(self) -> str:
        return f"keyed-{self.name}"

    @property
    def target(self) -> str:
        return fs.join(self.store.table_dir(self.branch, self.table), f"v={self.version}")

    def pages(self) -> DataFrame:
        """The stored pages (page, low and high key, rows), found on first use."""
        spark, path = self.store.spark, fs.join(self.control, "pages")
        if not fs.exists(spark, fs.join(path, "_SUCCESS")):
            missing = self.source.where(" OR ".join(f"`{k}` IS NULL" for k in self.key))
            if not missing.isEmpty():
                raise ValueError(f"{self.table}: a key column holds NULLs, no cursor gets past them")
            chunk_plan(self.source, self.key, self.rows_per_page).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def finished(self) -> list[tuple[int, int]]:
        """(first, last) page of the finished batches, in order."""
        found = []
        for entry in fs.list_names(self.store.spark, self.target):
            m = re.fullmatch(r"pages_(\d+)_(\d+)", entry)
            if m and fs.exists(self.store.spark, fs.join(self.target, entry, "_SUCCESS")):
                found.append((int(m[1]), int(m[2])))
        return sorted(found)

    def cursor(self) -> tuple | None:
        """The last finished key, None before the first batch."""
        done = self.finished()
        return self._high(done[-1][1]) if done else None

    def _high(self, page: int) -> tuple:
        row = self.pages().where(F.col("page") == page).first()
        return tuple(row[f"high_{k}"] for k in self.key)

    def _batch(self, first: int, last: int) -> DataFrame:
        """The rows behind the page before ``first``, up to the end of ``last``."""
        rows = self.source.where(_upto(self.key, self._high(last)))
        if first:
            rows = rows.where(_after(self.key, self._high(first - 1)))
        return mask_frame(rows, self.table, self.masks, id_col=self.id_col) if self.masks else rows

    def run(self, max_batches: int | None = None) -> str:
        """Goes on with the load, at most ``max_batches`` batches; returns its
        state, ``ready`` or ``paused``."""
        spark, store = self.store.spark, self.store
        total = self.pages().count()
        done = max((last + 1 for _, last in self.finished()), default=0)
        upto = total if max_batches is None else min(total, done + max_batches * self.pages_per_batch)
        store.publish(self.branch, self.table, None, "loading")

        def write(batch: DataFrame, batch_id: int) -> None:
            pages = [r.page for r in batch.collect()]            # pages_per_batch numbers at most
            if pages:
                first, last = min(pages), max(pages)
                self._batch(first, last).write.mode("overwrite").parquet(fs.join(self.target, f"pages_{first:09d}_{last:09d}"))

        try:
            spark.dataSource.register(PageSource)
            query = (spark.readStream.format(PageSource.name()).option("upto", upto).option("step", self.pages_per_batch).load()
                     .writeStream.foreachBatch(write).option("checkpointLocation", fs.join(self.control, "checkpoint")).start())
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        except Exception as exc:
            store.publish(self.branch, self.table, None, "failed", error=str(exc) or type(exc).__name__)
            raise
        done = max((last + 1 for _, last in self.finished()), default=0)
        rows = self.pages().where(F.col("page") < done).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        if done < total:
            store.publish(self.branch, self.table, None, "paused", rows)
            return "paused"
        if not total:                                             # an empty table is a version without rows
            self.source.limit(0).write.mode("overwrite").parquet(fs.join(self.target, "pages_none"))
        store.publish(self.branch, self.table, self.version, "ready", rows)
        return "ready"
