"""Extraction: subset, mask, page and load tables into a branch.

A spec is declarative (predicate, columns, limit, key); the plan is
``scan -> filter -> mask projection -> order by key -> limit -> write``, and
Catalyst pushes the filter and the column list into the Parquet / JDBC scan.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CHUNK_ROWS, DEFAULT_CONFIG_LIMIT, SMALL_TABLE_ROWS
from ..sources.store import BranchStore
from ..sources.tables import Source
from .limits import first_rows
from .masking import mask_frame
from .numbering import ranged_numbers

LARGE_LIMIT = 100_000    # above it, the rows of a limit aren't brought into one task

_VIEW = threading.Lock()


@dataclass(frozen=True)
class ExtractSpec:
    table: str
    where: str | None = None          # SQL predicate text, e.g. "plan = 'pro'"
    columns: tuple[str, ...] | None = None
    limit: int | None = None
    key: tuple[str, ...] = ()         # total order for a repeatable limit / paging
    id_col: str | None = None         # value of {{id}} in masks


@dataclass
class LoadResult:
    table: str
    rows: int = 0
    status: str = "pending"
    error: str | None = None
    path: str | None = None


def extract(df: DataFrame, spec: ExtractSpec, masks: dict | None = None) -> DataFrame:
    out = df
    if spec.where:
        out = out.filter(F.expr(spec.where))
    if masks:      # before the projection: rules and {{id}} may name columns that aren't selected
        out = mask_frame(out, spec.table, masks, id_col=spec.id_col)
    if spec.columns:
        out = out.select(*spec.columns)
    if spec.limit is not None:
        if spec.key and spec.limit > LARGE_LIMIT and set(spec.key) <= set(out.columns):
            return first_rows(out, spec.key, spec.limit)
        if spec.key:
            out = out.orderBy(*[F.col(k).asc_nulls_last() for k in spec.key])
        out = out.limit(spec.limit)
    return out


def extract_query(src: Source, table: str, query: str, masks: dict | None = None,
                  id_col: str | None = None) -> DataFrame:
    """Run an extraction written as SQL text (``SELECT * FROM t WHERE ...
    LIMIT n``, as teams keep it in their config) with Spark SQL over a temp
    view of the *masked* table: whatever the query computes or renames, it
    never sees a raw value (predicates on masked columns compare masked ones).
    Catalyst still pushes the other predicates and the column list into the scan."""
    df = src.table(table)
    if masks:
        df = mask_frame(df, table, masks, id_col=id_col)
    with _VIEW:          # the name is session-wide; the plan is resolved before it is dropped
        df.createOrReplaceTempView(table)
        try:
            return src.spark.sql(query)
        finally:
            src.spark.catalog.dropTempView(table)


def keyset_page(df: DataFrame, key: Sequence[str], after: Sequence | None, n: int) -> DataFrame:
    """Rows after cursor ``after`` (whole composite key compared), ordered by
    key, at most ``n``.  The first key column gets its own ``>=`` term,
    which is the part Parquet can push down."""
    key = list(key)
    out = df
    if after is not None:
        after = list(after)
        cur = F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(key, after)])
        out = out.filter((F.col(key[0]) >= F.lit(after[0])) & (F.struct(*[F.col(k) for k in key]) > cur))
    return out.orderBy(*key).limit(n)


def chunk_plan(df: DataFrame, key: Sequence[str], rows_per_chunk: int = CHUNK_ROWS) -> DataFrame:
    """All pages of a keyset load in one job: (page, low key, high key, rows).

    Rows are numbered in key order by the balanced global numbering (no
    single-task window); page = (rn - 1) div rows_per_chunk.
    """
    key = list(key)
    numbered = ranged_numbers(df.select(*key), [], key, out="_rn")
    paged = numbered.withColumn("page", ((F.col("_rn") - 1) / rows_per_chunk).cast("int"))
    k = F.struct(*[F.col(c) for c in key])
    agg = paged.groupBy("page").agg(F.min(k).alias("lo"), F.max(k).alias("hi"),
                                    F.count(F.lit(1)).alias("rows"))
    cols = [F.col("page")]
    for c in key:
        cols.append(F.col(f"lo.{c}").alias(f"low_{c}"))
    for c in key:
        cols.append(F.col(f"hi.{c}").alias(f"high_{c}"))
    cols.append(F.col("rows"))
    return agg.select(*cols)


def table_stats(src: Source, tables: Sequence[str]) -> DataFrame:
    """Row count per table; each count reads no column data (Parquet footers)."""
    parts = [src.table(t).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(t).alias("table_name"), "row_count") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plan_specs(spark: SparkSession, specs: dict[str, dict]) -> DataFrame:
    schema = T.StructType([T.StructField("table_name", T.StringType()),
                           T.StructField("where_clause", T.StringType()),
                           T.StructField("spec_limit", T.LongType())])
    rows = [(t, s.get("where"), s.get("limit")) for t, s in sorted(specs.items())]
    return spark.createDataFrame(rows, schema)


def extraction_plan(stats: DataFrame, specs: DataFrame,
                    default_limit: int = DEFAULT_CONFIG_LIMIT,
                    small_rows: int = SMALL_TABLE_ROWS) -> DataFrame:
    """Per table: with a predicate keep it and its own limit (else the
    default); without one take small tables whole, others up to the limit."""
    j = stats.join(F.broadcast(specs), "table_name", "left")
    has_where = F.col("where_clause").isNotNull()
    limit = (F.when(has_where, F.coalesce(F.col("spec_limit"), F.lit(default_limit)))
              .when(F.col("row_count") < small_rows, F.lit(None).cast("bigint"))
              .otherwise(F.lit(default_limit).cast("bigint")))
    query = F.concat(F.lit("SELECT * FROM "), F.col("table_name"),
                     F.when(has_where, F.concat(F.lit(" WHERE "), F.col("where_clause"))).otherwise(F.lit("")),
                     F.when(limit.isNotNull(), F.concat(F.lit(" LIMIT "), limit.cast("string"))).otherwise(F.lit("")))
    return j.select("table_name", "row_count", "where_clause", limit.alias("row_limit"),
                    query.alias("query_text"))


def snapshot_load(src: Source, store: BranchStore, branch: str, spec: ExtractSpec,
                  masks: dict | None = None) -> LoadResult:
    """Extract one table into the branch store; a failure is recorded, not raised."""
    res = LoadResult(spec.table, status="loading")
    store.publish(branch, spec.table, None, "loading")
    try:
        df = extract(src.table(spec.table), spec, masks)
        res.path, res.rows = store.write(df, branch, spec.table)
        res.status = "ready"
    except Exception as exc:  # recorded per table, the others go on
        res.status, res.error = "failed", str(exc) or type(exc).__name__
        store.publish(branch, spec.table, None, "failed", error=res.error)
    return res


def snapshot_all(src: Source, store: BranchStore, branch: str, specs: Sequence[ExtractSpec],
                 masks: dict | None = None, parallel_tables: int = 3,
                 exclude: Sequence[str] = (), skip_ready: bool = True) -> list[LoadResult]:
    """Load many tables at once: a bounded pool of concurrent Spark jobs (one
    per table); tables already ready with rows are skipped, excluded tables
    are never loaded."""
    ready = set(store.ready_tables(branch)) if skip_ready else set()
    todo = [s for s in specs if s.table not in set(exclude)]
    results = [LoadResult(s.table, status="ready") for s in todo if s.table in ready]
    pending = [s for s in todo if s.table not in ready]
    sc = src.spark.sparkContext

    def run(spec: ExtractSpec) -> LoadResult:
        sc.setLocalProperty("spark.scheduler.pool", "load")
        return snapshot_load(src, store, branch, spec, masks)

    with ThreadPoolExecutor(max_workers=max(1, parallel_tables)) as pool:
        results.extend(pool.map(run, pending))
    return results


def copy_branch(store: BranchStore, source: str, target: str) -> list[str]:
    """Give ``target`` every ready table of ``source``: an event that points
    at the source's version.  Versions never change, so nothing is copied."""
    versions = store.ready().filter(F.col("branch") == source).collect()      # one row per table of the branch
    for v in versions:
        store.publish(target, v.table_name, v.version, "ready", v.rows_loaded, path=store.version_path(v))
    return sorted(v.table_name for v in versions)


def write_shapes(store: BranchStore, branch: str, frames: dict, parallel_tables: int = 3) -> None:
    """Rebuild each table's shape (no rows) in the branch; ``limit(0)`` is
    planned as an empty relation, so no source data is read."""

    def one(item):
        name, df = item
        store.write(df.limit(0), branch, name)

    with ThreadPoolExecutor(max_workers=max(1, parallel_tables)) as pool:
        list(pool.map(one, sorted(frames.items())))


def load_results_frame(spark: SparkSession, store: BranchStore, branch: str) -> DataFrame:
    """Rows per table as stored (read back from the published versions)."""
    latest = store.latest().filter(F.col("branch") == branch)
    return latest.select("table_name", "status", "rows_loaded")


def recent(df: DataFrame, ts_col: str, ref_ts: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before a fixed reference time."""
    return df.filter(F.col(ts_col) >= F.expr(f"timestamp_ntz'{ref_ts}' - INTERVAL {int(days)} DAYS"))
