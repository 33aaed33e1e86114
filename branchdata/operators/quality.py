"""Data-quality checks: the rules a database would enforce, as queries.

Each check is one pass with map-side partial aggregation, so a hot key is
pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once: (keys..., n)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1))


def check_not_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count per column, all columns in one aggregate: (column_name, nulls)."""
    columns = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {stack}) as (column_name, nulls)")


def check_expression(df: DataFrame, expr: str) -> DataFrame:
    """Rows that violate a check: the expression is false (NULL passes)."""
    return df.filter(~F.coalesce(F.expr(expr), F.lit(True)))


def check_orphans(child: DataFrame, parent: DataFrame, child_key: Sequence[str],
                  parent_key: Sequence[str]) -> DataFrame:
    """Child rows whose key has no parent row (NULL keys are not orphans)."""
    cond = None
    for ck, pk in zip(child_key, parent_key):
        term = child[ck] == parent[pk]
        cond = term if cond is None else cond & term
    not_null = None
    for ck in child_key:
        t = F.col(ck).isNotNull()
        not_null = t if not_null is None else not_null & t
    return child.filter(not_null).join(parent, cond, "left_anti")


def masked_uniqueness(df: DataFrame, column: str) -> DataFrame:
    """(n_rows, n_distinct, unique_kept) of one (masked) column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(F.col(column)).alias("n_distinct")) \
             .withColumn("unique_kept", F.col("n_rows") == F.col("n_distinct"))


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))]


def cursor_candidates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Integer columns of the tables, and whether their values are unique and
    never NULL (usable as a load cursor): (table_name, column_name, n_rows,
    n_distinct, is_candidate).

    Each table is read once: its columns are unpivoted, and all tables share
    one count per value (partial before the shuffle).  A column of an empty
    table is a candidate with no rows."""
    columns = {t: integer_columns(df) for t, df in tables.items()}
    columns = {t: cols for t, cols in columns.items() if cols}
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(t, c) for t, cols in columns.items() for c in cols],
                                  "table_name string, column_name string")
    parts = [names.select("*", F.lit(None).cast("bigint").alias("value"), F.lit(0).cast("bigint").alias("n"))]
    for t, cols in columns.items():
        stack = ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in cols)
        parts.append(tables[t].select(*cols)
                     .selectExpr(f"'{t}' as table_name", f"stack({len(cols)}, {stack}) as (column_name, value)",
                                 "1L as n"))
    values = (reduce(DataFrame.unionByName, parts).groupBy("table_name", "column_name", "value")
              .agg(F.sum("n").alias("n")))
    found = values.groupBy("table_name", "column_name").agg(
        F.sum("n").alias("n_rows"), F.count("value").alias("n_distinct"))
    return found.withColumn("is_candidate", F.col("n_distinct") == F.col("n_rows"))


def next_keys(keyed: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """The next free integer key of each (table, key column, frame), 1 for an
    empty table: (table_name, key_column, next_key)."""
    return reduce(DataFrame.unionByName, [
        df.agg((F.coalesce(F.max(k), F.lit(0)) + 1).cast("bigint").alias("next_key"))
          .select(F.lit(t).alias("table_name"), F.lit(k).alias("key_column"), "next_key") for t, k, df in keyed])
