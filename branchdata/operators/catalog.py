"""Schema catalogs as DataFrames, their diff, type mapping and load order.

A catalog row is (table_name, column_name, data_type, nullable, position).
Catalogs are metadata (one row per column), built from ``df.schema``; the
diff and the mappings are joins over them, so catalogs of thousands of
tables across many branches diff in one job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import TYPE_NAMES

CATALOG_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("nullable", T.BooleanType()),
    T.StructField("position", T.IntegerType()),
])


def catalog_of(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    rows = []
    for table in sorted(frames):
        for pos, f in enumerate(frames[table].schema.fields, start=1):
            rows.append((table, f.name, f.dataType.simpleString(), bool(f.nullable), pos))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def tables_of(catalog: DataFrame) -> DataFrame:
    return catalog.select("table_name").distinct()


def schema_diff(new: DataFrame, old: DataFrame, with_nullability: bool = False) -> DataFrame:
    """Differences of ``new`` against ``old``:
    add_table / remove_table (one row per table), add_column / remove_column /
    change_type (old -> new type, upper-cased) for tables in both.
    (change_kind, table_name, column_name, old_type, new_type)."""
    nt = tables_of(new).withColumn("in_new", F.lit(True))
    ot = tables_of(old).withColumn("in_old", F.lit(True))
    tables = nt.join(ot, "table_name", "full_outer")
    table_rows = tables.filter(F.col("in_old").isNull() | F.col("in_new").isNull()).select(
        F.when(F.col("in_old").isNull(), "add_table").otherwise("remove_table").alias("change_kind"),
        "table_name", F.lit(None).cast("string").alias("column_name"),
        F.lit(None).cast("string").alias("old_type"), F.lit(None).cast("string").alias("new_type"))
    both = tables.filter(F.col("in_old").isNotNull() & F.col("in_new").isNotNull()).select("table_name")
    n = new.join(both, "table_name", "left_semi").select(
        "table_name", "column_name", F.col("data_type").alias("n_type"), F.col("nullable").alias("n_null"))
    o = old.join(both, "table_name", "left_semi").select(
        "table_name", "column_name", F.col("data_type").alias("o_type"), F.col("nullable").alias("o_null"))
    cols = n.join(o, ["table_name", "column_name"], "full_outer")
    kind = (F.when(F.col("o_type").isNull(), "add_column")
             .when(F.col("n_type").isNull(), "remove_column")
             .when(F.col("o_type") != F.col("n_type"), "change_type"))
    if with_nullability:
        kind = kind.when(F.col("o_null") != F.col("n_null"), "change_nullability")
    col_rows = cols.select(kind.alias("change_kind"), "table_name", "column_name",
                           F.upper("o_type").alias("old_type"), F.upper("n_type").alias("new_type")
                           ).filter(F.col("change_kind").isNotNull())
    return table_rows.unionByName(col_rows)


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: added, removed, changed as the tool counts them (a table
    with any column change counts once, plus once per type change), and the
    number of changed tables."""
    k = F.col("change_kind")
    col_change = k.isin("add_column", "remove_column", "change_type")
    return diff.agg(
        F.count_if(k.isin("add_table", "add_column")).cast("bigint").alias("added"),
        F.count_if(k.isin("remove_table", "remove_column")).cast("bigint").alias("removed"),
        (F.count_distinct(F.when(col_change, F.col("table_name")))
         + F.count_if(k == "change_type")).cast("bigint").alias("changed"),
        F.count_distinct(F.when(col_change, F.col("table_name"))).cast("bigint").alias("tables_changed"))


# Spark type name -> source catalog type name (the names the tool reads
# from information_schema); other names pass through.
def source_type(c) -> "F.Column":
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c == "bigint", "bigint").when(c == "int", "integer")
             .when(c.isin("smallint", "tinyint"), "smallint").when(c == "string", "text")
             .when(c == "boolean", "boolean").when(c == "double", "double precision")
             .when(c == "float", "real").when(c == "timestamp", "timestamp with time zone")
             .when(c == "timestamp_ntz", "timestamp without time zone").when(c == "date", "date")
             .when(c == "binary", "bytea").when(c.startswith("decimal"), "numeric")
             .when(c.startswith("array"), "ARRAY").otherwise(c))


def type_mapping(spark: SparkSession, catalog: DataFrame) -> DataFrame:
    """(table_name, column_name, data_type, source_type, ddl_type): the type a
    rebuilt table gets; names outside the fixed map are upper-cased."""
    mapping = spark.createDataFrame(sorted(TYPE_NAMES.items()), "m_source string, ddl_type string")
    typed = catalog.withColumn("source_type", source_type("data_type"))
    return (typed.join(F.broadcast(mapping), F.lower("source_type") == F.col("m_source"), "left")
                 .select("table_name", "column_name", "data_type", "source_type",
                         F.coalesce("ddl_type", F.upper("source_type")).alias("ddl_type")))


def load_order(catalog: DataFrame, constraints: DataFrame) -> DataFrame:
    """Tables without a foreign key first, then by name: (table_name, has_fk,
    load_rank).  ``constraints``: (table_name, constraint_type p/u/f/c)."""
    from pyspark.sql import Window
    fk = (constraints.groupBy("table_name")
          .agg(F.max((F.col("constraint_type") == "f").cast("int")).alias("has_fk")))
    t = tables_of(catalog).join(fk, "table_name", "left").select(
        "table_name", F.coalesce("has_fk", F.lit(0)).cast("boolean").alias("has_fk"))
    # one row per table: a catalog-sized window
    return t.withColumn("load_rank", F.row_number().over(Window.orderBy("has_fk", "table_name")).cast("int"))
