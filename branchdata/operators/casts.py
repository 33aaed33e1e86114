"""What a type change would do, judged by the stored values.

``cast_profile`` tries every target type on every column of a table in one
pass: how many values have no image in the target (``failed``) and how many
don't come back unchanged (``changed``).  ``type_verdicts`` joins ALTER ...
TYPE actions with it, so a change is a mismatch only if some stored value
says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGETS = ("smallint", "int", "bigint", "double", "boolean", "date", "string")
_PROFILED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType,
             T.BooleanType, T.DateType)
#: pairs that no value can be cast between (ANSI rules)
_NEVER = {("date", "smallint"), ("date", "int"), ("date", "bigint"), ("date", "double"), ("date", "boolean"),
          ("boolean", "date"), ("smallint", "date"), ("int", "date"), ("bigint", "date"), ("float", "date"), ("double", "date"),
          ("tinyint", "date")}

PROFILE = ("table_name string, column_name string, data_type string, target_type string, n_values long, failed long, changed long")


def _kind(dtype: T.DataType) -> str:
    return "decimal" if isinstance(dtype, T.DecimalType) else dtype.simpleString()


def profiled_columns(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if isinstance(f.dataType, _PROFILED)]


def cast_profile(tables: Mapping[str, DataFrame], targets: Sequence[str] = TARGETS) -> DataFrame:
    """(table_name, column_name, data_type, target_type, n_values, failed,
    changed) of every column and other target type; one pass over each table."""
    parts = []
    for t, df in tables.items():
        pairs = [(f, to) for f in profiled_columns(df) for to in targets if f.dataType.simpleString() != to]
        if not pairs:
            continue

        def counts(f: T.StructField, to: str) -> Column:
            x = F.col(f"`{f.name}`")
            there = x.isNotNull()
            if (_kind(f.dataType), to) in _NEVER or (_kind(f.dataType) == "decimal" and to == "date"):
                return F.struct(F.count(x).alias("n"), F.count(x).alias("failed"), F.lit(0).cast("long").alias("changed"))
            cast = x.try_cast(to)
            back = cast.try_cast(f.dataType)
            return F.struct(F.count(x).alias("n"), F.count_if(there & cast.isNull()).alias("failed"),
                            F.count_if(cast.isNotNull() & ~back.eqNullSafe(x)).alias("changed"))
        wide = df.agg(*[counts(f, to).alias(f"c{i}") for i, (f, to) in enumerate(pairs)])
        rows = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
                                  F.lit(to).alias("target_type"), F.col(f"c{i}").alias("c")) for i, (f, to) in enumerate(pairs)])
        parts.append(wide.select(F.lit(t).alias("table_name"), F.explode(rows).alias("r"))
                     .select("table_name", "r.column_name", "r.data_type", "r.target_type", F.col("r.c.n").alias("n_values"),
                             F.col("r.c.failed").alias("failed"), F.col("r.c.changed").alias("changed")))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], PROFILE)
    return reduce(DataFrame.unionByName, parts)


def type_verdicts(actions: DataFrame, profile: DataFrame) -> DataFrame:
    """``actions`` (table_name, column_name, target_type, ...) with
    conflict_type ``type_mismatch`` where stored values have no image in the
    target, and the counts; a column without a profile keeps NULLs."""
    found = profile.select("table_name", "column_name", "target_type", "n_values", "failed", "changed")
    return (actions.join(found, ["table_name", "column_name", "target_type"], "left")
            .withColumn("conflict_type", F.when(F.col("failed") > 0, F.lit("type_mismatch")))
            .withColumn("message", F.when(F.col("failed") > 0, F.format_string(
                'column "%s" cannot be cast to type %s (%d of %d values)', F.col("column_name"), F.col("target_type"),
                F.col("failed"), F.col("n_values")))))
