"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from branchdata.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later
    steps read the table, so a lost executor costs no recomputation, and
    every reader sees the same rows."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    """The named columns of each batch as Python lists."""
    for b in batches:
        yield [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]


def batch(schema: pa.Schema, *values: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, type=f.type) for v, f in zip(values, schema, strict=True)],
                           schema=schema)


def text_slices(text: str, size: int) -> Iterator[str]:
    """``text`` cut before ASCII white space into slices of about ``size``
    code points (longer where there is no white space to cut at)."""
    at, n = 0, len(text)
    while at < n:
        end = at + size
        while end < n and text[end] not in " \n\t\r":
            end += 1
        yield text[at:end]
        at = end
