"""Packing by power-of-two decomposition.

Each document (its token ids and the end id) is cut into pieces whose
lengths are powers of two: as many of the longest length as fit, then the
binary digits of the rest, longest first.  A piece is a sequence of its own,
so no sequence crosses documents and, its length being a power of two, none
is padded.  ``bucket`` is the length; batches are drawn from one bucket, so
all rows of a batch are equally long (``write_buckets`` lays them out so).

Defined cases: a null or empty text is the end id alone; every row is packed,
so repeated rows and null ids give pieces each; other columns are ignored; an
empty table gives no rows.  Texts are read whole, in slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchdata.llm.common import columns

LONGEST = 4096
END_ID = 2
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Power-of-two lengths, longest first, that sum to ``n``."""
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1)
                                         if n % longest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """One row per piece of every row of ``docs`` (doc_id, text): doc_id,
    start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset and,
    unless left out, the piece's ``ids``.  One pass, no shuffle."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from branchdata.llm.wordids import encoder
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def rows(out: list[list]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, type=f.type) for v, f in
                                    zip(out, schema, strict=True)], schema=schema)

        for ids, texts in columns(batches, "doc_id", "text"):
            out: list[list] = [[] for _ in schema]
            held = 0
            for doc, text in zip(ids, texts, strict=True):
                data = enc.ids(text or "") + end
                n, at = len(data) // 4, 0
                for length in cuts(n, longest):
                    part = data[4 * at:4 * (at + length)]
                    row = [doc, at, length, zlib.crc32(part), n]
                    if with_ids:
                        row.append(np.frombuffer(part, "<i4"))
                        held += length
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                    at += length
                    if held > 1 << 22:
                        yield rows(out)
                        out, held = [[] for _ in schema], 0
            yield rows(out)

    ddl = DDL + (", ids array<int>" if with_ids else "")
    # The numbers are given in the stage that reads the table, from the split and
    # the row's place in it: a task that runs again gives the same ones.
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(pieces, ddl)
            .withColumn("bucket", F.col("length"))
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The packed sequences, one folder per length."""
    pieces.write.partitionBy("bucket").parquet(path)
