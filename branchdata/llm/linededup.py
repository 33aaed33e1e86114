"""Line de-duplication over the whole corpus.

Lines are normalised (white space stripped at both ends, A-Z lower-cased) and
hashed to 128 bits.  The distinct (hash, document) pairs are counted per hash;
a hash in ``min_docs`` documents or more is dropped everywhere but in the
largest doc_id that holds it.  The few pairs to drop go back to the documents,
whose other lines are joined again in their order.

Only hashes are shuffled to count (pre-aggregated, so a line of a third of
all documents is a few rows by then); the join with the repeated hashes is
salted; the texts are shuffled once.

Defined cases: null or empty text is one empty line; keys under ``min_chars``
code points stay; repeated rows of a doc_id count as one document and lose
the same lines; all rows of null id count as one document, below any id.
Other columns ride along in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchdata.llm.common import columns, stored

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 16
_SPACE = b" \t\n\x0b\x0c\r"


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """Hash of each line's key, None where the key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(_SPACE)
        if len(key) < min_chars or (not key.isascii()
                                    and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key.lower()))      # bytes: only A-Z change
    return out


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, hashes to drop) of the documents that lose lines."""
    pair = pa.schema([("hash", pa.binary()), ("doc_id", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches, "doc_id", "text"):
            hs: list[bytes] = []
            ds: list[int | None] = []
            for doc, text in zip(ids, texts, strict=True):
                own = set(_keys(text, min_chars))
                own.discard(None)
                hs += own
                ds += [doc] * len(own)
                if len(hs) > 1 << 17:
                    yield pa.record_batch([pa.array(hs, pa.binary()), pa.array(ds, pa.int64())], schema=pair)
                    hs, ds = [], []
            yield pa.record_batch([pa.array(hs, pa.binary()), pa.array(ds, pa.int64())], schema=pair)

    lines = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                               F.col("text").cast("string").alias("text"))
                   .mapInArrow(hashed, "hash binary, doc_id long").distinct(), "lines")
    often = (lines.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("kept"))
             .where(F.col("n") >= min_docs)
             .select(F.col("hash").alias("h"), "kept",
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    drop = lines.withColumn("salt", salt).join(often, (F.col("hash") == F.col("h")) & (F.col("salt") == F.col("s")))
    return (drop.where(~F.col("doc_id").eqNullSafe(F.col("kept")))
            .groupBy("doc_id").agg(F.collect_list("hash").alias("hashes")))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the input row), ``kept`` (its
    text without the dropped lines), ``n_lines`` and ``n_dropped``."""
    drops = repeated_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("drop_id"), "hashes")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    both = (rows.join(drops.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("drop_id")), "left")
            .select("row", F.col("row.text").cast("string").alias("text"), "hashes"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("kept", T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: list[str] = []
            n: list[int] = []
            gone: list[int] = []
            for text, hashes in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = text or ""
                lines = text.split("\n")
                n.append(len(lines))
                if hashes:
                    bad = set(hashes)
                    rest = [x for x, k in zip(lines, _keys(text, min_chars), strict=True) if k not in bad]
                    gone.append(len(lines) - len(rest))
                    text = "\n".join(rest)
                else:
                    gone.append(0)
                kept.append(text)
            yield pa.record_batch([b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()),
                                   pa.array(gone, pa.int64())], names=schema.names)

    return both.mapInArrow(cleaned, schema)
