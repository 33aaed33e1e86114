"""Token-id files: whole texts as ids in ascending doc_id order, stored as
independent blocks of a static range asymmetric numeral system (``rans``).

Writing.  Texts are encoded once; each document's ids (with the end id) are
stored, and one frequency table over all ids of all documents is counted from
them.  The stored ids are then sorted by doc_id (ranges of doc_id, ties by the
ids' checksum, so a doc_id of a third of all rows is cut as well) and each
range is written as a run of blocks of about ``block`` ids.  Documents follow
one another without a gap; one that is longer than a block goes on in the
next, and every block carries the checksum of its open document so far, so
that any block is decoded and checked alone.

A folder holds ``table`` (id, freq), ``blocks`` (part, block, first, n, and
the frame as bytes) and ``parts`` (ids of each part: the bases of all places).

Defined cases: a null or empty text is the end id alone; null doc_ids come
first; rows that repeat a doc_id follow one another, each a document of its
own; other columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchdata.llm import rans
from branchdata.llm.common import stored

BLOCK = 1 << 20
END_ID = 1
_IDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary()),
                  ("counts", pa.list_(pa.int64()))])
_COUNT = pa.schema([("id", pa.int64()), ("n", pa.int64())])
_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("at", pa.int64()), ("crc_in", pa.int64()),
                     ("crc_out", pa.int64()), ("ends", pa.bool_()), ("frame", pa.binary())])
_BLOCKS_DDL = ("part int, block long, first long, n long, doc_ids array<long>, at long, crc_in long, "
               "crc_out long, ends boolean, frame binary")
_PIECES = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("first", pa.int64()), ("at", pa.int64()),
                     ("length", pa.int64()), ("ends", pa.bool_()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, part int, first long, at long, length long, ends boolean, ids_crc32 long"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def document_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n, crc, ids, counts): every row's ids with the end id, their
    number, the CRC32 of them as little-endian unsigned 32-bit numbers, and
    these in compressed planes; after them, for each task, a row of the task's
    ``counts`` alone (how often each id from 0 on)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from branchdata.llm.wordbatch import batch_encoder, slices
        enc, pack = batch_encoder(tokenizer), _codec()
        end, total = np.array([end_id], "<u4").tobytes(), np.zeros(0, np.int64)
        for b in batches:
            for cut in slices(b.column(1)):
                texts = b.column(1)[cut.start:cut.stop]
                bounds, ids = enc.batch(texts)
                total = _add(_add(total, np.bincount(ids)), np.bincount([end_id] * len(texts)))
                wide = ids.astype("<u4").tobytes()
                out: list[list] = [[], [], []]
                for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = wide[4 * a:4 * z] + end
                    out[0].append(z - a + 1)
                    out[1].append(zlib.crc32(own))
                    out[2].append(pack.compress(planes(own), asbytes=True))
                yield pa.record_batch([b.column(0)[cut.start:cut.stop],
                                       *[pa.array(v, type=_IDS.field(i).type) for i, v in enumerate(out, 1)],
                                       pa.nulls(len(texts), _IDS.field(4).type)], schema=_IDS)
        yield pa.record_batch([*[pa.nulls(1, f.type) for f in list(_IDS)[:4]], pa.array([total], _IDS.field(4).type)],
                              schema=_IDS)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(encoded, "doc_id long, n long, crc long, ids binary, counts array<long>"))


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) < len(b):
        a, b = b, a
    a[:len(b)] += b
    return a


def planes(ids: bytes) -> bytes:
    """The low and the high halves of 32-bit ids, one after the other: the
    high halves of a vocabulary below 65,536 are zeros and compress to nothing."""
    return np.frombuffer(ids, "<u2").reshape(-1, 2).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "<u2").reshape(2, -1).T).view("<u4").ravel()


def count_ids(ids: DataFrame) -> DataFrame:
    """(id, n) over all documents: the tasks' counts (the ids aren't read)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for counts in b.column(0):
                total = _add(total, np.array(counts.values, np.int64))
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], schema=_COUNT)

    return (ids.where("counts is not null").select("counts").mapInArrow(counted, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")))


@dataclass
class Open:
    """The document that a block begins in: its ids before and their checksum."""

    at: int = 0
    crc: int = 0


def _blocks(rows: Iterator[tuple[int | None, np.ndarray]], table: rans.Table, part: int,
            block: int) -> Iterator[pa.RecordBatch]:
    """Cuts a part's documents into blocks of ``block`` ids."""
    first = number = held = 0
    docs: list[int | None] = []
    parts: list[np.ndarray] = []
    begin, crc = Open(), 0

    def frame(ends: bool) -> pa.RecordBatch:
        nonlocal first, number, held, docs, parts
        lengths = np.array([len(p) for p in parts], np.int64)
        row = [part, number, first, held, docs, begin.at, begin.crc, crc, ends,
               rans.encode(table, np.concatenate(parts), lengths)]
        first, number, held, docs, parts = first + held, number + 1, 0, [], []
        return pa.record_batch([pa.array([v], type=f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    for doc, ids in rows:
        done, crc = 0, 0
        while done < len(ids):
            piece = ids[done:done + block - held]
            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
            docs.append(doc)
            parts.append(piece)
            held, done = held + len(piece), done + len(piece)
            if held == block:
                ends = done == len(ids)
                yield frame(ends)
                begin = Open() if ends else Open(done, crc)
    if held:
        yield frame(True)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block: int = BLOCK) -> None:
    """Writes the token files of ``docs`` (doc_id, text) to the new folder
    ``path`` of a shared file system."""
    if block < 1:
        raise ValueError("a block holds at least one id")
    spark = docs.sparkSession
    ids = stored(document_ids(docs, tokenizer, end_id), "ids")
    counts = sorted(count_ids(ids).collect())                    # one row per id of the vocabulary
    table = rans.Table.fit([r[0] for r in counts], [r[1] for r in counts]) if counts else None
    freq = [(int(s), int(f)) for s, f in zip(table.symbols, table.freq)] if table else []
    spark.createDataFrame(freq, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _codec()

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in batches:
                docs_, n, data = (b.column(i) for i in (0, 1, 3))
                for i in range(b.num_rows):
                    yield docs_[i].as_py(), unplanes(unpack.decompress(data[i].as_buffer(), 4 * n[i].as_py()))

        yield from _blocks(rows(), table, TaskContext.get().partitionId(), block)

    order = [F.col("doc_id").asc_nulls_first(), "crc", "n", "tie"]
    ordered = (ids.where("counts is null").drop("counts").withColumn("tie", F.monotonically_increasing_id())
               .repartitionByRange(*order).sortWithinPartitions(*order))
    ordered.mapInArrow(cut, _BLOCKS_DDL).write.parquet(f"{path}/blocks")
    sizes = spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()
    base, parts = 0, []
    for part, n in sorted(sizes):                                # one row per written part
        parts.append((part, base, n))
        base += n
    spark.createDataFrame(parts, "part int, base long, n long").coalesce(1).write.parquet(f"{path}/parts")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a block: doc_id, start (ids before
    the document), at (its ids before the piece), length, ends (the document
    ends here), ids_crc32 (of the document up to the piece's end) and, if
    asked for, the piece's ids.  Blocks are decoded apart from one another;
    one that fails a check raises."""
    freq = sorted(spark.read.schema("id long, freq long").parquet(f"{path}/table").collect())
    total = sum(r[1] for r in freq)
    table = rans.Table([r[0] for r in freq], [r[1] for r in freq], total.bit_length() - 1) if freq else None
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int64()))) if with_ids else _PIECES

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, lengths = rans.decode(table, row["frame"])
                if len(ids) != row["n"] or len(lengths) != len(row["doc_ids"]) or int(lengths.sum()) != len(ids):
                    raise rans.DamagedBlock("the block's index doesn't match its frame")
                ids, lengths = ids.astype("<u4"), lengths.tolist()
                out: list[list] = [[] for _ in schema]
                place, at, crc = 0, row["at"], row["crc_in"]
                for i, (doc, n) in enumerate(zip(row["doc_ids"], lengths, strict=True)):
                    own = ids[place:place + n]
                    crc = zlib.crc32(own.tobytes(), crc)
                    ends = i + 1 < len(lengths) or row["ends"]
                    values = [doc, row["part"], row["first"] + place - at, at, n, ends, crc]
                    for column, v in zip(out, [*values, own] if with_ids else values, strict=True):
                        column.append(v)
                    place, at, last, crc = place + n, 0, crc, 0
                if last != row["crc_out"]:
                    raise rans.DamagedBlock("the open document doesn't match its checksum")
                yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    blocks = spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, base long, n long").parquet(f"{path}/parts")
    got = blocks.mapInArrow(pieces, _PIECES_DDL + (", ids array<long>" if with_ids else ""))
    return (got.join(parts.select("part", "base"), "part")       # one row per part: AQE broadcasts it by size
            .select("doc_id", (F.col("base") + F.col("first")).alias("start"), "at", "length", "ends", "ids_crc32",
                    *(["ids"] if with_ids else [])))


def documents(pieces: DataFrame) -> DataFrame:
    """One row per document from its last piece: doc_id, start, n_tokens, ids_crc32."""
    return pieces.where("ends").select("doc_id", "start", (F.col("at") + F.col("length")).alias("n_tokens"), "ids_crc32")
