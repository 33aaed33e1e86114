"""Vector code compression: each vector becomes one small entry number per
part, from codebooks fitted by exact integer rounds over all vectors.

Chunks.  Vectors (as integers, floor(scale * x)) are stored in chunks.  In a
chunk each part position has its own order, along a Hilbert curve through the
parts, and is cut into flat blocks of ``BLOCK`` neighbours; a block keeps the
box around its parts (least and greatest integer of each component) and their
sums.

Rounds.  For a block, an entry whose least distance to the box is over the
greatest distance of some other entry can't be nearest for any part in it;
what is left is the block's shortlist.  A shortlist of one takes the block's
kept sums as they are.  Others are evaluated exactly: squared distances in
integers, ties to the lower index.  A task adds up sums and counts per entry
over its chunks, so a round shuffles parts x entries rows a task, however
large the table is and however often one vector occurs in it.

Defined cases: vectors that are null or hold null or non-finite components
take no part; neither do vectors of another length than that of the smallest
vec_id's (ties: of the least vector); repeated rows and null vec_ids (ordered
last) count and give a row each; fewer rows than entries give smaller
codebooks; an empty table gives no rows; other columns are ignored.  Integers
over 2**27 raise, as their distances wouldn't fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchdata.llm.common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CHUNK = 1 << 14          # vectors of a stored chunk
BLOCK = 128              # parts of a flat block
LIMIT = 1 << 27
SALTS = 16
_BYTES = ("points", "places", "low", "high", "sums")


# -- chunks ---------------------------------------------------------------
def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Place along a Hilbert curve of integer points (..., m), scaled to the
    bits that fit; beyond 31 components the rest are left aside."""
    m = min(points.shape[-1], 31)
    bits = min(16, 62 // m)
    axes = [points[..., i].astype(np.int64) - points[..., i].min() for i in range(m)]
    top = max(int(x.max()) for x in axes)
    axes = [x >> max(top.bit_length() - bits, 0) for x in axes]
    for b in range(bits - 1, 0, -1):                   # undo the curve's turns, coarse to fine
        bit, below = 1 << b, (1 << b) - 1
        for i in range(m):
            there = (axes[i] & bit) != 0
            swap = np.where(there, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = np.where(there, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, m):                              # Gray code
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(axes[m - 1] & (1 << b), (1 << b) - 1, 0)
    axes = [x ^ flip for x in axes]
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for x in axes:
            key = key << 1 | x >> b & 1
    return key


class Chunk:
    """Flat blocks of n vectors: points (parts, n, m) in each part's order,
    places (their rows), and per block of a part low, high (m) and sums (m)."""

    def __init__(self, points, places, low, high, sums) -> None:
        self.points, self.places, self.low, self.high, self.sums = points, places, low, high, sums

    @classmethod
    def build(cls, vectors: np.ndarray, parts: int, block: int = BLOCK) -> "Chunk":
        n = len(vectors)
        points = np.ascontiguousarray(vectors.reshape(n, parts, -1).transpose(1, 0, 2))
        places = np.argsort(np.stack([hilbert_keys(p) for p in points]), axis=1, kind="stable").astype(np.int32)
        points = np.take_along_axis(points, places[:, :, None], axis=1)
        at = np.arange(0, n, block)
        return cls(points, places, np.minimum.reduceat(points, at, axis=1), np.maximum.reduceat(points, at, axis=1),
                   np.add.reduceat(points, at, axis=1, dtype=np.int64))

    def to_row(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, x)).astype("<i8" if x == "sums" else "<i4").tobytes() for x in _BYTES]

    @classmethod
    def from_row(cls, data: list[bytes], parts: int, n: int, block: int = BLOCK) -> "Chunk":
        shapes = {"points": (parts, n, -1), "places": (parts, n)}
        return cls(*[np.frombuffer(d, "<i8" if x == "sums" else "<i4").reshape(shapes.get(x, (parts, -(-n // block), -1)))
                     for x, d in zip(_BYTES, data, strict=True)])

    def shortlists(self, part: int, book: np.ndarray) -> np.ndarray:
        """(blocks, entries): may the entry be nearest to a part of the block?"""
        low, high = self.low[part][:, None].astype(np.int64), self.high[part][:, None].astype(np.int64)
        outside = np.maximum(low - book, 0) + np.maximum(book - high, 0)
        reach = np.maximum(book - low, high - book)
        nearest, farthest = (outside * outside).sum(-1), (reach * reach).sum(-1)
        return nearest <= farthest.min(1)[:, None]

    def assign(self, part: int, book: np.ndarray, block: int = BLOCK) -> Iterator[tuple[slice, int, np.ndarray | None,
                                                                                       np.ndarray, np.ndarray]]:
        """Per block: its places, number, entry of each part (None: the only
        one of the shortlist, given next), the shortlist, and its points."""
        points = self.points[part]
        top = max(int(np.abs(points).max()), int(np.abs(book).max()))
        kind = np.int32 if (2 * top) ** 2 * points.shape[1] < 1 << 31 else np.int64
        book, points = book.astype(kind), points.astype(kind)
        for i, listed in enumerate(self.shortlists(part, book.astype(np.int64))):
            entries = np.flatnonzero(listed)
            at = slice(i * block, (i + 1) * block)
            own = points[at]
            if len(entries) == 1:
                yield at, i, None, entries, own
                continue
            apart = np.zeros((len(own), len(entries)), kind)
            for c in range(own.shape[1]):
                d = own[:, c, None] - book[entries, c]
                apart += d * d
            yield at, i, entries[apart.argmin(1)], entries, own

    def totals(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry: number and sums of the parts it is nearest to."""
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for part, book in enumerate(books):
            for at, i, entry, entries, own in self.assign(part, book):
                if entry is None:
                    n[part, entries[0]] += len(own)
                    sums[part, entries[0]] += self.sums[part, i]
                else:
                    n[part] += np.bincount(entry, minlength=len(book))
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    sums[part, used] += np.add.reduceat(own[order], first, axis=0, dtype=np.int64)
        return n, sums

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entries and (n,) summed squared distances, by row."""
        n = self.points.shape[1]
        codes, error = np.empty((n, len(books)), np.uint8), np.zeros(n, np.int64)
        for part, book in enumerate(books):
            nearest = np.empty(n, np.int64)
            for at, _, entry, entries, _ in self.assign(part, book):
                nearest[at] = entries[0] if entry is None else entry
            d = self.points[part].astype(np.int64) - book[nearest]
            rows = self.places[part]
            codes[rows, part] = nearest
            error[rows] += (d * d).sum(1)
        return codes, error


# -- Spark ----------------------------------------------------------------
def _usable(v):
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False))


def _integers(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    values = np.floor(values * scale)
    if values.size and np.abs(values).max() > LIMIT:
        raise ValueError(f"a component is over {LIMIT} / {scale}: exact distances wouldn't fit 64 bits")
    return values.astype(np.int32)


def chunks(vectors: DataFrame, dim: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """Chunks of ``vectors`` (vec_id, label, vector), stored in the shared folder."""
    label = vectors.schema["label"].dataType
    schema = T.StructType([T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(label)),
                           *[T.StructField(x, T.BinaryType()) for x in _BYTES]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: pa.Table) -> pa.RecordBatch:
            held = held.combine_chunks()
            packed = Chunk.build(_integers(held.column(2).combine_chunks(), dim, scale), parts).to_row()
            sides = [pa.ListArray.from_arrays(pa.array([0, held.num_rows], pa.int32()), held.column(i).combine_chunks())
                     for i in (0, 1)]
            return pa.record_batch([*sides, *[pa.array([d], pa.binary()) for d in packed]], names=schema.names)

        waiting: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                b, rest = b.slice(0, CHUNK - sum(w.num_rows for w in waiting)), b
                waiting.append(b)
                if sum(w.num_rows for w in waiting) == CHUNK:
                    yield row(pa.Table.from_batches(waiting))
                    waiting = []
                b = rest.slice(b.num_rows)
        if waiting:
            yield row(pa.Table.from_batches(waiting))

    return stored(vectors.mapInArrow(build, schema), "chunks")


def _read(b: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.Array, pa.Array, Chunk]]:
    for i in range(b.num_rows):
        ids, labels = (b.column(j)[i].values for j in (0, 1))
        yield ids, labels, Chunk.from_row([b.column(j)[i].as_buffer() for j in range(2, 2 + len(_BYTES))], parts, len(ids))


def one_round(chunked: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; entries no part is nearest to stay."""
    parts, entries, m = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, m), np.int64)
        for b in batches:
            for _, _, chunk in _read(b, parts):
                more_n, more = chunk.totals(books)
                n += more_n
                sums += more
        part, entry = np.nonzero(n)
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]),
                               pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], schema=schema)

    got = (chunked.mapInArrow(add, "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
           .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(m)]))
    after = books.copy()
    for part, entry, n, *sums in got.collect():                  # parts x entries rows at most
        after[part, entry] = [s // n for s in sums]
    return after


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray | None:
    """The codebooks to begin with: the parts of the smallest vec_ids' vectors."""
    order = [F.col("vec_id").asc_nulls_last(), "vector"]
    rows = vectors.select("vec_id", "vector").orderBy(*order).limit(entries).collect()
    if not rows:
        return None
    dim = len(rows[0].vector)
    if any(len(r.vector) != dim for r in rows):
        rows = (vectors.select("vec_id", "vector").where(F.size("vector") == dim).orderBy(*order).limit(entries).collect())
    if dim == 0 or dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    whole = _integers(pa.array([r.vector for r in rows], pa.list_(pa.float64())), dim, scale)
    return whole.astype(np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): one row per usable row of ``vectors`` (vec_id,
    ``vector``, label) with vec_id, label, code (a byte per part) and error,
    and the codebooks (parts, entries, components)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry number is one byte")
    label = vectors.schema["label"].dataType
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"),
                           F.col(vector).alias("vector")).where(_usable(F.col("vector"))))
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label),
                           T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    books = first_books(rows, parts, entries, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), np.empty((parts, 0, 0), np.int64)
    chunked = chunks(rows.where(F.size("vector") == parts * books.shape[2]), parts * books.shape[2], parts, scale)
    for _ in range(rounds):
        books = one_round(chunked, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, labels, chunk in _read(b, parts):
                codes, error = chunk.codes(books)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(codes), [None, pa.py_buffer(codes.tobytes())])
                yield pa.record_batch([ids, labels, raw.cast(pa.binary()), pa.array(error, pa.int64())], names=schema.names)

    return stored(chunked.mapInArrow(code, schema), "codes"), books


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the error summed over equal labels (nulls
    together).  Sums are pre-aggregated; each label's is joined back to its
    rows under ``SALTS`` salts, so a common label isn't one task's."""
    sums = (codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
            .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    return (codes.withColumn("salt", salt)
            .join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("s")))
            .drop("of", "s", "salt"))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
