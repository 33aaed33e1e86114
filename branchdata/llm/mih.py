"""Approximate nearest neighbours by multi-index hashing.

Codes.  A rotation learned on a bounded sample (principal directions, then
iterative quantisation) turns each vector into a binary code of up to 64 bits.

Index.  Every valid row is stored with its code.  A shard of up to
``shard_rows`` rows keeps one table per 16-bit substring of the code: the
occupied values and the rows of each.

Search.  Codes within Hamming radius r of a query agree with it within
``r // m`` bits on one of the m substrings at least, so probing the values
that near in each table, and checking whole codes, retrieves every code
within r; the candidates are reranked by exact distance in double precision.
The radius is chosen per query: a first round takes the radius that should
hold ``first`` rows (estimated on the sample) and gives a distance that the
k-th neighbour cannot exceed; a second round takes the radius within which
rows of that distance lie, by the spread of Hamming distances that the sample
shows for it.  Queries short of k neighbours after the first round take all
codes in the second.

Queries are taken in blocks of bounded size against all shards; a shard
returns k rows per query at most, and these are reduced to the k best.

Defined cases: rows of null id or whose vector is null, zero, or has null or
non-finite components take no part, nor do vectors of another length than the
most frequent one of the sample.  Rows of a query's own id are not its
neighbours; of repeated ids the nearest counts, once.  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from branchdata.llm.common import stored

SAMPLE = 8192
BITS = 64
PART = 16
K = 10
FIRST = 400
SPREAD = 2.0
SHARD_ROWS = 1 << 16
QUERY_BLOCK = 4096


@dataclass
class Codes:
    """A learned code with what the sample says about distances."""

    mean: np.ndarray
    rotation: np.ndarray         # dims x bits
    at: np.ndarray               # distances ...
    middle: np.ndarray           # ... the mean Hamming distance there
    spread: np.ndarray           # ... and its standard deviation
    sample_codes: np.ndarray

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        on = (x - self.mean) @ self.rotation > 0
        full = np.zeros((len(x), 64), bool)
        full[:, :self.bits] = on
        return np.packbits(full, axis=1, bitorder="little").view("<u8")[:, 0]

    def first_radius(self, codes: np.ndarray, share: float) -> np.ndarray:
        """Radius that holds the given share of the sample, per query."""
        out = np.empty(len(codes), np.int64)
        for i, c in enumerate(codes):
            held = np.cumsum(np.bincount(np.bitwise_count(self.sample_codes ^ c), minlength=65))
            out[i] = np.searchsorted(held, max(1.0, share * len(self.sample_codes)))
        return np.minimum(out, self.bits)

    def radius_of(self, distance: np.ndarray, spread: float) -> np.ndarray:
        """Radius within which nearly all rows of that distance lie."""
        r = np.interp(distance, self.at, self.middle) + spread * np.interp(distance, self.at, self.spread)
        return np.clip(np.ceil(r), 0, self.bits).astype(np.int64)


def learn(x: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 5) -> Codes:
    rng = np.random.default_rng(seed)
    bits = min(bits, 64, x.shape[1])
    mean = x.mean(0)
    _, _, vt = np.linalg.svd((x - mean).T @ (x - mean))
    v = (x - mean) @ vt[:bits].T
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn > 0, 1.0, -1.0).T @ v)
        turn = w.T @ u.T
    codes = Codes(mean, vt[:bits].T @ turn, *[np.zeros(1)] * 3, np.zeros(0, "<u8"))
    codes.sample_codes = codes.encode(x)
    # Hamming against exact distance, over the nearer pairs of some sample rows.
    d_all, h_all = [], []
    for i in rng.permutation(len(x))[:512]:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[1:max(2, len(x) // 10)]
        d_all.append(d[near])
        h_all.append(np.bitwise_count(codes.sample_codes[near] ^ codes.sample_codes[i]))
    d, h = np.concatenate(d_all), np.concatenate(h_all).astype(float)
    parts = [p for p in np.array_split(np.argsort(d, kind="stable"), 24) if len(p)]
    codes.at = np.array([0.0, *(d[p].mean() for p in parts)])
    codes.middle = np.array([0.0, *(h[p].mean() for p in parts)])
    codes.spread = np.array([0.0, *(h[p].std() for p in parts)])
    return codes


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                   & F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
                   & F.expr("exists(embedding, x -> x <> 0)"))


def build_index(vectors: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[DataFrame, Codes | None]:
    """The stored index (vec_id, code, embedding) and its code."""
    valid = _valid(vectors)
    rows = (valid.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(sample)
            .select("embedding").collect())
    if not rows:
        return valid.withColumn("code", F.lit(0).cast("long")), None
    sizes = [len(r[0]) for r in rows]
    dims = max(set(sizes), key=lambda s: (sizes.count(s), s))
    codes = learn(np.array([r[0] for r in rows if len(r[0]) == dims], float), bits)
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("code", pa.int64())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = codes.encode(_matrix(b.column(1), dims)).view(np.int64)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(code)], names=schema.names)

    return stored(valid.where(F.size("embedding") == dims)
                  .mapInArrow(coded, "vec_id long, embedding array<double>, code long"), "codes"), codes


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Shard:
    """Rows with one table per substring of their codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, bits: int) -> None:
        self.ids, self.x, self.codes = ids, x, codes
        self.tables = []
        for j in range(-(-bits // PART)):
            sub = (codes >> np.uint64(PART * j) & np.uint64(0xFFFF)).astype(np.uint16)
            rows = np.argsort(sub, kind="stable")
            values, begin = np.unique(sub[rows], return_index=True)
            self.tables.append((values, np.append(begin, len(rows)), rows))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ in ``radius`` bits or fewer: all of them."""
        near = np.zeros(len(self.ids), bool)
        m = len(self.tables)
        for j, (values, begin, rows) in enumerate(self.tables):
            # The first radius % m + 1 substrings to radius // m bits, the rest to one less.
            r = radius // m - (j > radius % m)
            if r < 0:
                continue
            sub = np.uint16(int(code) >> PART * j & 0xFFFF)
            hit = np.flatnonzero(np.bitwise_count(values ^ sub) <= r)
            if len(hit) == len(values):
                near[:] = True
                break
            n = begin[hit + 1] - begin[hit]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[hit], n)
            near[rows[at]] = True
        found = np.flatnonzero(near)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]

    def nearest(self, query: int, x: np.ndarray, code: np.uint64, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.within(code, radius)
        rows = rows[self.ids[rows] != query]
        d = np.sqrt(((self.x[rows] - x) ** 2).sum(1))
        part = 4 * k
        while True:              # the nearest part, with all that tie with its last
            keep = d <= np.partition(d, part - 1)[part - 1] if len(d) > part else np.ones(len(d), bool)
            r, near = rows[keep], d[keep]
            order = np.lexsort((self.ids[r], near))
            r, near = r[order], near[order]
            _, once = np.unique(self.ids[r], return_index=True)      # repeated ids: the nearest
            if len(once) >= k or keep.all():
                once = np.sort(once)[:k]
                return self.ids[r][once], near[once]
            part *= 8


def _round(index: DataFrame, codes: Codes, q: list[tuple[int, np.ndarray]], qc: np.ndarray, radius: np.ndarray,
           k: int, shard_rows: int) -> DataFrame:
    """(q, query_id, vec_id, score): the k best found for each query of a block."""
    dims = len(codes.mean)
    schema = pa.schema([("q", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            shard = Shard(np.concatenate([b.column(0).to_numpy() for b in held]),
                          np.concatenate([_matrix(b.column(1), dims) for b in held]),
                          np.concatenate([b.column(2).to_numpy() for b in held]).view(np.uint64), codes.bits)
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, (qid, x) in enumerate(q):
                if radius[i] < 0:
                    continue
                ids, d = shard.nearest(qid, x, qc[i], int(radius[i]), k)
                for column, v in zip(out, (np.full(len(ids), i, np.int32), np.full(len(ids), qid), ids, d), strict=True):
                    column.append(v)
            return pa.record_batch([pa.array(np.concatenate(c) if c else [], type=f.type)
                                    for c, f in zip(out, schema, strict=True)], schema=schema)

        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) >= shard_rows:
                yield answer(held)
                held = []
        if held:
            yield answer(held)

    found = (index.select("vec_id", "embedding", "code")
             .mapInArrow(searched, "q int, query_id long, vec_id long, score double")
             .groupBy("q", "query_id", "vec_id").agg(F.min("score").alias("score")))
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(index: DataFrame, codes: Codes | None, queries: DataFrame, k: int = K, first: int = FIRST,
           spread: float = SPREAD, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank (from 1),
    vec_id, score.  ``queries`` are rows of the index."""
    spark = index.sparkSession
    ddl = "query_id long, rank int, vec_id long, score double"
    if codes is None:
        return spark.createDataFrame([], ddl)
    total = index.count()
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // query_block))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        q = sorted(((r["vec_id"], np.array(r["embedding"], float)) for r in rows), key=lambda t: t[0])
        if not q:
            continue
        qc = codes.encode(np.array([x for _, x in q]))
        radius = codes.first_radius(qc, first / total)

        def far(found: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
            """Number of rows found and the last one's distance, per query."""
            count, last = np.zeros(n, np.int64), np.zeros(n)
            for r in found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("d")).collect():
                count[r["q"]], last[r["q"]] = r["n"], r["d"]
            return count, last

        count, last = far(_round(index, codes, q, qc, radius, k, shard_rows), len(q))
        radius = np.where(count < k, codes.bits, np.maximum(radius, codes.radius_of(last, spread)))
        got = _round(index, codes, q, qc, radius, k, shard_rows).select(
            "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], ddl)
