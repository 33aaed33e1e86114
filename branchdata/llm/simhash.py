"""SimHash near-duplicates: BK-trees over shards of fingerprints.

Fingerprint.  Words, A-Z lower-cased, in shingles of ``shingle`` words;
a bit of the 64 is set if it is set in over half of the shingles' XXH64.

Shards.  Cut the 64 bits into ``blocks`` blocks: fingerprints within
``radius`` bits agree on ``blocks - radius`` whole blocks at least.  Each
choice of that many blocks and their values is a shard, so any two linked
fingerprints meet in a shard.  A shard of more than ``shard_size``
fingerprints (clusters of look-alikes) is cut again: its other bits in
``radius + 1`` parts, on one of which two linked fingerprints must agree;
each part and its value is a shard; once more where that is still large.
Each cut repeats a row ``radius + 1`` times, so there are ``CUTS`` at most;
nothing is dropped, and a task holds one shard at a time.

Trees.  Each shard with two fingerprints or more builds a BK-tree: a node's
children are keyed by their Hamming distance to it, and a search with radius
r at distance d follows only the edges d-r..d+r.  Trees go to the tasks that
hold the shard's queries by the shuffle itself; they are not broadcast, since
their size has no bound.  A search takes what it finds out of the tree and
continues from there, so a shard gives each fingerprint one link to the first
of its group, not all pairs, and a dense group costs about one search each.

Components are joined over the shards by label propagation with pointer
jumping; every round is stored in the shared folder.

Defined cases: a text without words (null, empty, white space) has
fingerprint 0 and links like any other; fewer words than a shingle are one
shingle.  Each row gives a row; repeated rows share their fingerprint.  Rows
of null id take part, but an id is never null while its group has another.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchdata.llm.common import columns, stored, text_slices

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
SHARD_SIZE = 1 << 16
CUTS = 2
SALTS = 8
SLICE = 1 << 19
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text, read in slices."""
    ones = np.zeros(64, np.int64)
    total, tail, seen = 0, [], 0
    digest = xxhash.xxh64_intdigest
    for s in text_slices(text or "", SLICE):
        words = tail + s.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        seen += len(words) - len(tail)
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = [0, *(ends[:len(words) - shingle] + 1).tolist()]
            h = np.array([digest(joined[a:z], 42) for a, z in
                          zip(starts, ends[shingle - 1:].tolist(), strict=True)], "<u8")
            for part in np.array_split(h, len(h) // 65536 + 1):
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                                      bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
        tail = words[-(shingle - 1):] if shingle > 1 else []
    if not total:
        if not seen:
            return 0
        return digest(b" ".join(tail), 42)
    bits = 2 * ones > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def text_digest(text: Column) -> Column:
    """MD5 (hex) of a text; null counts as empty."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digests: bool = False) -> DataFrame:
    """(doc_id, fp) of each row, and the text's digest if asked for; fp is the
    fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), *[("digest", pa.string())] * digests, ("fp", pa.int64())])
    given = schema.names[:-1]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *kept, texts in columns(batches, *given, "text"):
            fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([*(pa.array(v, f.type) for v, f in zip(kept, schema, strict=False)), pa.array(fps)],
                                  schema=schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"),
                        F.col("text").cast("string").alias("text")).select(*given, "text")
            .mapInArrow(hashed, "doc_id long, digest string, fp long" if digests else "doc_id long, fp long"))


class BKTree:
    """Fingerprints (distinct), children keyed by distance to the parent."""

    def __init__(self, fps: list[int]) -> None:
        self.fps = fps
        self.children: list[dict[int, int]] = [{} for _ in fps]
        self.parent = [-1] * len(fps)
        self.alive = [1] * len(fps)           # of the node and all below it
        self.here = [True] * len(fps)
        for i in range(1, len(fps)):
            at, f = 0, fps[i]
            while True:
                self.alive[at] += 1
                d = (f ^ fps[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = i
                    self.parent[i] = at
                    break
                at = nxt

    def take(self, f: int, radius: int) -> list[int]:
        """Remove and return the nodes within ``radius`` of ``f``."""
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            if not self.alive[at]:
                continue
            d = (f ^ self.fps[at]).bit_count()
            if d <= radius and self.here[at]:
                found.append(at)
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                todo += [children[x] for x in range(d - radius, d + radius + 1) if x in children]
            else:
                todo += [c for x, c in children.items() if d - radius <= x <= d + radius]
        for i in found:
            self.here[i] = False
            while i >= 0:
                self.alive[i] -= 1
                i = self.parent[i]
        return found


def groups(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """(fingerprint, first of its group) for all but the first of each group
    of fingerprints that are linked directly or through others."""
    if len(fps) == 2:
        if (fps[0] ^ fps[1]).bit_count() <= radius:
            yield fps[1], fps[0]
        return
    tree = BKTree(fps)
    for i, f in enumerate(fps):
        if not tree.here[i]:
            continue
        todo = tree.take(f, radius)
        while todo:
            j = todo.pop()
            if j != i:
                yield fps[j], f
                todo += tree.take(fps[j], radius)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _first_masks(blocks: int, radius: int) -> list[int]:
    """Bits of each choice of ``blocks - radius`` of the blocks."""
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    whole = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(whole, blocks - radius)]


def _finer_masks(mask: int, radius: int) -> list[int]:
    """``mask`` with one of ``radius + 1`` parts of the other bits each."""
    rest = [1 << b for b in range(64) if not mask >> b & 1]
    cuts = [len(rest) * p // (radius + 1) for p in range(radius + 2)]
    return [mask | sum(rest[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def _rows(fps: DataFrame, masks: Column) -> DataFrame:
    """(mask, bits, fp): a row for each shard of a fingerprint."""
    return (fps.select("fp", F.explode(masks).alias("mask"))
            .select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp"))


def _mask_array(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS,
          shard_size: int = SHARD_SIZE) -> DataFrame:
    """(fp, root): each fingerprint's link to the first of its group in a
    shard; the links of all shards connect all that are within the radius."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    # Fingerprints that differ in radius bits at most of the bits left: no more than 2 ** radius.
    largest = max(shard_size, 1 << radius)
    rows = _rows(distinct, _mask_array(_first_masks(blocks, radius)))
    found = None
    for _ in range(CUTS):
        large = stored(rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n"))
                       .where(F.col("n") > largest).select("mask", "bits"), "large-shards")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]    # at most one for each choice of bits
        if masks:
            # Salted: a large shard may hold a third of all fingerprints.
            salted = large.select("mask", "bits", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
            inside = rows.join(salted, ["mask", "bits", "salt"], "left_semi")
            rows = rows.join(salted, ["mask", "bits", "salt"], "left_anti").select("mask", "bits", "fp")
        part = _linked(rows, radius)
        found = part if found is None else found.union(part)
        if not masks:
            return found.distinct()
        finer = F.create_map(*[c for m in masks for c in
                               (F.lit(m).cast("long"), _mask_array(_finer_masks(m % (1 << 64), radius)))])
        rows = stored(_rows(inside, finer[F.col("mask")]), "finer-shards")
    return found.union(_linked(rows, radius)).distinct()


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of the shards in ``rows`` (mask, bits, fp), each by a BK-tree."""
    schema = pa.schema([("fp", pa.int64()), ("root", pa.int64())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key: tuple[int, int] | None = None
        held: list[np.ndarray] = []

        def done(parts: list[np.ndarray], out: list[list[int]]) -> None:
            fps = np.unique(np.concatenate(parts))     # two cuts may give the same shard
            if len(fps) > 1:
                for a, b in groups(fps.view(np.uint64).tolist(), radius):
                    out[0].append(a)
                    out[1].append(b)

        def rows(out: list[list[int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.array(x, np.uint64).view(np.int64)) for x in out], schema=schema)

        for b in batches:
            mask, bits, fps = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(fps):
                continue
            out: list[list[int]] = [[], []]
            at = np.flatnonzero((mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])) + 1
            begin = np.concatenate([[0], at])
            end = np.concatenate([at, [len(fps)]])
            many = np.flatnonzero((end - begin > 1) | (begin == 0) | (end == len(fps)))
            for k in many:
                a, z = int(begin[k]), int(end[k])
                key = int(mask[a]), int(bits[a])
                if key != held_key:
                    if held:
                        done(held, out)
                    held_key, held = key, []
                held.append(fps[a:z].copy())
            yield rows(out)
        if held:
            out = [[], []]
            done(held, out)
            yield rows(out)

    return (rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
            .mapInArrow(linked, "fp long, root long"))


def labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component.  ``edges``
    is a stored table."""
    both = stored(edges.select(F.col("fp").alias("a"), F.col("root").alias("b"))
                  .union(edges.select("root", "fp")).distinct(), "edges")
    now = stored(both.groupBy("a").agg(F.min("b").alias("m"))
                 .select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (both.join(now, both.b == now.node).groupBy("a").agg(F.min("label").alias("m")))
        hop = (now.join(near, now.node == near.a).select("node", F.col("label").alias("before"),
                                                         F.least("label", "m").alias("label")))
        up = now.select(F.col("node").alias("at"), F.col("label").alias("above"))
        new = stored(hop.join(up, hop.label == up["at"])
                     .select("node", "before", F.least("label", "above").alias("label")), "labels")
        moved = new.where("before <> label").limit(1).count()
        now = new.select("node", "label")
        if not moved:
            return now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
                    blocks: int = BLOCKS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex)
    and component_id, the smallest doc_id reachable over links."""
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    edges = stored(links(distinct.select("fp"), radius, blocks, shard_size), "links")
    found = labels(edges)
    inside = found.join(distinct, found.node == distinct.fp).select("fp", "label", "low")
    least = inside.groupBy("label").agg(F.min("low").alias("component_id"))
    linked = inside.join(least, "label").select(F.col("fp").alias("f"), F.col("component_id").alias("c"))
    of = (distinct.join(linked, distinct.fp == linked.f, "left")
          .select("fp", F.coalesce("c", "low").alias("component_id"),
                  F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    # Salted: a fingerprint may be that of a third of all documents.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return (fps.withColumn("salt", salt).join(of, ["fp", "salt"])
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def firsts(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS,
           blocks: int = BLOCKS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(doc_id, digest), one row per component: its row of the smallest
    doc_id (null last) and, of that id's texts, the smallest digest."""
    fps = stored(fingerprints(docs, shingle, digests=True), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    distinct = stored(fps.groupBy("fp").agg(F.min(row).alias("first")), "distinct")
    found = labels(stored(links(distinct.select("fp"), radius, blocks, shard_size), "links"))
    return (distinct.join(found, distinct.fp == found.node, "left")
            .groupBy(F.coalesce("label", "fp").alias("component")).agg(F.min("first").alias("first"))
            .select("first.doc_id", "first.digest"))
