"""Benchmark decontamination with a distributed positional inverted index.

Index.  Documents are indexed in blocks of a bounded number of words.  A
block stores, for each term of the test set, the ascending positions at which
it stands (its posting list).  Positions run on through the block's
documents with a gap between them, so nothing matches across documents.  The
index is a table in the shared folder, and a block stays whole on its reader:
matching needs no shuffle.

Search.  A window of test words is looked up from its rarest term over the
whole corpus (the index gives the counts): that term's list, less its offset
in the window, proposes places, and the lists of the other terms, rarest
first, are intersected with them.  Two answers come out: *proximity* (each
term of the window within ``reach`` words of the rarest one's place) and
*exact phrase* (each term at its own offset).

The test set is taken in parts of at most ``item_bytes`` of text, so what is
sent to the tasks is bounded; hits of all parts are united per document.

Defined cases: words are runs of characters other than ASCII non-alphanumerics,
A-Z lower-cased.  An item of fewer words than a window is one window; an item
without words or id is no item.  Repeated items count once by id.  Each
document row gives a row; null text has no words; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchdata.llm.common import columns, stored, text_slices

WINDOW = 10
BLOCK_WORDS = 1 << 20
ITEM_BYTES = 16 << 20
SLICE = 1 << 20
CANDIDATES = 1 << 20      # places examined at a time

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
               for c in range(256))

_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())),
                    ("bases", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
                    ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
                    ("positions", pa.binary())])
_INDEX_DDL = ("doc_ids array<bigint>, digests array<binary>, bases array<bigint>, n_words array<bigint>, "
              "terms array<int>, counts array<bigint>, positions binary")
_FOUND = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()),
                    ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
                    ("near", pa.list_(pa.string()))])
_FOUND_DDL = ("doc_id bigint, digest binary, n_words bigint, spans array<bigint>, items array<string>, "
              "near array<string>")


def words(text: str) -> Iterator[list[bytes]]:
    """Words of a text, a slice at a time (slices end before white space)."""
    for s in text_slices(text, SLICE):
        yield s.encode("utf-8", "surrogatepass").translate(_SPLIT).split()


@dataclass
class TestSet:
    """One part of the test set: terms, distinct windows and their items."""

    vocabulary: dict[bytes, int]
    windows: np.ndarray          # (windows, window) of term numbers, -1 past a short one's end
    items: list[list[str]]       # of each window

    @staticmethod
    def of(rows: Iterable[tuple[object, str]], window: int) -> TestSet:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for part in words(text) for w in part]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i:i + window]), set()).add(str(item))
        table = np.full((len(found), window), -1, np.int32)
        for row, w in zip(table, found, strict=True):
            row[:len(w)] = w
        return TestSet(vocabulary, table, [sorted(x) for x in found.values()])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int,
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """Positional postings of the vocabulary's terms, a row per block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get

        def fresh() -> list[list]:
            return [[], [], [], [], [], []]          # ids, digests, bases, counts, terms, places

        def block(out: list[list]) -> pa.RecordBatch:
            term = np.concatenate(out[4]) if out[4] else np.zeros(0, np.int32)
            place = np.concatenate(out[5]) if out[5] else np.zeros(0, np.int32)
            order = np.argsort(term, kind="stable")
            terms, counts = np.unique(term, return_counts=True)
            return pa.record_batch([pa.array([v], type=f.type) for v, f in zip(
                [out[0], out[1], out[2], out[3], terms, counts, place[order].astype("<i4").tobytes()],
                _INDEX, strict=True)], schema=_INDEX)

        out, at = fresh(), 0
        for ids, texts in columns(batches, "doc_id", "text"):
            for doc, text in zip(ids, texts, strict=True):
                text = text or ""
                base = at
                for part in words(text):
                    known = np.array([get(w, -1) for w in part], np.int32)
                    places = np.flatnonzero(known >= 0).astype(np.int32)
                    out[4].append(known[places])
                    out[5].append(places + np.int32(at))
                    at += len(part)
                for column, v in zip(out, (doc, hashlib.md5(text.encode("utf-8", "surrogatepass")).digest(),
                                           base, at - base), strict=False):
                    column.append(v)
                at += gap
                if at >= block_words:
                    yield block(out)
                    out, at = fresh(), 0
        if out[0]:
            yield block(out)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(blocks, _INDEX_DDL))


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each of the ``size`` terms over the whole index."""
    total = np.zeros(size, np.int64)
    for r in (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
              .groupBy("t.terms").agg(F.sum("t.counts").alias("n")).collect()):
        total[r["terms"]] = r["n"]
    return total


def _held(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a key lies in [low, high], for each pair."""
    at = np.searchsorted(keys, low)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= high)


def _search(keys: np.ndarray, terms: np.ndarray, first: np.ndarray, last: np.ndarray, windows: np.ndarray,
            order: np.ndarray, lengths: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(window, place) of proximity and then exact matches, in portions."""
    rare = windows[np.arange(len(windows)), order[:, 0]]
    at = np.searchsorted(terms, rare)
    known = (at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == rare)
    begin, end = first[at[known]], last[at[known]]
    which = np.flatnonzero(known)
    todo = np.cumsum(end - begin)
    for lo, hi in _portions(todo):
        n = end[lo:hi] - begin[lo:hi]
        w = np.repeat(which[lo:hi], n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[lo:hi], n)
        place = keys[row] & 0xFFFFFFFF
        for k in range(1, windows.shape[1]):            # within reach, rarest term first
            term = windows[w, order[w, k]].astype(np.int64) << 32
            keep = (k >= lengths[w]) | _held(keys, term | np.maximum(place - reach, 0), term | (place + reach))
            w, place = w[keep], place[keep]
        near = w, place
        start = place - order[w, 0]
        w, start = w[start >= 0], start[start >= 0]
        for k in range(1, windows.shape[1]):            # at its own offset
            offset = order[w, k]
            key = windows[w, offset].astype(np.int64) << 32 | (start + offset)
            keep = (k >= lengths[w]) | _held(keys, key, key)
            w, start = w[keep], start[keep]
        yield *near, w, start


def _portions(todo: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of windows with about CANDIDATES places, or one window."""
    lo = 0
    while lo < len(todo):
        done = todo[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(todo, done + CANDIDATES, side="right")))
        yield lo, hi
        lo = hi


def match(index: DataFrame, tests: TestSet, counts: np.ndarray, reach: int) -> DataFrame:
    """Per document: spans of hit words (start, length, ...) and the items
    with exact and with proximity matches."""
    lengths = (tests.windows >= 0).sum(1)
    weight = np.where(tests.windows >= 0, counts[tests.windows], np.iinfo(np.int64).max)
    present = np.flatnonzero((weight > 0).all(1))       # a term met nowhere: no match anywhere
    windows, lengths = tests.windows[present], lengths[present]
    order = np.argsort(weight[present], axis=1, kind="stable").astype(np.int64)
    items = [tests.items[i] for i in present]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, digests, bases, n_words, terms, n, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs = len(ids)
                spans: dict[int, list[int]] = {}
                names: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                if terms and len(windows):
                    terms, n = np.array(terms, np.int64), np.array(n, np.int64)
                    keys = np.repeat(terms, n) << 32 | np.frombuffer(blob, "<i4")
                    last = np.cumsum(n)
                    base = np.array(bases, np.int64)
                    cover = np.zeros(bases[-1] + n_words[-1] + 1, np.int32)
                    for nw, place, w, start in _search(keys, terms, last - n, last, windows, order, lengths, reach):
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + lengths[w], -1)
                        for into, ww, at in ((near, nw, place), (names, w, start)):
                            doc = np.searchsorted(base, at, side="right") - 1
                            for pair in np.unique(doc * len(windows) + ww).tolist():
                                into.setdefault(pair // len(windows), set()).update(items[pair % len(windows)])
                    hit = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False, append=False))
                    for a, z in hit.reshape(-1, 2).tolist():
                        d = int(np.searchsorted(base, a, side="right")) - 1
                        spans.setdefault(d, []).extend((a - bases[d], z - a))
                yield pa.record_batch([pa.array(v, type=f.type) for v, f in zip(
                    [ids, digests, n_words, [spans.get(d, []) for d in range(docs)],
                     [sorted(names.get(d, ())) for d in range(docs)],
                     [sorted(near.get(d, ())) for d in range(docs)]], _FOUND, strict=True)], schema=_FOUND)

    return index.mapInArrow(found, _FOUND_DDL)


def _united(spans: list[int]) -> int:
    """Words covered by (start, length, ...) spans, which may overlap."""
    total = end = 0
    for a, n in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, a + n - max(a, end))
        end = max(end, a + n)
    return total


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, reach: int = 2 * WINDOW,
                  item_bytes: int = ITEM_BYTES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest (MD5 of the
    text), n_words, n_hit, n_items, item_ids (sorted as strings), near_ids
    (items with a proximity match) and contaminated."""
    if reach < window:
        raise ValueError("reach must be a window or more")
    tests = (benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where(F.col("item_id").isNotNull() & F.col("text").isNotNull()))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // item_bytes))
    found = []
    for p in range(parts):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        part = TestSet.of(((r["item_id"], r["text"]) for r in rows), window)
        index = stored(build_index(docs, part.vocabulary, reach + 1, block_words), "postings")
        found.append(match(index, part, term_counts(index, len(part.vocabulary)), reach))
    if parts == 1:
        one = found[0]
        n_hit = F.expr("aggregate(filter(spans, (x, i) -> i % 2 = 1), 0L, (s, x) -> s + x)")
    else:
        # The same document comes once from each part: unite by text and id,
        # then give as many rows as there were.
        both = found[0]
        for f in found[1:]:
            both = both.unionByName(f)
        one = (both.groupBy("doc_id", "digest", "n_words")
               .agg(F.flatten(F.collect_set("spans")).alias("spans"),
                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
                    F.array_sort(F.array_distinct(F.flatten(F.collect_set("near")))).alias("near"),
                    (F.count(F.lit(1)) / parts).cast("int").alias("copies"))
               .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))))
        n_hit = F.udf(_united, "long")("spans")
    return one.select("doc_id", "digest", "n_words", n_hit.alias("n_hit"),
                      F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"),
                      F.col("near").alias("near_ids"), (F.size("spans") > 0).alias("contaminated"))
