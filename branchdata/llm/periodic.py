"""Periodic runs of words, by longest common extensions (LCE) over a
difference cover.

The words of a group of texts become one array of numbers, each text closed
by a number of its own, so no extension crosses texts.

LCE.  ``COVER`` is a difference cover modulo ``MOD``: for any two places some
shift below ``MOD`` brings both to sampled ones (place mod ``MOD`` in the
cover).  Only the suffixes at sampled places are sorted (by their first
``MOD`` words, then by doubling), with the longest common prefixes of sorted
neighbours in a sparse table.  An LCE compares the few words up to the shift;
where they all agree, a range minimum gives the rest.

Runs.  A run of period q and at least ``times * q`` words holds the words of
places g and g + q for at least two multiples g of q in a row.  So for each q
the extensions at the multiples of q (the harmonic grid, n/1 + n/2 + ... in
all) find every run: the first grid place of a run extends over 2q words or
more, and the run's start, less than q before it, is found by bisection over
extensions.  A run found at several periods (multiples of its smallest) keeps
the smallest.

Defined cases: a null text has no words; each row gives a row, repeated rows
and null ids included; other columns are ignored.  Texts are whole; one text
is read by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOD = 31
COVER = (0, 1, 3, 8, 12, 18)         # fixed: a perfect difference set modulo 31
MIN_WORDS = 6
TIMES = 4
GROUP = 1 << 17                      # words of small texts taken together
PAIRS = 1 << 20                      # grid pairs at a time


def _shifts() -> np.ndarray:
    """For residues a, b: the least shift that brings both into the cover."""
    inside = np.isin(np.arange(MOD), COVER)
    out = np.full((MOD, MOD), MOD, np.int8)
    for h in range(MOD - 1, -1, -1):
        moved = inside[(np.arange(MOD) + h) % MOD]
        out[np.ix_(moved, moved)] = h
    if out.max() >= MOD:
        raise ValueError("not a difference cover")
    return out


SHIFT = _shifts()


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the values of a 1-d array."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
    out = np.empty(len(keys), np.int64)
    out[order] = new
    return out


class Extensions:
    """LCE queries over an array of words whose last value is unique."""

    def __init__(self, words: np.ndarray) -> None:
        n = self.n = len(words)
        self.words = np.concatenate([words.astype(np.int32), np.full(2 * MOD, -1, np.int32)])
        place = np.arange(n)
        self.sampled = np.flatnonzero(np.isin(place % MOD, COVER))
        m = len(self.sampled)
        self.index = np.full(n + MOD + 1, m, np.int32)           # sampled place -> its number; m: past the end
        self.index[self.sampled] = np.arange(m)
        # Levels of doubling: ranks of the first MOD, 2 MOD, 4 MOD ... words.
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.words, MOD)[self.sampled])
        rank = _ranks(np.ascontiguousarray((windows + 1).astype(">i4")).view(f"S{4 * MOD}").ravel()) if m else place
        levels, step = [rank], MOD
        while m and int(rank.max()) < m - 1:
            ahead = self._after(step)
            rank = _ranks(rank * (m + 1) + np.where(ahead < m, np.append(rank, 0)[ahead] + 1, 0))
            levels.append(rank)
            step *= 2
        self.rank = rank.astype(np.int32)
        self._neighbours(levels)

    def _after(self, step: int) -> np.ndarray:
        """Number of the sampled place ``step`` (a multiple of MOD) words on."""
        return self.index[np.minimum(self.sampled + step, self.n + MOD)]

    def _neighbours(self, levels: list[np.ndarray]) -> None:
        """Common prefixes of neighbours in sorted order, as a sparse table."""
        m = len(self.sampled)
        order = np.empty(m, np.int64)
        order[self.rank] = np.arange(m)
        a, b = self.sampled[order[:-1]].copy(), self.sampled[order[1:]].copy()
        length = np.zeros(max(m - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):                 # a level is passed once at most
            level, step = np.append(levels[k], [-1]), MOD << k
            i, j = (self.index[np.minimum(x, self.n + MOD)] for x in (a, b))
            same = (i < m) & (j < m) & (level[i] == level[j])
            for x in (a, b, length):
                x[same] += step
        self.table = [(length + self._words_alike(a, b, np.full(len(a), MOD))).astype(np.int32)]
        while 2 << len(self.table) - 1 <= len(length):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _words_alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words agree from a and b on, ``most`` at most (MOD at most)."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        for h in range(MOD):
            live = live[self.words[a[live] + h] == self.words[b[live] + h]]
            out[live] += 1
            live = live[most[live] > h + 1]
            if not len(live):
                break
        return out

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """LCE of the places a < b, element by element."""
        shift = SHIFT[a % MOD, b % MOD].astype(np.int64)
        out = self._words_alike(a, b, shift)
        far = np.flatnonzero(out == shift)
        if len(far):
            i, j = (self.index[np.minimum(x[far] + shift[far], self.n + MOD)] for x in (a, b))
            inside = (i < len(self.sampled)) & (j < len(self.sampled))
            far, i, j = far[inside], self.rank[i[inside]], self.rank[j[inside]]
            low, high = np.minimum(i, j).astype(np.int64), np.maximum(i, j).astype(np.int64)
            power = np.frexp(high - low)[1] - 1                  # floor of the base-2 logarithm
            for k in np.unique(power).tolist():
                at = np.flatnonzero(power == k)
                row = self.table[k]
                out[far[at]] += np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def _grid(begin: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places g, periods q) for every q and every multiple of q within the
    texts that are long enough for it, at most ``PAIRS`` at a time."""
    low, longest = 1, int(sizes.max()) // TIMES
    while low <= longest:
        high = min(2 * low, longest + 1)                         # periods from low on, below high
        own = np.flatnonzero(sizes >= TIMES * low)
        n = np.minimum(sizes[own] // TIMES, high - 1) - low + 1  # periods of each text
        text = np.repeat(own, n)
        period = low + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends = np.cumsum((sizes[text] - 1) // period)            # g + q is a word too
        for at in range(0, int(ends[-1]), PAIRS):
            pair = np.arange(at, min(at + PAIRS, int(ends[-1])))
            of = np.searchsorted(ends, pair, "right")
            nth = pair - np.where(of > 0, ends[of - 1], 0)
            yield begin[text[of]] + nth * period[of], period[of]
        low = high


def runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of the texts whose words,
    numbered from 0, lie one after the other; in order of text, start, period."""
    none = np.empty(0, np.int64)
    if not len(words) or not len(sizes) or int(sizes.max()) < MIN_WORDS:
        return none, none, none, none
    closed = np.cumsum(sizes + 1)
    joined = np.empty(len(words) + len(sizes), np.int64)
    ends = closed - 1
    inside = np.ones(len(joined), bool)
    inside[ends] = False
    joined[inside] = words
    joined[ends] = int(words.max()) + 1 + np.arange(len(sizes))
    begin = closed - sizes - 1
    extend = Extensions(joined)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for g, q in _grid(begin, sizes):
        same = joined[g] == joined[g + q]
        g, q = g[same], q[same]
        ahead = extend(g, g + q)
        enough = ahead >= np.maximum((TIMES - 2) * q, 1)
        g, q, ahead = g[enough], q[enough], ahead[enough]
        # The start: the first place s in (g - q, g] from which the words agree up to g.
        low = np.maximum(g - q + 1, begin[np.searchsorted(begin, g, "right") - 1])
        high = g.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            reach = extend(mid, mid + q[open_]) >= g[open_] - mid
            high[open_[reach]] = mid[reach]
            low[open_[~reach]] = mid[~reach] + 1
        length = g + ahead + q - high
        # A later grid place of the same run starts a full period before: not the run's start.
        whole = length >= np.maximum(TIMES * q, MIN_WORDS)
        before = high - 1
        inner = (before >= 0) & (joined[np.maximum(before, 0)] == joined[np.maximum(before, 0) + q])
        whole &= ~inner
        found.append((high[whole], length[whole], q[whole]))
    start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (none, none, none)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    text = np.searchsorted(begin, start, "right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - begin[text])[order], length[order], period[order]


def _groups(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of like length together, ``GROUP`` words a group (or one text)."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] >= MIN_WORDS]
    at = 0
    while at < len(order):
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[order[at:]]), GROUP, "right")))
        yield order[at:upto]
        at = upto


def batch_runs(bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` of the texts codes[bounds[i]:bounds[i + 1]], in groups."""
    sizes, found = np.diff(bounds), []
    for own in _groups(sizes):
        n = sizes[own]
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        words = codes[np.repeat(bounds[own], n) + local]
        text, *rest = runs(np.unique(words, return_inverse=True)[1], n)
        found.append((own[text], *rest))
    if not found:
        return (np.empty(0, np.int64),) * 4
    text, start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


RUN = "struct<start: long, length: long, period: long>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (by
    start, then period) and collapsed, the text's words without those that any
    run holds after its first period, joined by one space."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from branchdata.llm.wordbatch import split_words
        for b in batches:
            bounds, words = split_words(b.column(1))
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            text, start, length, period = batch_runs(bounds, codes)
            # Words in a run after its first period: starts less ends so far.
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, bounds[text] + start + period, 1)
            np.add.at(change, bounds[text] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[bounds]
            rest = words.filter(pa.array(kept)) if len(text) else words
            lists = pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), rest)
            per_text = np.searchsorted(text, np.arange(b.num_rows + 1))
            values = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)],
                                                names=["start", "length", "period"])
            yield pa.record_batch([b.column(0), pa.array(np.diff(bounds), pa.int64()),
                                   pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), values),
                                   pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                                  names=["doc_id", "n_words", "runs", "collapsed"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(found, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"))
