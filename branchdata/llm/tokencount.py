"""Token counts of whole texts by a byte-level BPE of the ``tokenizers``
library, with overlap resynchronisation for huge documents.

Ordinary texts.  The pre-tokenizer never joins a character to a following
" x" (a space before a non-space): each such space starts a new pre-token.
So a text's count is the sum over its words (with the one space before them)
and over what is left of the white space between them.  A whole batch is cut
into words and white space at once, and each distinct word is looked at once:
a plain one is the sum of its letter, digit and sign stretches, whose merges
are asked of the library's model, and bounded tables keep the counts.  A text
with other characters (other white space, special strings) goes the plain way,
part by part through the library; where the file's pre-tokenizer isn't the
one that this cut stands for, the library encodes every text whole.

Huge texts (over ``chunk`` code points).  Overlapping chunks are encoded by
the library with offsets and word numbers.  A chunk's encoding is trusted up
to a margin before its end (what comes later may depend on text not seen).
A boundary is stable when it starts a pre-token in the trusted part of both
neighbours: splitting goes on from a boundary without looking back, so from
there both encodings agree.  The counts are spliced at the last such
boundary of the overlap.  If there is none, the right-hand chunk starts
earlier (twice the overlap) and, where it can't, the left one ends later
(twice as long), until one is found or the text ends.

Defined cases: a null text has 0 bytes and 0 tokens, like an empty one; each
row gives a row, repeated rows and null ids included; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchdata.llm.wordbatch import Memo, detach_stops, distinct, slices, split_words
from branchdata.llm.wordids import PLAIN, byte_characters

CHUNK = 1 << 16      # code points encoded at a time
OVERLAP = 512
MARGIN = 32          # over the longest look-ahead (special strings included)
LIMIT = 512
KEPT = 300_000
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

# The settings of the vocabulary file that the cut into words stands for (fixed).
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
# The pre-tokenizer's stretches over PLAIN characters of a word with its space.
_STRETCH = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ſ0-9]+")
_SPACE = byte_characters(" ")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_PART = re.compile(r" (?=\S)")
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_TAIL = re.compile(r"[A-Za-z][.,]\Z")


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, kept: int = KEPT) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.chunk, self.overlap, self.kept = chunk, overlap, kept
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        settings = json.loads(self.tokenizer.to_str())
        self.known = settings["pre_tokenizer"] == PRE_TOKENIZER and settings["normalizer"] is None
        self.merges = self.tokenizer.model
        self.words = Memo(self._word, kept)
        self.signs: dict[str, int] = {}
        self.spaces: dict[bytes, int] = {}

    # -- batches of ordinary texts ----------------------------------------
    def _stretch(self, s: str) -> int:
        if s.isalpha():
            return len(self.merges.tokenize(s if s.isascii() else byte_characters(s)))
        n = self.signs.get(s)
        if n is None:
            if len(self.signs) > self.kept:
                self.signs = {}
            spelled = s.replace(" ", _SPACE) if s.isascii() else byte_characters(s)
            n = len(self.merges.tokenize(spelled))
            if not s[1:].isalpha():
                self.signs[s] = n
        return n

    def _word(self, word: str) -> int | None:
        """Tokens of a word, with or without a space before it; None: not plain."""
        if not (word.isascii() and word.isprintable() or PLAIN.fullmatch(word)) or "<|" in word:
            return None
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return self._stretch(word)
        return sum([self._stretch(s) for s in _STRETCH.findall(word)])

    def _space(self, run: bytes, followed: bool) -> int:
        """Tokens of a stretch of two or more white-space characters (the
        space that goes to a following word left out)."""
        if not followed:
            parts = [run]
        elif run.endswith(b" "):
            parts = [run[:-1]]
        else:
            parts = [run[:-1], run[-1:]]
        for p in parts:
            if p not in self.spaces:
                self.spaces[p] = len(self.merges.tokenize(byte_characters(p.decode())))
        return sum(self.spaces[p] for p in parts)

    def batch(self, texts: pa.Array) -> np.ndarray:
        """Token counts of ordinary texts (nulls count as empty)."""
        if not self.known:
            whole = self.tokenizer.encode
            return np.array([len(whole(t or "", add_special_tokens=False).ids) for t in texts.to_pylist()], np.int64)
        if len(self.spaces) > self.kept:
            self.spaces = {}
        spread, inserted = detach_stops(texts)
        n = len(spread)
        at = np.frombuffer(spread.buffers()[1], np.int64)[spread.offset:spread.offset + n + 1]
        if at[0] == at[-1]:
            return np.zeros(n, np.int64)
        data = np.frombuffer(spread.buffers()[2], np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        space = _IS_SPACE[data]
        first = np.zeros(len(data) + 1, bool)              # a text begins here (or the batch ends)
        first[at] = True
        after_space = np.concatenate([[False], space[:-1]]) & ~first[:-1]
        starts = np.flatnonzero(~space & (after_space | first[:-1]))
        own_space = data == 32
        own_space[inserted] = False
        spaced = after_space[starts] & own_space[starts - 1]
        # Words: each distinct one, with or without a space before it.
        bounds, words = split_words(spread)
        table = words.dictionary_encode()
        keys = table.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + spaced
        asked = np.zeros((len(table.dictionary), 2), bool)
        asked.ravel()[keys] = True
        names = np.array(distinct(table.dictionary), object)
        got = self.words.all([*names[asked[:, 0]], *(" " + names[asked[:, 1]])])
        got = np.array([-1 if x is None else x for x in got], np.int64)
        tokens = np.zeros(asked.shape, np.int64)
        tokens[asked[:, 0], 0], tokens[asked[:, 1], 1] = np.split(got, [asked[:, 0].sum()])
        tokens = tokens.ravel()
        per_word = tokens[keys]
        sums = np.concatenate([[0], np.cumsum(per_word)])[bounds]
        odd = np.concatenate([[0], np.cumsum(per_word < 0)])[bounds]
        out, odd = np.diff(sums), np.diff(odd) > 0
        # White space: single characters but a space before a word are a token each.
        begin = np.flatnonzero(space & ~after_space)
        last = np.flatnonzero(space & (first[1:] | np.concatenate([~space[1:], [True]])))
        followed = ~first[last + 1]
        count = np.where((last == begin) & followed & (data[begin] == 32), 0, 1)
        raw = data.tobytes()
        for i in np.flatnonzero(last > begin).tolist():
            count[i] = self._space(raw[begin[i]:last[i] + 1], bool(followed[i]))
        np.add.at(out, np.searchsorted(at, begin, "right") - 1, count)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.ordinary(texts[i].as_py())
        return out

    # -- ordinary texts -------------------------------------------------
    def _parts(self, text: str) -> list[str]:
        first, *rest = _PART.split(text)
        return [first, *(" " + r for r in rest)]

    def _learn(self, keys: set[str]) -> None:
        if len(self.young) + 3 * len(keys) > self.kept:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        made: dict[str, list[str]] = {}
        missing: set[str] = set()
        for k in keys:
            pieces: list[str] = []
            for i, line in enumerate(_LINE.split(k)):     # x\ny: three pre-tokens or more
                if i:
                    pieces.append("\n")
                if _TAIL.search(line):                    # a letter and a full stop or comma: two
                    pieces += [line[:-1], line[-1]]
                else:
                    pieces.append(line)
            made[k] = pieces
            for p in pieces:
                if p not in young:
                    if p in old:
                        young[p] = old[p]
                    else:
                        missing.add(p)
        if missing:
            words = list(missing)
            young.update(zip(words, (len(e.ids) for e in self.tokenizer.encode_batch_fast(
                words, add_special_tokens=False)), strict=True))
        for k, pieces in made.items():
            young[k] = sum(young[p] for p in pieces)

    def ordinary(self, text: str) -> int:
        if not text:
            return 0
        parts = self._parts(text)
        found = list(map(self.young.get, parts))
        if None in found:
            self._learn({k for k, v in zip(parts, found, strict=True) if v is None})
            young, old = self.young, self.old
            found = [young[k] if k in young else old[k] for k in parts]
        return sum(found)

    # -- huge texts -----------------------------------------------------
    def _starts(self, text: str, begin: int, end: int) -> tuple[dict[int, int], int]:
        """For text[begin:end]: place of each pre-token start -> tokens before
        it, and the number of tokens."""
        e = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        starts: dict[int, int] = {}
        last: object = self
        for i, (word, (a, b)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != last:
                starts[begin + a] = i
            last = word
            if word is None:                  # a special string: what follows starts anew
                starts[begin + b] = i + 1
                last = self
        return starts, len(e.ids)

    def huge(self, text: str) -> int:
        """Count by overlapping chunks.  ``base`` is a proven pre-token start
        of the text with ``total`` tokens before it; the chunk that holds it
        has ``done`` of its own tokens before it."""
        n, total, base, done = len(text), 0, 0, 0
        size, end = self.chunk, min(n, self.chunk)
        left, count = self._starts(text, 0, end)
        overlap = self.overlap
        while end < n:
            begin = max(base, end - overlap)
            stop = min(n, begin + self.chunk)
            right, right_count = self._starts(text, begin, stop) if stop > end else ({}, 0)
            common = [p for p in left.keys() & right.keys() if base < p <= end - MARGIN]
            if common:
                p = max(common)
                total += left[p] - done
                left, count, done, base, end = right, right_count, right[p], p, stop
                size, overlap = self.chunk, self.overlap
            elif begin > base:
                overlap *= 2                                  # start the right-hand chunk earlier
            else:
                size *= 2                                     # no boundary so far: a longer left chunk
                end, done, overlap = min(n, base + size), 0, self.overlap
                left, count = self._starts(text, base, end)
        return total + count - done


_COUNTERS: dict[tuple, Counter] = {}


def counter(path: str, chunk: int, overlap: int) -> Counter:
    key = (path, chunk, overlap)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, chunk, overlap)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens,
    over_limit.  One pass, no shuffle."""
    if overlap <= 2 * MARGIN or chunk < 2 * overlap:
        raise ValueError("overlap must exceed twice the margin, and a chunk two overlaps")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer, chunk, overlap)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            huge = pc.greater(pc.utf8_length(texts), chunk)
            rest = pc.if_else(huge, "", texts)
            tokens = np.concatenate([c.batch(rest[x.start:x.stop]) for x in slices(rest)] or [np.zeros(0, np.int64)])
            for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)).tolist():
                tokens[i] = c.huge(texts[i].as_py())
            yield pa.record_batch([b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens, pa.int64())],
                                  schema=COUNTS)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
