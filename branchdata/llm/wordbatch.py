"""Words and token ids of whole Arrow batches of texts.

Splitting and the table of distinct words are Arrow kernels over the batch;
Python sees each distinct word of a batch once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from branchdata.llm.wordids import KEPT, PLAIN, WORDS, WordIds


SLICE_BYTES = 1 << 23        # of a batch of texts looked at together


def slices(texts: pa.Array) -> list[slice]:
    """Cuts a batch into runs of texts of about ``SLICE_BYTES`` (one text at least)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cut = np.flatnonzero(np.diff(size // SLICE_BYTES, prepend=0)) if len(size) else []
    at = sorted({0, *map(int, cut), len(size)})
    return [slice(a, b) for a, b in zip(at[:-1], at[1:])]


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words between ASCII white space of every text (null: none):
    bounds (one more than texts) into the flat array of words."""
    lists = pc.ascii_split_whitespace(pc.cast(pc.fill_null(texts, ""), pa.large_string()))
    flat = pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(flat), 0)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return kept[at], flat.filter(full)


def distinct(words: pa.Array) -> list[str]:
    """The words of an array (without spaces) as Python strings."""
    if not len(words):
        return []
    whole = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words)
    return pc.binary_join(whole, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


class Memo:
    """Remembers ``make(key)`` for the keys met: two generations of about
    ``kept`` keys; those met again move on to the younger one."""

    def __init__(self, make: Callable[[str], Any], kept: int) -> None:
        self.make, self.kept = make, kept
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}

    def all(self, keys: list[str]) -> list:
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        young, old, make = self.young, self.old, self.make
        found = list(map(young.get, keys, repeat(self)))
        for i in [i for i, x in enumerate(found) if x is self]:
            k = keys[i]
            found[i] = young[k] = old[k] if k in old else make(k)
        return found


_ENDS_WORD = np.zeros(256, bool)
_ENDS_WORD[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def detach_stops(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts with a space before each full stop or comma between an ASCII
    letter and white space (or the end), and the places of these spaces in the
    new bytes.  The pre-tokenizers cut there anyhow, and far fewer distinct
    words are left."""
    texts = pa.concat_arrays([pc.cast(pc.fill_null(texts, ""), pa.large_string())])
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    if at[0] == at[-1]:
        return texts, np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    stop = np.flatnonzero((data == 44) | (data == 46))
    after = np.append(_ENDS_WORD[data], True)
    after[at[1:-1]] = True                               # a text ends before a text's first byte
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    stop = stop[after[stop + 1] & ~begins[stop] & _LETTER[data[stop - 1]]]
    spaced = np.insert(data, stop, 32)
    return (pa.LargeStringArray.from_buffers(n, pa.py_buffer(at + np.searchsorted(stop, at)), pa.py_buffer(spaced)),
            stop + np.arange(len(stop)))


# The settings of the vocabulary file that words stand for (fixed).
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
     "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class BatchIds(WordIds):
    """Token ids of a batch of texts by the lower-casing word BPE, equal to
    encoding every whole text with the library (see ``wordids``).  With a file
    of other settings every text goes to the library as it is."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        super().__init__(path, kept)
        settings = json.loads(self.tokenizer.to_str())
        self.by_words = settings["normalizer"] == NORMALIZER and settings["pre_tokenizer"] == PRE_TOKENIZER
        self.known = Memo(self._key, kept)

    def _key(self, key: str) -> bytes | None:
        """Ids of a stretch without white space, None if it isn't plain."""
        if key.isascii():
            if key.isalpha():
                return self._word(key.lower())
            if "<|" in key or not key.isprintable():
                return None
        elif not PLAIN.fullmatch(key) or "<|" in key:
            return None
        return b"".join([self._word(w) if w.isalpha() else self._signs(w) for w in WORDS.findall(key.lower())])

    def _signs(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            if len(self.young) > self.kept:
                self.young = {}
            ids = self.young[word] = self._word(word)
        return ids

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bounds, ids): the ids of text i are ids[bounds[i]:bounds[i + 1]]."""
        texts = pc.fill_null(texts, "")
        if not self.by_words:
            own = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.cumsum([0, *map(len, own)]), np.array(sum(own, []), "<u4")
        bounds, words = split_words(detach_stops(texts)[0])
        table = words.dictionary_encode()
        codes = table.indices.to_numpy(zero_copy_only=False)
        spelled = self.known.all(distinct(table.dictionary))
        # A vertical tab or form feed is white space here but not in PLAIN.
        odd = pc.match_substring_regex(texts, "[\x0b\x0c]").to_numpy(zero_copy_only=False).copy()
        rough = np.array([s is None for s in spelled], bool)
        if rough.any():
            seen = np.concatenate([[0], np.cumsum(rough[codes])])
            odd |= seen[bounds[1:]] > seen[bounds[:-1]]
            spelled = [s or b"" for s in spelled]
        sizes = np.array(list(map(len, spelled)), np.int32) // 4
        flat = np.frombuffer(b"".join(spelled), "<u4")
        first = np.cumsum(sizes, dtype=np.int32) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        place = np.repeat(first[codes] - ends[:-1], n)
        place += np.arange(ends[-1])
        ids = flat[place]
        bounds = ends[bounds]
        if odd.any():
            sizes, pieces, last = np.diff(bounds), [], 0
            for i in np.flatnonzero(odd).tolist():
                own = np.frombuffer(self.ids(texts[i].as_py()), "<u4")
                pieces += [ids[bounds[last]:bounds[i]], own]
                sizes[i], last = len(own), i + 1
            ids = np.concatenate([*pieces, ids[bounds[last]:]])
            bounds = np.concatenate([[0], np.cumsum(sizes)])
        return bounds, ids


_ENCODERS: dict[str, BatchIds] = {}


def batch_encoder(path: str) -> BatchIds:
    """The encoder of this Python worker (kept from task to task)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchIds(path)
    return _ENCODERS[path]
