"""Token ids of whole texts by the lower-casing word BPE, exactly as the
``tokenizers`` library gives them.

The vocabulary works on words: text is lower-cased, white space separates
words and is dropped, and merges never cross a word.  So the ids of a text
are the ids of its words in order, and each distinct word needs to be
encoded once.  ``WordIds`` keeps a bounded table of words met.  Texts with
characters outside ``PLAIN`` (where the library's and Python's Unicode rules
could differ) or with ``<|`` are encoded by the library as they are, in
slices cut before white space.
"""

from __future__ import annotations

import re
import struct

import numpy as np

# Characters on which lower-casing, white space and letter classes are the same
# in Python and in the library, and which Unicode normalisation leaves alone.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-©«¬®-±´¶-¸»"
                   "¿-įı-ſ‐-‧€]*")
# The pre-tokenizer's split over PLAIN characters (fixed pattern of the vocabulary file).
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]"
                   "|[^\\sa-zß-öø-ſ0-9]+")
SLICE = 1 << 18            # code points encoded at a time
KEPT = 300_000             # words kept per generation (two generations in memory)

# Byte-level vocabularies spell a byte as one character: itself where that is printable,
# else the next one from 256 on.
_PRINTED = {b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def byte_characters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_BYTES)


class WordIds:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.kept = kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token: the library's merges on its bytes' characters."""
        ids = [t.id for t in self.merges.tokenize(word if word.isascii() else byte_characters(word))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, keys: set[str]) -> None:
        if len(self.young) + 3 * len(keys) > self.kept:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        for k in keys:
            if k in old:
                young[k] = old[k]
                continue
            words = [k] if k.isalpha() else [k[:-1], k[-1]] if k[:-1].isalpha() and k[-1] in ",." else WORDS.findall(k)
            for w in words:
                if w not in young:
                    young[w] = old[w] if w in old else self._word(w)
            if len(words) != 1:
                young[k] = b"".join([young[w] for w in words])

    def _plain(self, text: str) -> bytes:
        keys = text.lower().split()
        found = list(map(self.young.get, keys))
        new = [i for i, v in enumerate(found) if v is None]
        if new:
            self._learn({keys[i] for i in new})
            for i in new:
                found[i] = self.young[keys[i]]
        return b"".join(found)

    def ids(self, text: str) -> bytes:
        from branchdata.llm.common import text_slices
        plain = "<|" not in text and PLAIN.fullmatch(text)
        return b"".join(self._plain(s) if plain else self._encode(s)
                        for s in text_slices(text, SLICE))


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The encoder of this Python worker (kept from task to task)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]
