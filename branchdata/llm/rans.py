"""Static range asymmetric numeral system over blocks of token ids.

One frequency table (a power of two in total, every present symbol at least
one) is shared by all blocks.  A block deals its ids to interleaved lanes, id
``i`` to lane ``i % lanes``; each lane is a 64-bit state that gives or takes
32-bit words of one stream.  Every ``check_every`` rounds over the lanes the
block keeps a checkpoint: all states, the place in the stream and the CRC32
of the stretch's ids.  A reader can start at any checkpoint, so the stretches
of a block are decoded side by side (as more lanes of the same arrays).

Frame (little endian): header, lengths of its documents' pieces, checkpoint
places and CRCs, states, words, CRC32 of all bytes before.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

LANES = 2048
CHECK_EVERY = 128
LOW = np.uint64(1 << 31)              # states stay in [LOW, LOW << 32)
MAGIC = b"TRB1"
_HEAD = struct.Struct("<4sIQIIIIQ")   # magic, table CRC, ids, lanes, rounds a checkpoint, checkpoints, words, ...
_WORD = np.uint64(32)
_MASK = np.uint64(0xFFFFFFFF)


class DamagedBlock(ValueError):
    """A frame whose bytes, checkpoints or ids don't match their checksums."""


@dataclass
class Table:
    """Shared frequencies: ``symbols`` ascending, ``freq`` sums to 2**bits."""

    symbols: np.ndarray
    freq: np.ndarray
    bits: int
    start: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.symbols = np.asarray(self.symbols, np.uint32)
        self.freq = np.asarray(self.freq, np.uint64)
        if len(self.freq) == 0 or int(self.freq.sum()) != 1 << self.bits or int(self.freq.min()) < 1:
            raise ValueError("frequencies must be positive and sum to a power of two")
        self.start = np.cumsum(self.freq) - self.freq

    @classmethod
    def fit(cls, symbols: list[int], counts: list[int]) -> "Table":
        """Frequencies in proportion to whole counts, none below one; the
        total is at least eight times the number of symbols."""
        bits = min(max((8 * len(symbols) - 1).bit_length(), 12), 24)
        total, free = sum(counts), (1 << bits) - len(symbols)
        if free < 0:
            raise ValueError("too many symbols for a table of 2**24")
        freq = [1 + c * free // total for c in counts]
        freq[max(range(len(counts)), key=counts.__getitem__)] += (1 << bits) - sum(freq)
        order = sorted(range(len(symbols)), key=symbols.__getitem__)
        return cls([symbols[i] for i in order], [freq[i] for i in order], bits)

    @property
    def crc(self) -> int:
        return zlib.crc32(self.symbols.astype("<u4").tobytes() + self.freq.astype("<u8").tobytes())

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id in ``symbols``; an id that isn't there raises."""
        if not hasattr(self, "_place"):
            self._place = np.full(int(self.symbols[-1]) + 1, -1, np.int32)
            self._place[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        if len(ids) and (int(ids.max()) >= len(self._place) or int(self._place[ids].min()) < 0):
            raise ValueError("an id is missing from the frequency table")
        return self._place[ids]

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per slot: id, frequency, place within the id's own slots."""
        if not hasattr(self, "_slots"):
            n = self.freq.astype(np.int64)
            own = np.repeat(np.arange(len(n)), n)
            within = np.arange(1 << self.bits, dtype=np.uint64) - self.start[own]
            self._slots = self.symbols[own], self.freq[own], within
        return self._slots


def encode(table: Table, ids: np.ndarray, lengths: np.ndarray, lanes: int = LANES,
           check_every: int = CHECK_EVERY) -> bytes:
    """The frame of a block: ``ids`` and the lengths of the document pieces in it."""
    n = len(ids)
    lanes = max(1, min(lanes, n >> 7))
    rounds = -(-n // lanes)
    at = np.zeros(rounds * lanes, np.int32)               # filled up with the first symbol
    at[:n] = table.index(ids)
    freq, start = table.freq[at].reshape(rounds, lanes), table.start[at].reshape(rounds, lanes)
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = [np.empty(0, np.uint32)] * rounds
    checkpoints = -(-rounds // check_every)
    states = np.empty((checkpoints, lanes), np.uint64)
    for r in range(rounds - 1, -1, -1):
        f = freq[r]
        full = np.flatnonzero(state >= f << room)
        if len(full):
            over = state[full]
            words[r] = (over & _MASK).astype(np.uint32)
            state[full] = over >> _WORD
        times = state // f
        state = (times << bits) + (state - times * f) + start[r]
        if r % check_every == 0:
            states[r // check_every] = state
    given = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    place = given[np.arange(checkpoints) * check_every].astype("<u8")
    step = check_every * lanes
    raw = np.ascontiguousarray(ids, "<u4")
    crcs = np.array([zlib.crc32(raw[i * step:(i + 1) * step].tobytes()) for i in range(checkpoints)], "<u4")
    stream = np.concatenate(words) if rounds else np.empty(0, np.uint32)
    frame = b"".join([
        _HEAD.pack(MAGIC, table.crc, n, lanes, check_every, checkpoints, len(lengths), len(stream)),
        np.asarray(lengths, "<u8").tobytes(), place.tobytes(), crcs.tobytes(), states.astype("<u8").tobytes(),
        stream.astype("<u4").tobytes()])
    return frame + struct.pack("<I", zlib.crc32(frame))


def decode(table: Table, frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, piece lengths) of a frame; anything that fails a check raises."""
    if len(frame) < _HEAD.size + 4 or struct.unpack("<I", frame[-4:])[0] != zlib.crc32(frame[:-4]):
        raise DamagedBlock("the frame's checksum doesn't match")
    magic, crc, n, lanes, every, checkpoints, pieces, n_words = _HEAD.unpack_from(frame)
    if magic != MAGIC or crc != table.crc:
        raise DamagedBlock("not a frame of this frequency table")
    at = _HEAD.size

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(frame, kind, count, at)
        at += got.nbytes
        return got

    lengths = take(pieces, "<u8").astype(np.int64)
    place, crcs = take(checkpoints, "<u8").astype(np.int64), take(checkpoints, "<u4")
    states = take(checkpoints * lanes, "<u8").astype(np.uint64).reshape(checkpoints, lanes)
    words = take(n_words, "<u4")
    if n == 0:
        return np.empty(0, np.uint32), lengths
    symbol, freq, within = table.slots()
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    rounds = -(-n // lanes)
    out = np.zeros((checkpoints, every, lanes), np.uint32)
    state, read = states.copy(), place.copy()
    last = rounds - (checkpoints - 1) * every             # rounds of the last stretch
    for r in range(min(every, rounds)):
        if r == last and checkpoints > 1:                 # the last stretch is done
            ended, state, read = state[-1], state[:-1].copy(), read[:-1].copy()
            if not (ended == LOW).all():
                raise DamagedBlock("a lane doesn't end where it began")
        slot = (state & mask).astype(np.int64)
        out[:len(state), r] = symbol[slot]
        state = freq[slot] * (state >> bits) + within[slot]
        short = state < LOW
        if short.any():
            rank = np.cumsum(short, axis=1)
            where = np.flatnonzero(short.ravel())
            state.ravel()[where] = (state.ravel()[where] << _WORD) | words[(read[:, None] + rank - 1).ravel()[where]]
            read += rank[:, -1]
    target = np.vstack([states[1:], np.full((1, lanes), LOW, np.uint64)])[:len(state)]
    if not (state == target).all():
        raise DamagedBlock("a stretch doesn't end at the next checkpoint")
    ids = out.reshape(-1)[:n]
    step = every * lanes
    for i, c in enumerate(crcs.tolist()):
        if zlib.crc32(ids[i * step:(i + 1) * step].astype("<u4").tobytes()) != c:
            raise DamagedBlock(f"the ids of stretch {i} don't match their checksum")
    return ids, lengths
