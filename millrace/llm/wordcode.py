"""Words of many texts at once, as byte spans and 64-bit codes, with numpy.

A block of texts is one byte array.  Words are maximal runs of word bytes; both
word rules in use here split at ASCII characters only, so they can be decided
byte by byte in UTF-8.  A word's code is the sum of one random number for each
(place in the word, byte), scrambled with its length: words that differ meet in
one code with probability 2**-64, whatever their form or length.  Codes of word
sequences weigh each place with a random odd number of its own.  Equal words
always have equal codes; where different words must never count as equal, the
caller compares them as well, by `ids` or by their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANKS = [0x20, *range(0x09, 0x0E)]


def _folded() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _folded()
BY_BLANKS = np.ones(256, bool)
BY_BLANKS[_BLANKS] = False
#: digits, lower-case letters and all bytes of characters beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def scramble(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the splitmix generator."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: random numbers for the first places of a word; those of later places come from scramble()
PLACES = 256
_NUMBERS = np.random.default_rng(0x5EED).integers(0, 1 << 64, PLACES * 256, dtype=np.uint64)


def _byte_codes(place: np.ndarray, data: np.ndarray) -> np.ndarray:
    at = place * 256 + data
    near = at < len(_NUMBERS)
    if near.all():
        return _NUMBERS[at]
    out = _NUMBERS[np.where(near, at, 0)]
    far = np.flatnonzero(~near)
    out[far] = scramble(scramble(at[far].astype(np.uint64) * BASE))
    return out


@dataclass
class Words:
    """Words of a block of texts; text i has words first[i]:first[i + 1]."""

    data: np.ndarray  # bytes, folded if asked for
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all words in a row, bounds of each word's, place of each byte in its word)."""
        length = self.end - self.start
        bounds = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], length)
        return self.data[place + np.repeat(self.start, length)], bounds, place

    def codes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        data, bounds, place = self._bytes()
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_codes(place, data), out=total[1:])
        return scramble(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * BASE)

    def ids(self) -> np.ndarray:
        """A number for each word, the same for words of equal bytes and no others."""
        data, bounds, _ = self._bytes()
        held = pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return held.dictionary_encode().indices.to_numpy()

    def joined(self) -> tuple[bytes, np.ndarray]:
        """(all words with one blank behind each, place of each word's first byte in that)."""
        length = self.end - self.start
        start = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(start[-1], 0x20, np.uint8)
        data, _, place = self._bytes()
        out[place + np.repeat(start[:-1], length)] = data
        return out.tobytes(), start

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def split(texts: pa.Array, is_word: np.ndarray, lower: bool) -> Words:
    """Words of an Arrow array of strings; a null has none."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(raw.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    data = LOWER[data] if lower else data
    edge = offsets - lo
    if raw.null_count:  # what stands under a null is not text
        for i in np.flatnonzero(np.asarray(raw.is_null())):
            if edge[i + 1] > edge[i]:
                data = data.copy()
                data[edge[i] : edge[i + 1]] = 0x20
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = edge[(edge > 0) & (edge < len(data))]  # words end where texts do
    begins[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, edge))


def _factors(n: int) -> np.ndarray:
    return scramble(np.arange(1, n + 1, dtype=np.uint64) * BASE) | np.uint64(1)


def sequence_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """A code for each n codes in a row, at the place of the first; text bounds are the caller's matter."""
    return codes_at(codes, np.arange(max(0, len(codes) - n + 1)), n)


def codes_at(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """sequence_codes() at chosen starts only."""
    out = np.zeros(len(starts), np.uint64)
    for k, factor in enumerate(_factors(n)):
        out += codes[starts + k] * factor
    return scramble(out)
