"""Vectorised word access over Arrow text columns.

All operators of this subpackage read texts as the raw UTF-8 buffer of an Arrow
column: words are found, folded and hashed with array operations over that
buffer, so no Python object is made per word.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

#: Words are runs of anything but ASCII white space.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Words are runs of ASCII letters, ASCII digits and any non-ASCII character.
ALNUM = np.ones(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = False

#: Bases of the two hashes of a run of words, with their inverses.
_ROLLS = tuple((np.uint64(b), np.uint64(pow(b, -1, 1 << 64))) for b in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Letters of a word whose numbers come from a table; those of later ones are worked out.
PLACES = 128
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0x8EBC6AF09C88C6E3))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _number(code: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A random number of each (place in the word, letter), as place * 256 + letter."""
    return mix(mix((code.astype(np.uint64) + np.uint64(1)) * seed) ^ seed)


_NUMBERS = tuple(_number(np.arange(PLACES << 8), seed) for seed in _SEEDS)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, kept and grown as needed."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 18)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[int(base)] = have
    return have


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null texts are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of some texts.

    hashes: a 64-bit hash of each word; start, end: its byte offsets in raw;
    first: for each text the index of its first word, one more at the end.

    A word's hash is the sum of a random number for each letter at its place, so that two
    different words of any length and make-up share it with a chance of 2 ** -64.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE, fold: bool = True):
        self.raw, self.offsets, self.fold = raw, offsets, fold
        inside = ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hashes = self._hashes(0, inside)

    def _hashes(self, which: int, inside: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        letters = self.raw[inside]
        if self.fold:
            letters = np.take(_LOWER, letters)
        head = np.cumsum(size) - size
        code = np.arange(len(letters)) - np.repeat(head, size)
        code <<= 8
        code |= letters
        if size.max() <= PLACES:
            number = np.take(_NUMBERS[which], code)
        else:
            number, late = np.empty(len(code), np.uint64), code >= PLACES << 8
            number[~late] = _NUMBERS[which][code[~late]]
            number[late] = _number(code[late], _SEEDS[which])
        return mix(np.add.reduceat(number, head) + size.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))

    @cached_property
    def second(self) -> np.ndarray:
        """Another hash of each word, independent of the first."""
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.start] = 1
        inside[self.end] -= 1
        return self._hashes(1, np.cumsum(inside[:-1], dtype=np.int8).view(bool))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (as word index) and hash of every run of so many words of one text."""
        n = self.counts()
        number = np.maximum(n - width + 1, 0)
        starts = np.arange(int(number.sum())) + np.repeat(self.first[:-1] - np.concatenate(([0], np.cumsum(number)[:-1])), number)
        return starts, self.runs(starts, width)

    def runs(self, starts: np.ndarray, width: int | np.ndarray, second: bool = False) -> np.ndarray:
        """Hashes of the runs of width words that begin at starts; second: another one, independent of the first."""
        hashes, (roll, back) = self.second if second else self.hashes, _ROLLS[second]
        m = len(hashes)
        total = np.empty(m + 1, np.uint64)
        total[0] = 0
        np.cumsum(hashes * powers(roll, m)[:m], out=total[1:])
        return mix((total[starts + width] - total[starts]) * powers(back, m)[starts] + np.asarray(width, np.uint64))


#: Words of the widest run whose hash counts for it: longer ones of a certain make-up (Thue-Morse) would share both hashes.
WIDEST = 256


def no_wider(width: int) -> None:
    if width > WIDEST:
        raise ValueError(f"runs of {width} words are wider than {WIDEST}")


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 18):
    """Row ranges of a batch with about limit bytes of text each, never less than a row."""
    _, at = column_bytes(batch.column(batch.schema.get_field_index(column)))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The set of each text: hashes sorted within a text without repeats, and n + 1 offsets.

    A text with fewer than width words but some has its whole sequence as its one shingle.
    """
    n = words.counts()
    short = np.flatnonzero((n > 0) & (n < width))
    starts, hashes = words.windows(width)
    owner = np.repeat(np.arange(len(n)), np.maximum(n - width + 1, 0))
    if len(short):
        hashes = np.concatenate((hashes, words.runs(words.first[short], n[short])))
        owner = np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))
