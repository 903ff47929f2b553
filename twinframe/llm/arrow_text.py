"""Texts of an Arrow batch as one byte buffer, and words of it with 64-bit hashes, all by whole-array operations.

Words are runs of bytes that are not ASCII white space. A multi-byte UTF-8 character never holds an ASCII byte, so
splitting bytes and splitting code points at ASCII white space give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes and texts worked on at once inside a task; a longer single text is worked on alone.
SLICE_BYTES = 1 << 19
SLICE_TEXTS = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def word_bytes() -> np.ndarray:
    """Which byte values belong to words."""
    table = np.ones(256, dtype=bool)
    table[list(_SPACES)] = False
    return table


def lower_bytes() -> np.ndarray:
    """Byte values with A-Z lowered."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def letter_bytes() -> np.ndarray:
    """Byte values of letters, digits and everything beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[128:] = table[48:58] = table[65:91] = table[97:123] = True
    return table


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown when a longer buffer comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 2 * SLICE_BYTES)
            self.up = np.full(size, _BASE, dtype=np.uint64)
            self.down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[: n + 1], self.down[: n + 1]


@dataclass
class Words:
    """Words of a run of texts: text number, byte range and hash of each, in order."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


@dataclass
class Texts:
    """Bytes of a run of texts and where each begins; ``first`` is the number of the first in its batch."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix_hash(self, powers: Powers, table: np.ndarray | None = None) -> np.ndarray:
        values = self.data if table is None else table[self.data]
        up, _ = powers.upto(len(values))
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return sums

    def span_hash(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
        """Hash of each byte range; equal bytes give equal values wherever they stand."""
        _, down = powers.upto(len(self.data))
        return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of ``member`` bytes; no run crosses from one text into the next."""
        before = np.empty_like(member)
        before[:1] = False
        before[1:] = member[:-1]
        begins = self.offsets[:-1]
        before[begins[begins < len(member)]] = False
        after = np.empty_like(member)
        after[-1:] = False
        after[:-1] = member[1:]
        ends = self.offsets[1:] - 1
        after[ends[ends >= 0]] = False
        return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1

    def text_of(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, start, side="right") - 1

    def words(self, powers: Powers, lower: bool = False, member: np.ndarray | None = None) -> Words:
        """Words in order; ``member`` tells which byte values belong to words, if not all but white space."""
        start, end = self.runs((word_bytes() if member is None else member)[self.data])
        sums = self.prefix_hash(powers, lower_bytes() if lower else None)
        return Words(self.text_of(start), start, end, self.span_hash(sums, start, end, powers))


def texts_of(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column, null as empty, in runs of about ``slice_bytes`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + slice_bytes, side="right")) - 1
        last = min(n, max(last, first + 1), first + SLICE_TEXTS)
        yield Texts(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def counts_per_text(texts: Texts, marks: np.ndarray) -> np.ndarray:
    """Sum of ``marks`` (one number per byte) over each text."""
    sums = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]


def repeated_words(words: Words, n_texts: int, width: int = 3) -> np.ndarray:
    """Words of each text that stand in a window of ``width`` words found twice or more in that text."""
    n = len(words.hash)
    covered = np.zeros(n, dtype=bool)
    if n >= width:
        last = n - width + 1
        inside = words.text[:last] == words.text[width - 1 :]
        window = words.text[:last].astype(np.uint64)
        for k in range(width):
            window = mixed(window * np.uint64(0x9E3779B97F4A7C15) + words.hash[k : k + last])
        at = np.flatnonzero(inside)
        _, which, found = np.unique(window[at], return_inverse=True, return_counts=True)
        again = at[found[which] > 1]
        for k in range(width):
            covered[again + k] = True
    return np.bincount(words.text[covered], minlength=n_texts)
