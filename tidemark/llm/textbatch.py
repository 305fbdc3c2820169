"""Words and word hashes of a batch of texts, as whole-array numpy work.

Helpers for Arrow-batched operators: a batch of texts stays one UTF-8 buffer with offsets, and word
boundaries, lower-casing (A-Z only) and 64-bit word hashes are computed for the whole buffer at once. Texts are
taken in slices of about ``SLICE_BYTES`` (a longer text is a slice of its own), so memory follows the slice and the
longest text, not the batch (a text's words take some ten times its bytes while it is worked on).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Words of more bytes are hashed one by one: polynomials modulo 2**64 can take crafted words of some thousand letters for one another.
LONG = 64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the SplitMix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def give_back() -> None:
    """Returns freed memory of this worker to the system: allocators keep what arrays of some MB leave behind."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


class Texts:
    """A run of texts: UTF-8 bytes, text offsets, word bounds and the words of each text."""

    #: Which bytes stand between words.
    GAP = _SPACE

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~self.GAP[data] if len(data) else np.zeros(0, bool)
        before, after = np.empty_like(solid), np.empty_like(solid)
        if len(solid):
            before[0], before[1:] = False, solid[:-1]
            after[-1], after[:-1] = False, solid[1:]
            full = offsets[1:] > offsets[:-1]
            before[offsets[:-1][full]] = False
            after[offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        #: Words of text i: self.first[i] .. self.first[i + 1]
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def word_counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z lower-cased if asked."""
        h, at = np.empty(len(self.starts), np.uint64), 0
        while at < len(h):
            # Words of about a slice at a time, so that tables and sums stay small within a very long text too.
            low = int(self.starts[at])
            end = max(at + 1, int(np.searchsorted(self.ends, low + SLICE_BYTES, "right")))
            high = min(int(self.ends[end - 1]), low + SLICE_BYTES)
            power, inverse = _power_tables(high - low)
            running = np.zeros(high - low + 1, np.uint64)
            terms = (_LOWER[self.data[low:high]] if lower else self.data[low:high]).astype(np.uint64)
            terms += np.uint64(1)
            terms *= power
            np.cumsum(terms, out=running[1:])
            starts, ends = self.starts[at:end] - low, np.minimum(self.ends[at:end], high) - low
            h[at:end] = (running[ends] - running[starts]) * inverse[starts]
            at = end
        size = self.ends - self.starts
        for i in np.flatnonzero(size > LONG).tolist():
            word = self.data[self.starts[i] : self.ends[i]]
            h[i] = int.from_bytes(blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), "little")
        return mix(h ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Terms(Texts):
    """Texts whose words are runs of digits, letters and all that is not ASCII."""

    GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES, made: type[Texts] = Texts) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) of consecutive runs of rows; a null text counts as empty."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for chunk in chunks:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        n = len(chunk)
        if not n:
            continue
        kind = np.int64 if pa.types.is_large_string(chunk.type) else np.int32
        _, raw_offsets, raw_data = chunk.buffers()
        offsets = np.frombuffer(raw_offsets, kind)[chunk.offset : chunk.offset + n + 1].astype(np.int64)
        data = np.frombuffer(raw_data, np.uint8) if raw_data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
            end = min(n, max(end, at + 1))
            yield row + at, made(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
        row += n
