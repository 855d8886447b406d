"""Words, shingles and their 64-bit hashes for whole Arrow columns at once, with numpy over the raw UTF-8 bytes.

Everything works on slices of a few megabytes, so a task's memory does not follow the length of its partition; only a
single text longer than a slice makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
#: Span hashes are computed over windows of two of these many bytes.
WINDOW = 1 << 20
U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)

#: True for bytes of words: all but the ASCII white space \x20 and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: True for ASCII letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * STEP)


#: A random number for each byte; in BYTE_CODES A-Z have those of a-z.
RAW_CODES = constants(256, 1)
BYTE_CODES = RAW_CODES.copy()
BYTE_CODES[0x41:0x5B] = BYTE_CODES[0x61:0x7B]
BASE = int(constants(1, 2)[0]) | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(2)
def powers(base: int) -> np.ndarray:
    """Its powers for the places of two windows: the one table that hashing keeps."""
    out = np.full(2 * WINDOW, U64(base))
    out[0] = 1
    return np.cumprod(out)


class Slice:
    """Some consecutive texts of a column. `first[i]:first[i+1]` are the words of text i (of `lo + i` in the column)."""

    def __init__(self, lo: int, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.lo, self.data, self.offsets, self.n = lo, data, offsets, len(offsets) - 1
        inside = is_word[data]
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def word_hashes(self, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
        """A hash of each word, with A-Z lower-cased unless codes are RAW_CODES."""
        return self.span_hashes(self.starts, self.ends, codes)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span, in the order of their starts, from differences of running polynomial sums.
        The sums are taken over windows, so their memory follows neither the text's length nor a span's."""
        out = np.zeros(len(starts), U64)
        step = WINDOW if len(self.data) > 2 * WINDOW else 2 * WINDOW
        for lo in range(0, len(self.data), step):
            a, b = np.searchsorted(starts, (lo, lo + step))
            if a == b:
                continue
            s, e = starts[a:b], ends[a:b]
            short = e - lo <= 2 * WINDOW
            hi = int(e[short].max(initial=lo))
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum(codes[self.data[lo:hi]] * powers(BASE)[: hi - lo], out=total[1:])
            out[a:b][short] = (total[e[short] - lo] - total[s[short] - lo]) * powers(BASE_INVERSE)[s[short] - lo]
            for i in np.flatnonzero(~short):
                out[a + i] = self._long_sum(int(s[i]), int(e[i]), codes)
        return mix(out + (ends - starts).astype(U64) * STEP)

    def _long_sum(self, start: int, end: int, codes: np.ndarray) -> np.uint64:
        total = 0
        for lo in range(start, end, WINDOW):
            part = codes[self.data[lo : min(lo + WINDOW, end)]]
            total += int((part * powers(BASE)[: len(part)]).sum()) * pow(BASE, lo - start, 1 << 64)
        return U64(total % (1 << 64))


def slices(column: pa.Array, is_word: np.ndarray = NOT_SPACE, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's texts (null: empty) in slices."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slice_bytes, "right")) - 1)
        yield Slice(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], is_word)
        lo = hi


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of `size` words; a text of fewer words, but not none,
    has its whole word sequence as its one shingle; null, empty or blank texts have none."""
    factors = constants(size, 3) | U64(1)
    for part in slices(column):
        words = part.word_hashes()
        full = np.zeros(max(0, len(words) - size + 1), U64)
        for k in range(size):
            full += words[k : k + len(full)] * factors[k]
        full = mix(full)
        for i in range(part.n):
            a, b = part.first[i], part.first[i + 1]
            if b - a >= size:
                found = np.sort(full[a : b - size + 1])
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                with np.errstate(over="ignore"):
                    yield mix(np.array([(words[a:b] * factors[: b - a]).sum() + U64(b - a) * STEP], U64))
            else:
                yield full[:0]
