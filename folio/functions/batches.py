"""Words and bytes of Arrow batches of texts as numbers, and bitmaps of fixed size that say which hashes are looked for.

Tasks count and compare words without a row for each; only what the bitmap lets through becomes rows, and joins decide on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WORD

#: Texts looked at together, and the bits of the map (16 MB at every size of input).
TEXTS, MAP_BITS = 512, 27
WORDS = regex.compile(WORD)
#: Bytes of a window, and odd factors: of a window's first half, and of a hash for each of its bits in a map.
WINDOWS, HALF, PROBES = (1, 2, 4, 8, 64), np.uint64(0xC2B2AE3D27D4EB4F), tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS))


def word_codes(texts: pa.Array, letters: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word in them, the row of each word), words in the order of the texts: what white space of
    ASCII divides, empty at a text's ends where that is white; or, if `letters`, runs of letters and digits."""
    texts = pc.fill_null(texts, "")
    if letters:
        found = [WORDS.findall(t) for t in texts.to_pylist()]
        words, sizes = pa.array(list(chain.from_iterable(found)), pa.string()), [len(f) for f in found]
    else:
        parts = pc.ascii_split_whitespace(texts)
        words, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy()
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), sizes)


def word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def run_hashes(hashes: np.ndarray, rows: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hash, row) of all runs of each of the sizes, in rising order, inside one row; a run grows from the one before."""
    at, run = np.arange(len(hashes)), np.zeros(len(hashes), np.uint64)
    for size in range(1, max(sizes, default=0) + 1):
        at, run = at[: np.searchsorted(at, len(hashes) - size, "right")], run[: np.searchsorted(at, len(hashes) - size, "right")]
        inside = rows[at] == rows[at + size - 1]
        at, run = at[inside], run[inside]
        run = (run ^ run >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) + hashes[at + size - 1]
        if size in sizes:
            mixed = (run + np.uint64(size)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
            yield size, (mixed ^ mixed >> np.uint64(29)).view(np.int64), rows[at]


def bitmap(rows: DataFrame, column: str, kind: str | None = None) -> tuple[Broadcast, list[int]]:
    """The bits of all hashes of a column, and the kinds (0 to 30) there are. Spark combines the bits; the driver gets at most the
    whole map, whatever the number of rows."""
    bit = F.shiftrightunsigned(F.col(column), 64 - MAP_BITS) + 1
    kinds = F.expr(f"bit_or(shiftleft(1, {kind}))") if kind else F.lit(0)
    found = rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"), kinds.alias("kinds")).collect()
    bits, mask = np.zeros(1 << (MAP_BITS - 3), np.uint8), 0
    for r in found:
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
        mask |= r.kinds
    return rows.sparkSession.sparkContext.broadcast(bits), [k for k in range(31) if mask >> k & 1]


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - MAP_BITS)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in UTF-8 of texts without nulls, where each text begins and the last one ends)."""
    texts = texts.cast(pa.large_string())
    _, starts, data = texts.buffers()
    starts = np.frombuffer(starts, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), starts


def window_hashes(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash) for each size of WINDOWS: of so many bytes from each place on, as if zeros followed. Up to eight bytes the hash is
    the bytes themselves."""
    hashes, size = np.zeros(len(data) + WINDOWS[-1], np.uint64), 1
    hashes[: len(data)] = data
    while True:
        if size in WINDOWS:
            yield size, hashes[: len(data)]
        if size == WINDOWS[-1]:
            return
        if size < 8:
            hashes = hashes[size:] << np.uint64(8 * size) | hashes[:-size]
        else:
            later, hashes = hashes[size:], hashes[:-size] * HALF
            hashes += later
            hashes ^= hashes >> np.uint64(29)
        size *= 2


def span_hashes(first: np.ndarray, last: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes by their first and last windows and their lengths."""
    mixed = (first * HALF + last) * HALF + length.astype(np.uint64)
    return mixed ^ mixed >> np.uint64(31)


def map_bits(hashes: np.ndarray) -> np.ndarray:
    """The bits of a map that stand for hashes."""
    return np.concatenate([(hashes * p >> np.uint64(64 - MAP_BITS)).view(np.int64) for p in PROBES])


def places_in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes all of whose bits the map has."""
    places = None
    for p in PROBES:
        mixed = (hashes if places is None else hashes[places]) * p
        byte = bits.take((mixed >> np.uint64(67 - MAP_BITS)).view(np.int64))
        some = np.flatnonzero(byte)
        bit = (mixed[some] >> np.uint64(64 - MAP_BITS) & np.uint64(7)).astype(np.uint8)
        some = some[(byte[some] >> bit & 1).astype(bool)]
        places = some if places is None else places[some]
    return places


def bit_array(rows: DataFrame, column: str) -> np.ndarray:
    """The bits whose numbers are in a column, in bytes. Spark combines them; the driver gets at most as many bits as the largest
    number, whatever the number of rows."""
    bit = F.col(column) + 1
    found = rows.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(4096 * max((r.bucket for r in found), default=0), np.uint8)
    for r in found:
        bits[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits
