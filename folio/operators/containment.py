"""Which texts have which passages verbatim, by joins: the rarest run of words of a passage finds candidates, contains() decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import MAP_BITS, WINDOWS, bit_array, bitmap, has_bit, map_bits, places_in, run_hashes, slices, span_hashes, text_bytes, window_hashes, word_codes, word_hashes

#: Words of a run, runs of a passage that are looked for, and characters of one inside a word where a passage has no whole word inside.
RUN_WORDS, RUNS, RUN_CHARS = 4, 4, 8
#: Bytes of texts that are searched at once, places and lengths that are compared at once, and the maps' sizes in bits and in bytes.
STRETCH, PAIRS, MAP, MAP_BYTES = 1 << 15, 1 << 18, 1 << MAP_BITS, 1 << (MAP_BITS - 3)


def _runs(hashes: np.ndarray, rows: np.ndarray, most: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, hash, row) of the runs to look for in each of n rows: of `most` units or all there are, RUNS with the least hashes."""
    sizes = np.minimum(np.bincount(rows, minlength=n), most)
    for size, gram, row in run_hashes(hashes, rows, list(range(1, most + 1))):
        gram, row = gram[sizes[row] == size], row[sizes[row] == size]
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < RUNS
        yield size, gram[kept], row[kept]


def _characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code point, word) of each character."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.repeat(np.arange(len(words)), pc.utf8_length(words).to_numpy())


def _wanted(batches: Iterator[pa.RecordBatch], inner: bool) -> Iterator[pa.RecordBatch]:
    """(pid, kind, gram) of batches (pid, passage): runs of the words but for the first and last; or, not inner, of all words."""
    for batch in slices(batches):
        words, codes, rows = word_codes(batch["passage"])
        hashes = word_hashes(words)[codes]
        if inner:
            same = rows[1:] == rows[:-1]
            own = np.r_[False, same][: len(rows)] & np.r_[same, False][: len(rows)]
            hashes, rows = hashes[own], rows[own]
        for kind, gram, row in _runs(hashes, rows, RUN_WORDS, batch.num_rows):
            yield pa.RecordBatch.from_arrays([batch["pid"].take(pa.array(row)), pa.array(np.full(len(row), kind, np.int32)), pa.array(gram)], ["pid", "kind", "gram"])


def _wanted_in_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, kind, gram) of batches (part): runs of characters."""
    for batch in slices(batches):
        for kind, gram, row in _runs(*_characters(batch["part"]), RUN_CHARS, batch.num_rows):
            yield pa.RecordBatch.from_arrays([batch["part"].take(pa.array(row)), pa.array(np.full(len(row), kind, np.int32)), pa.array(gram)], ["part", "kind", "gram"])


def _there(batches: Iterator[pa.RecordBatch], bits: Broadcast, kinds: list[int]) -> Iterator[pa.RecordBatch]:
    """(tid, gram) of batches (tid, text): the runs of words that the bitmap has, once a text."""
    for batch in slices(batches):
        words, codes, rows = word_codes(batch["text"])
        hashes = word_hashes(words)[codes]
        for _, gram, row in run_hashes(hashes, rows, kinds):
            kept = has_bit(bits.value, gram)
            gram, row = gram[kept], row[kept]
            order = np.lexsort((gram, row))
            gram, row = gram[order], row[order]
            new = np.r_[True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])][: len(row)]
            yield pa.RecordBatch.from_arrays([batch["tid"].take(pa.array(row[new])), pa.array(gram[new])], ["tid", "gram"])


def _in_words(batches: Iterator[pa.RecordBatch], bits: Broadcast, kinds: list[int]) -> Iterator[pa.RecordBatch]:
    """(word, gram) of batches (text): the words that have a run of characters of the bitmap."""
    for batch in slices(batches):
        words = word_codes(batch["text"])[0].cast(pa.string())
        points, rows = _characters(words)
        for _, gram, row in run_hashes(points, rows, kinds):
            kept = has_bit(bits.value, gram)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(row[kept])), pa.array(gram[kept])], ["word", "gram"])


def _rarest(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """wanted(key, gram), there(gram, ...) -> (key, gram): of each key the gram that the fewest rows have; keys of a gram that
    none has are left out."""
    counted = there.groupBy("gram").agg(F.count("*").alias("n"))
    least = wanted.join(counted, "gram", "left").groupBy(key).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    return least.where("r.n > 0").select(key, "r.gram")


def _words_with_parts(short: DataFrame, texts: DataFrame) -> DataFrame:
    """(pid, passage) of passages of one or two words or parts of words: a row for each distinct word of the texts that has the
    longest of them in it. Of the words only those move that have a run of a part's characters; the
    few that are found are kept by the session, as the map and the candidates both need them."""
    longest = F.element_at(F.array_sort(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    parts = short.select("pid", longest.alias("part")).where("part != ''")
    wanted = parts.select("part").distinct().mapInArrow(_wanted_in_words, "part string, kind int, gram long")
    bits, kinds = bitmap(wanted, "gram", "kind")
    there = texts.select("text").mapInArrow(lambda b: _in_words(b, bits, kinds), "word string, gram long").distinct()
    words = there.join(_rarest(wanted.select("part", "gram"), there, "part"), "gram").where(F.col("word").contains(F.col("part"))).select("part", "word").distinct().persist()
    return parts.join(words, "part").select("pid", F.col("word").alias("passage"))


def contained(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """passages(pid, passage), texts(tid, text) -> (pid, tid) of each text that has the whole passage verbatim, once each.

    A passage's words but for the first and last, which can be parts of words of a text, are words of the text in the same
    order. Runs of up to RUN_WORDS of them are hashed; of the texts' runs only those become rows whose bit is in a map of all that
    are looked for. The rarest of each passage is joined with them, and the candidates are then compared. Where no whole word is
    inside, the longest part is looked for in the distinct words of the texts, and the words that have it are looked for as runs.
    Neither passages nor texts come to the driver, only the map and the lengths of runs there are. Empty, blank and null
    passages are nowhere."""
    passages = passages.where(F.btrim("passage", F.lit(" \t\n\x0b\x0c\r")) != "").select("pid", "passage")
    texts = texts.where("text is not null").select("tid", "text")
    pid, tid = dict(passages.dtypes)["pid"], dict(texts.dtypes)["tid"]
    long = passages.mapInArrow(lambda b: _wanted(b, True), f"pid {pid}, kind int, gram long")
    short = passages.withColumn("words", F.split("passage", r"\s+")).where(F.size("words") < 3)
    parts = None
    if not short.isEmpty():
        parts = _words_with_parts(short, texts).mapInArrow(lambda b: _wanted(b, False), f"pid {pid}, kind int, gram long")
    bits, kinds = bitmap(long if parts is None else long.union(parts), "gram", "kind")
    there = texts.mapInArrow(lambda b: _there(b, bits, kinds), f"tid {tid}, gram long")
    asked = _rarest(long.select("pid", "gram"), there, "pid")
    found = there.join(asked if parts is None else asked.union(parts.select("pid", "gram")), "gram").select("pid", "tid").distinct()
    # Passages come before texts, so that each text moves once and not with every candidate.
    compared = found.join(passages, "pid").join(texts, "tid")
    return compared.where(F.col("text").contains(F.col("passage"))).select("pid", "tid").distinct()


def _window_of(lengths: np.ndarray) -> np.ndarray:
    """The longest window that fits each length."""
    return np.array(WINDOWS)[np.searchsorted(WINDOWS, lengths, "right") - 1]


def _span_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bit) of batches (passage): of each passage the bits of its first window, one map further those of its first and last window and
    its length, and behind both maps its length."""
    for batch in slices(batches):
        data, starts = text_bytes(batch["passage"].unique())
        data, starts = data[starts[0] : starts[-1]], starts - starts[0]
        lengths, found = np.diff(starts), []
        for size, hashes in window_hashes(data):
            own = np.flatnonzero(_window_of(lengths) == size)
            first, length = hashes[starts[own]], lengths[own]
            spans = span_hashes(first, hashes[starts[own] + length - size], length)
            found += [map_bits(first), MAP + map_bits(spans), 2 * MAP + length]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["bit"])


def _spans(data: np.ndarray, starts: np.ndarray, bits: np.ndarray, by_size: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, length) of the stretches of the texts that the maps let through; by place among those of one length and stretch of
    data. Of equal ones under eight bytes only the first in a stretch of data."""
    longest = max(int(x[-1]) for x in by_size.values())
    step = max(STRETCH, 4 * longest)
    for a in range(int(starts[0]), int(starts[-1]), step):
        for size, hashes in window_hashes(data[a : min(a + step + longest, int(starts[-1]))]):
            if size not in by_size:
                continue
            heads, lengths = places_in(bits[:MAP_BYTES], hashes[:step]), by_size[size]
            row = np.searchsorted(starts, heads + a, "right") - 1
            room = starts[row + 1] - heads - a
            block = max(1, PAIRS // len(lengths))
            for b in range(0, len(heads), block):
                i, j = np.nonzero(room[b : b + block, None] >= lengths)
                at, length = heads[b + i], lengths[j]
                first, last = hashes[at], hashes[at + length - size]
                kept = places_in(bits[MAP_BYTES : 2 * MAP_BYTES], span_hashes(first, last, length))
                if size < 8:
                    whole = first[kept] | last[kept] << (8 * (length[kept] - size)).astype(np.uint64) | length[kept].astype(np.uint64) << np.uint64(56)
                    kept = kept[np.sort(np.unique(whole, return_index=True)[1])]
                yield row[b + i[kept]], at[kept] + a, length[kept]


def _first_with(batches: Iterator[pa.RecordBatch], bits: Broadcast) -> Iterator[pa.RecordBatch]:
    """(passage, place, tid) of batches (place, tid, text): of each stretch of the batch's texts that the maps let through, as bytes,
    the first text by (place, tid) that has it."""
    lengths = np.flatnonzero(np.unpackbits(bits.value[2 * MAP_BYTES :], bitorder="little"))
    by_size = {size: lengths[_window_of(lengths) == size] for size in np.unique(_window_of(lengths)).tolist()}
    for batch in batches if by_size else ():
        order = pc.sort_indices(batch.select(["place", "tid"]), sort_keys=[("place", "ascending"), ("tid", "ascending")], null_placement="at_start")
        batch = batch.take(order)
        if not batch.num_rows:
            continue
        data, starts = text_bytes(batch["text"])
        view, found = memoryview(data), {}
        for rows, places, sizes in _spans(data, starts, bits.value, by_size):
            for row, place, size in zip(rows.tolist(), places.tolist(), sizes.tolist()):
                passage = bytes(view[place : place + size])
                if row < found.get(passage, len(starts)):
                    found[passage] = row
        rows = pa.array(list(found.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), batch["place"].take(rows), batch["tid"].take(rows)], ["passage", "place", "tid"])


def first_places(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """passages(passage), texts(tid, place, text) -> (passage, at), at(place, tid): of each passage, in bytes, that some text has
    verbatim the first text by place and then tid. Rows that no passage equals can be among them, so join by the passage.

    Two maps of bits go to the tasks: of the first bytes of each passage, and of its first and last bytes and its length. What they let
    through in a text is a row with its own bytes, once in a batch of texts: the join by equal bytes decides, and no text moves.
    Empty and null passages are nowhere."""
    wanted = passages.where("passage != ''").select("passage").mapInArrow(_span_bits, "bit long")
    bits = passages.sparkSession.sparkContext.broadcast(bit_array(wanted, "bit"))
    texts = texts.where("text is not null and tid is not null").select("place", "tid", "text")
    kinds = dict(texts.dtypes)
    found = texts.mapInArrow(lambda b: _first_with(b, bits), f"passage binary, place {kinds['place']}, tid {kinds['tid']}")
    return found.groupBy("passage").agg(F.min(F.struct("place", "tid")).alias("at"))


def source_chunks(contexts: DataFrame, chunks: DataFrame) -> DataFrame:
    """contexts(qid, position, context), chunks(chunk_id, place, text) -> (qid, position, chunk_id), a row for each question that
    has a source: the first chunk by place that has the first context by position (white space at its ends aside) as its text
    or in it."""
    rows = contexts.select("qid", "position", F.btrim("context", F.lit(" \t\n\x0b\x0c\r")).alias("passage")).where("passage != ''")
    found = first_places(rows, chunks.select(F.col("chunk_id").alias("tid"), "place", "text"))
    sources = rows.withColumn("passage", F.col("passage").cast("binary")).join(found, "passage")
    return sources.groupBy("qid").agg(F.min("position").alias("position"), F.min_by("at.tid", F.struct("position", "at")).alias("chunk_id"))
