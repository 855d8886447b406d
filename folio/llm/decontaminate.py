"""Benchmark decontamination over suffix arrays of the training text (operator 4).

Each task turns its documents, slice by slice, into a shard: one sequence of word ranks with a separator after each
document. The shard's suffix array is built by sorting packed ranks of 3, 9 and 27 words. All test suffixes are then
binary-searched together; the array range that starts with a test window is every place where the shard has it, and
neighbouring windows on one diagonal join into the longest verbatim matches. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_rows_only
from .words import ALNUM, slices

MATCHES = "array<struct<item_id:string,doc_word:long,item_word:long,n_words:long>>"


def suffix_array(ranks: np.ndarray, words: int) -> np.ndarray:
    """Starts of the suffixes of ranks (0: the end of a document), sorted by their first `words` words or more."""
    depth, order = 1, np.zeros(0, np.int64)
    while depth < words:
        bits = int(ranks.max(initial=1)).bit_length()
        take = 3 if 3 * bits <= 63 else 2
        key = ranks.copy()
        for k in range(1, take):
            key <<= bits
            key[: max(0, len(ranks) - k * depth)] |= ranks[k * depth :]
        order = np.argsort(key)
        steps = np.zeros(len(key), np.int64)
        steps[1:] = key[order[1:]] != key[order[:-1]]
        ranks = np.empty_like(steps)
        ranks[order] = np.cumsum(steps) + 1
        depth *= take
    return order


class Tests:
    """The items' windows of `window` consecutive words; an item of fewer, but not none, is one window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids, self.window = [i for i, _ in items], window
        heads, items_of, places, sizes, words = [], [], [], [], [np.zeros(0, np.uint64)]
        base = 0
        for part in slices(pa.array([t for _, t in items], pa.large_string()), ALNUM):
            words.append(part.word_hashes())
            for i in range(part.n):
                a, b = int(part.first[i]), int(part.first[i + 1])
                size = min(window, b - a)
                for at in range(a, b - size + 1) if size else ():
                    heads.append(base + at)
                    items_of.append(part.lo + i)
                    places.append(at - a)
                    sizes.append(size)
            base += len(words[-1])
        self.words = np.concatenate(words)
        self.head, self.item, self.place, self.size = (np.array(x, np.int64) for x in (heads, items_of, places, sizes))

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, doc_word, item_word, n_words) of the longest matches in a slice: hashes of the words of all its
        texts, text i having those of first[i]:first[i+1]."""
        none = (np.zeros(0, np.int64),) * 5
        if not len(hashes) or not len(self.head):
            return none
        known, ranks = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(known, self.words), len(known) - 1)
        of_test = np.where(known[at] == self.words, at + 2, -1)
        steps = np.arange(self.window)
        pattern = of_test[np.minimum(self.head[:, None] + steps, len(of_test) - 1)]
        inside = steps < self.size[:, None]
        tests = np.flatnonzero((pattern >= 0).all(axis=1, where=inside))
        if not len(tests):
            return none
        # Each text is followed by a separator, the smallest rank.
        n_texts = len(first) - 1
        text_of = np.repeat(np.arange(n_texts), np.diff(first))
        sequence = np.ones(len(hashes) + n_texts, np.int64)
        sequence[np.arange(len(hashes)) + text_of] = ranks.ravel() + 2
        order = suffix_array(sequence, self.window)
        padded = np.concatenate([sequence, np.zeros(self.window, np.int64)])
        pattern, inside = pattern[tests], inside[tests]

        def search(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(tests), np.int64), np.full(len(tests), len(order))
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                there = padded[order[np.minimum(mid, len(order) - 1)][:, None] + steps]
                differs = (there != pattern) & inside
                where = differs.argmax(axis=1)
                rows = np.arange(len(tests))
                less = np.where(differs.any(axis=1), there[rows, where] < pattern[rows, where], after)
                lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            return lo

        start, end = search(False), search(True)
        count = end - start
        which = np.repeat(np.arange(len(tests)), count)
        if not len(which):
            return none
        spots = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)]
        ends = first[1:] + np.arange(n_texts)
        text = np.searchsorted(ends, spots, "right")
        doc_word = spots - np.concatenate([[0], ends[:-1] + 1])[text]
        item, place, size = (x[tests][which] for x in (self.item, self.place, self.size))
        by = np.lexsort((place, doc_word - place, item, text))
        text, item, place, doc_word, size = text[by], item[by], place[by], doc_word[by], size[by]
        new = np.ones(len(by), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (doc_word[1:] - place[1:] != doc_word[:-1] - place[:-1]) | (place[1:] != place[:-1] + 1)
        heads = np.flatnonzero(new)
        run = np.diff(np.append(heads, len(by)))
        return text[heads], item[heads], doc_word[heads], place[heads], run + size[heads] - 1


def _searched(batches: Iterator[pa.RecordBatch], tests: Tests, first_block: bool, last_block: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the matches of this block of tests behind those of the blocks before, and n_hit over all of them."""
    ids = np.array(tests.ids, object)
    for batch in batches:
        for part in slices(batch["text"], ALNUM):
            own = batch.slice(part.lo, part.n)
            text, item, doc_word, item_word, n_words = tests.matches(part.word_hashes(), part.first)
            found = pa.StructArray.from_arrays(
                [pa.array(ids[item].tolist(), pa.string()), pa.array(doc_word), pa.array(item_word), pa.array(n_words)],
                ["item_id", "doc_word", "item_word", "n_words"],
            )
            if not first_block:
                before = own["matches"]
                text = np.concatenate([np.repeat(np.arange(part.n), before.value_lengths().to_numpy()), text])
                order = np.argsort(text, kind="stable")
                text, found = text[order], pa.concat_arrays([before.flatten().cast(found.type), found]).take(pa.array(order))
                doc_word, n_words = (found.field(c).to_numpy(zero_copy_only=False) for c in ("doc_word", "n_words"))
            edges = np.zeros(len(part.starts) + 1, np.int64)
            np.add.at(edges, part.first[text] + doc_word, 1)
            np.add.at(edges, part.first[text] + doc_word + n_words, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
            offsets = np.searchsorted(text, np.arange(part.n + 1)).astype(np.int32)
            out = {
                "doc_id": own["doc_id"], "text": own["text"], "n_words": pa.array(np.diff(part.first)),
                "n_hit": pa.array(hit[part.first[1:]] - hit[part.first[:-1]]), "matches": pa.ListArray.from_arrays(pa.array(offsets), found),
            }
            if last_block:
                del out["text"]
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_chars: int = 8_000_000) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> (doc_id, n_words, n_hit, matches), a row for each row of docs.

    Words are runs of ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. matches are the longest
    verbatim matches of at least `window` words (or of a whole shorter item): (item_id, doc_word, item_word, n_words),
    places counted from 0. n_hit is the number of the document's words inside any of them. Null and empty texts have no
    words; items without words or without item_id match nothing; repeated items and documents are treated alike; empty
    tables give no rows or no matches.

    The benchmark goes to the tasks in blocks of about block_chars characters (it is counted first), one behind the other
    in the same tasks: each adds its matches to the rows that the one before gave, so rows stay rows and nothing is
    shuffled, however many blocks there are. Whole texts are searched; one longer than a slice is a shard of its own.
    Further columns of either table are not read, so their names can't clash.
    """
    docs = read_rows_only(docs, doc_id="doc_id", text="text")
    items = read_rows_only(benchmark, item_id="item_id", text="text").where("item_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("string"), "text").distinct()
    n_blocks = -(-(items.agg(F.sum(F.length("text") + 100)).first()[0] or 1) // block_chars)
    found = docs
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        sent = docs.sparkSession.sparkContext.broadcast(Tests([tuple(r) for r in own.collect()], window))
        ends = block == 0, block == n_blocks - 1
        schema = "doc_id long, " + ("" if ends[1] else "text string, ") + f"n_words long, n_hit long, matches {MATCHES}"
        found = found.mapInArrow(lambda batches, sent=sent, ends=ends: _searched(batches, sent.value, *ends), schema)
    return found


def is_contaminated(share: int = 20) -> Column:
    """At least one word in `share` of a document is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
