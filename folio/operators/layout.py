"""Words with coordinates as lines in reading order, on pages of one column or two.

A page is one row with its words in an array, as page parsers give it; words that come as a table are dealt by (doc_id, page)
once, and nothing moves after that. Tasks find rows, gutters and cells of many pages at a time, in Arrow batches, by sorting
and running sums over numbers; the texts are put together by Arrow. with_rows() and row_texts() say the same of any keys as
windows, where there are no columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.window import Window

PAGE = ["doc_id", "page"]
#: Fixed values, in points: heights of a row, the gap between cells, the blank strip between columns.
SAME_ROW, CELL_GAP, STRIP = 4.0, 12.0, 8.0
#: Where on the page the strip can be, in shares of its width, and the share of rows that may cross it.
ZONE, CROSSING = (0.35, 0.65), 0.1
#: Words of a line of prose, share of words that aren't, and how many such lines each side needs, also as a share of all rows.
PROSE_WORDS, NOT_PROSE, SIDE_LINES, SIDE_SHARE = 4, 0.2, 8, 0.3
CURRENCY = ("$", "€")
#: Candidates for the strip's middle are this far apart.
STEP = 2
#: A leader of dots, and a word that is nothing else.
LEADER = r"\.{3,}"
NO_TEXT = rf"^({LEADER})?$"
#: Words looked at together, or one page.
AT_ONCE = 100_000


def with_rows(words: DataFrame, keys: list[str], tolerance: float = SAME_ROW) -> DataFrame:
    """Words (…, y0, y1) with `row`, counted from 1 in each group of the keys: a word belongs to the row whose first word's
    centre is within the tolerance. The fold runs over a group's distinct heights and keeps the rows' first ones."""
    centre = (F.col("y0") + F.col("y1")) / 2
    heights = words.groupBy(*keys).agg(F.array_sort(F.collect_set(centre)).alias("heights"))
    start = F.array().cast("array<double>")
    firsts = F.aggregate("heights", start, lambda found, h: F.when((F.size(found) == 0) | (h - F.element_at(found, -1) > tolerance), F.concat(found, F.array(h))).otherwise(found))
    bands = heights.select(*keys, F.posexplode(firsts).alias("n", "first"))
    # A word's row is the last one that begins at its height or above: both in one sorted window, without a range join.
    marks = bands.select(*keys, F.col("first").alias("h"), (F.col("n") + 1).alias("begins"), F.lit(None).cast(words.select(F.struct("*").alias("w")).schema["w"].dataType).alias("w"))
    each = words.select(*keys, centre.alias("h"), F.lit(None).cast("int").alias("begins"), F.struct(*words.columns).alias("w"))
    upto = Window.partitionBy(*keys).orderBy("h", F.col("begins").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(each).withColumn("row", F.last("begins", ignorenulls=True).over(upto)).where("w is not null").select("w.*", "row")


def with_cells(words: DataFrame, keys: list[str], gap: float = CELL_GAP) -> DataFrame:
    """Words with `cell`, counted from 1 in each row of the keys from left to right: a gap wider than `gap` begins one."""
    row = Window.partitionBy(*keys).orderBy("x0", "x1", "word")
    wide = F.coalesce((F.col("x0") - F.lag("x1").over(row) > gap).cast("int"), F.lit(1))
    return words.withColumn("wide", wide).withColumn("cell", F.sum("wide").over(row)).drop("wide")


def row_texts(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells): each row's cells from left to right, without leaders of dots and empty cells; rows of none are left out."""
    in_order = lambda name, *columns: F.array_sort(F.collect_list(F.struct(*columns))).alias(name)
    texts = with_cells(words, keys).groupBy(*keys, "cell").agg(in_order("ws", "x0", "x1", "word"))
    text = F.array_join(F.transform("ws", lambda w: w["word"]), " ")
    texts = texts.select(*keys, "cell", F.trim(F.regexp_replace(text, r"\.{3,}", "")).alias("t")).where("t != ''")
    return texts.groupBy(*keys).agg(in_order("cs", "cell", "t")).select(*keys, F.transform("cs", lambda c: c["t"]).alias("cells"))


def as_pages(words: DataFrame) -> DataFrame:
    """words(doc_id, page, width, x0, y0, x1, y1, word) -> (doc_id, page, width, words), a row for each page."""
    places = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return words.where("page is not null").groupBy(*PAGE).agg(F.max(F.col("width").cast("double")).alias("width"), F.collect_list(F.struct(*places, "word")).alias("words"))


class Pages:
    """The words of some pages as arrays: page (its number here), width of each page, x0, y0, x1, y1, word (Arrow) and rank, the
    word's place in the order of all words; without null words and places and currency signs alone."""

    def __init__(self, width: pa.Array, words: pa.Array):
        flat = words.flatten()
        place = [pc.fill_null(pc.struct_field(flat, c), np.nan).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]
        page = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        word = pc.struct_field(flat, "word")
        kept = pc.and_not(pc.is_valid(word), pc.is_in(word, pa.array(CURRENCY))).to_numpy(zero_copy_only=False) & ~np.isnan(place).any(axis=0)
        self.n, self.page, self.word = len(words), page[kept], word.filter(pa.array(kept)).dictionary_encode()
        self.width = pc.fill_null(width, np.nan).to_numpy(zero_copy_only=False)
        self.x0, self.y0, self.x1, self.y1 = (c[kept] for c in place)
        names, code = self.word.dictionary, self.word.indices.to_numpy()
        rank = np.empty(len(names), np.int64)
        rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        self.rank = rank[code]
        not_word = pc.or_(pc.invert(pc.match_substring_regex(names, r"\p{L}")), pc.match_substring_regex(names, r"\p{N}"))
        self.not_word = not_word.to_numpy(zero_copy_only=False)[code]
        self.has_text = pc.invert(pc.match_substring_regex(names, NO_TEXT)).to_numpy(zero_copy_only=False)[code]
        self.centre = (self.y0 + self.y1) / 2

    def in_order(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words by group and from left to right, and which of them begin a group."""
        order = np.lexsort((self.rank, self.x1, self.x0, group))
        return order, starts(group[order])

    def wide(self, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Which of the words in this order begin a cell."""
        return begins | np.append(True, self.x0[order][1:] - self.x1[order][:-1] > CELL_GAP)[: len(order)]


def starts(codes: np.ndarray) -> np.ndarray:
    """Which of some sorted numbers are the first of their kind."""
    return np.append(True, codes[1:] != codes[:-1])[: len(codes)]


def row_numbers(group: np.ndarray, height: np.ndarray, tolerance: float = SAME_ROW) -> np.ndarray:
    """with_rows() of numbered groups: each word's row. Every group goes from row to row at once, and finds by halving the first
    word that is beyond the row's first one."""
    order = np.lexsort((height, group))
    g, h = group[order], height[order]
    heads = np.flatnonzero(starts(g))
    begins, at, end = np.zeros(len(g), bool), heads, np.append(heads[1:], len(g))[: len(heads)]
    while len(at):
        begins[at] = True
        low, high = at + 1, end
        while (low < high).any():
            open_, mid = low < high, np.minimum((low + high) // 2, len(h) - 1)
            beyond = h[mid] - h[at] > tolerance
            low, high = np.where(open_ & ~beyond, mid + 1, low), np.where(open_ & beyond, mid, high)
        at, end = low[low < end], end[low < end]
    so_far = np.cumsum(begins)
    rows = np.empty(len(g), np.int64)
    rows[order] = so_far - np.repeat(so_far[heads], np.diff(np.append(heads, len(g)))) + 1
    return rows


def running_max(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The greatest of some whole numbers from 0 so far, in each stretch."""
    step = np.cumsum(begins) * (values.max(initial=0) + 1)
    return np.maximum.accumulate(values + step) - step


def sweep(pages: Pages, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, k, n, upto): n rows cross a strip at candidate k of the page, and the same at all candidates before `upto`. A row's
    words that touch are one interval; each adds one where it begins and takes one away behind its end, and the running sum
    of these differences is the sweep over x."""
    low, high = (np.floor(pages.width * z) for z in ZONE)
    last = np.floor((high - low) / STEP)
    p, ends = pages.page, np.nan_to_num(last, nan=-1.0)
    # Candidate low + STEP * k is crossed if it lies between x0 - STRIP / 2 and x1 + STRIP / 2, ends excluded.
    a = np.maximum(np.floor((pages.x0 - STRIP / 2 - low[p]) / STEP) + 1, 0)
    b = np.minimum(np.ceil((pages.x1 + STRIP / 2 - low[p]) / STEP) - 1, last[p])
    span = a <= b
    p, r, a, b = p[span], row[span], a[span].astype(np.int64), b[span].astype(np.int64)
    order = np.lexsort((b, a, r, p))
    p, r, a, b = p[order], r[order], a[order], b[order]
    begins = starts(p) | starts(r)
    reach = np.append(0, running_max(b, begins)[:-1] + 1)[: len(b)]
    a = np.where(begins, a, np.maximum(a, reach))
    p, a, b = p[a <= b], a[a <= b], b[a <= b]
    every = np.flatnonzero(ends >= 0)
    p, k, d = np.concatenate([every, p, p]), np.concatenate([np.zeros(len(every), np.int64), a, b + 1]), np.repeat([0, 1, -1], [len(every), len(p), len(p)])
    inside = k <= ends[p]
    p, k, d = p[inside], k[inside], d[inside]
    order = np.lexsort((k, p))
    p, k, d = p[order], k[order], d[order]
    begins = starts(p)
    so_far = np.cumsum(d)
    n = so_far - np.repeat((so_far - d)[begins], np.diff(np.append(np.flatnonzero(begins), len(p))))
    of_k = np.append((p[1:] != p[:-1]) | (k[1:] != k[:-1]), True)[: len(p)]
    p, k, n = p[of_k], k[of_k], n[of_k]
    upto = np.append(k[1:], 0)[: len(k)]
    upto = np.where(np.append(starts(p)[1:], True)[: len(p)], ends[p].astype(np.int64) + 1, upto)
    return p, k, n, upto


def gutter_of(pages: Pages, row: np.ndarray) -> np.ndarray:
    """The x of each page's blank strip between two columns of prose, else no number. It is the middle one of the candidates
    that the fewest rows cross, few of all rows do, and each side of it has lines of prose of its own: one cell of words, where
    a table has several or numbers."""
    gutter, n_rows = np.full(pages.n, np.nan), np.zeros(pages.n, np.int64)
    np.maximum.at(n_rows, pages.page, row)
    p, k, n, upto = sweep(pages, row)
    fewest = np.full(pages.n, np.iinfo(np.int64).max)
    np.minimum.at(fewest, p, n)
    best = n == fewest[p]
    p, k, size = p[best], k[best], (upto - k)[best]
    total = np.bincount(p, size, pages.n).astype(np.int64)
    seen = np.cumsum(size)
    seen -= np.repeat((seen - size)[starts(p)], np.diff(np.append(np.flatnonzero(starts(p)), len(p))))
    middle = total[p] // 2
    found = (seen > middle) & (seen - size <= middle) & (fewest[p] <= CROSSING * n_rows[p])
    p, at = p[found], (k + middle - (seen - size))[found]
    gutter[p] = np.floor(pages.width[p] * ZONE[0]) + STEP * at
    g = gutter[pages.page]
    side = np.where(pages.x1 <= g, 1, np.where(pages.x0 >= g, 2, 0))
    line = (np.append(0, np.cumsum(n_rows))[pages.page] + row) * 3 + side
    order, begins = pages.in_order(line)
    order, begins = order[side[order] > 0], begins[side[order] > 0]
    cell, of = np.cumsum(pages.wide(order, begins)) - 1, np.cumsum(begins) - 1
    words = np.bincount(of)
    bad = np.bincount(of, pages.not_word[order])
    # A cell of dots alone is none, as in the lines.
    text = np.zeros(cell.max(initial=-1) + 1, np.int64)
    np.maximum.at(text, cell, pages.has_text[order].astype(np.int64))
    cells = np.bincount(of[starts(cell)], text)
    prose = (words >= PROSE_WORDS) & (cells == 1) & (bad / np.maximum(words, 1) < NOT_PROSE)
    first = order[begins]
    fewer = np.minimum(*(np.bincount(pages.page[first], prose & (side[first] == s), pages.n) for s in (1, 2)))
    return np.where((fewer >= SIDE_LINES) & (fewer >= SIDE_SHARE * n_rows), gutter, np.nan)


def lines_of(pages: Pages) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(page, line_no, cells) of every line in reading order."""
    row = row_numbers(pages.page, pages.centre)
    gutter = gutter_of(pages, row)[pages.page]
    n_rows = np.zeros(pages.n, np.int64)
    np.maximum.at(n_rows, pages.page, row)
    # Rows of all pages have numbers of their own, and each page one more before them for what stands above all of them.
    base = np.append(0, np.cumsum(n_rows + 1))
    alone = np.zeros(base[-1], bool)
    alone[base[pages.page] + row] = np.isnan(gutter)
    np.logical_or.at(alone, base[pages.page] + row, (pages.x0 < gutter) & (gutter < pages.x1))
    # The band of a row counts the rows before it that stand alone, and itself if it does; a one-column page has only such.
    number = np.arange(base[-1])
    alone[base[:-1]] = True
    band = np.maximum.accumulate(np.where(alone, number, 0))
    at = base[pages.page] + row
    group = band[at] * 3 + np.where(alone[at], 0, np.where(pages.x1 <= gutter, 1, 2))
    _, group = np.unique(group, return_inverse=True)
    inner = row_numbers(group, pages.centre)
    most = np.zeros(group.max(initial=-1) + 1, np.int64)
    np.maximum.at(most, group, inner)
    line = np.append(0, np.cumsum(most))[group] + inner
    order, begins = pages.in_order(line)
    cell = np.append(np.flatnonzero(pages.wide(order, begins)), len(order))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cell, pa.int32()), pages.word.take(pa.array(order)).cast(pa.string())), " ")
    texts = pc.utf8_trim(pc.replace_substring_regex(texts, LEADER, ""), " ")
    full = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    first = order[cell[:-1][full]]
    heads = np.flatnonzero(starts(line[first]))
    cells = pa.ListArray.from_arrays(pa.array(np.append(heads, len(first)), pa.int32()), texts.filter(pa.array(full)))
    page = pages.page[first][heads]
    firsts = np.flatnonzero(starts(page))
    return page, np.arange(len(page)) - np.repeat(firsts, np.diff(np.append(firsts, len(page)))) + 1, cells


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Pages]]:
    for batch in batches:
        sizes = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy()))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + AT_ONCE, "right")) - 1)
            part = batch.slice(at, end - at)
            yield part, Pages(part["width"], part["words"])
            at = end


def _keys(part: pa.RecordBatch, page: np.ndarray) -> list[pa.Array]:
    return [part[c].take(pa.array(page)) for c in PAGE]


def gutters(words: DataFrame) -> DataFrame:
    """words with places and width -> (doc_id, page, gutter); pages of one column are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in _batches(batches):
            found = gutter_of(pages, row_numbers(pages.page, pages.centre))
            page = np.flatnonzero(~np.isnan(found))
            yield pa.RecordBatch.from_arrays([*_keys(part, page), pa.array(found[page])], [*PAGE, "gutter"])

    pages = as_pages(words)
    return pages.mapInArrow(run, StructType(pages.select(*PAGE).schema.fields).add("gutter", DoubleType()))


def lines_of_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, width, words), words an array of (x0, y0, x1, y1, word) in numbers of type double -> (doc_id, page,
    line_no, line, cells), lines in reading order from 1.

    Words whose centres are at most 4 points below a row's first word are that row; gaps of over 12 points divide it into
    cells. On a page of two columns a row that crosses the gutter ends a band and stands by itself; in a band all rows of
    the left column come before those of the right one, and each column has rows of its own. Currency signs alone and
    leaders of dots are left out. Null words and places are left out; a page without words has no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in _batches(batches):
            page, number, cells = lines_of(pages)
            yield pa.RecordBatch.from_arrays([*_keys(part, page), pa.array(number, pa.int32()), cells], [*PAGE, "line_no", "cells"])

    pages = pages.where("page is not null").select(*PAGE, "width", "words")
    lines = pages.mapInArrow(run, StructType(pages.select(*PAGE).schema.fields).add("line_no", IntegerType()).add("cells", ArrayType(StringType())))
    return lines.select(*PAGE, "line_no", F.array_join("cells", " | ").alias("line"), "cells")


def page_lines(words: DataFrame) -> DataFrame:
    """lines_of_pages() of words(doc_id, page, width, x0, y0, x1, y1, word)."""
    return lines_of_pages(as_pages(words))
