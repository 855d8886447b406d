"""Substring deduplication by paragraph MinHash banding (operator 2).

Texts are cut into small paragraphs: at newlines and behind sentence ends, and where these lie close or far apart by the
hashes of the words. So a passage that was pasted into other text has the same paragraphs everywhere but at its edges.
Paragraphs of equal shingle sets are one class. Classes that collide in a band are compared with the smallest of their
bucket, the exact Jaccard similarity is verified, confirmed links make components, and paragraphs whose component spans
several documents are shared.

Verbatim runs need no paragraphs. The smallest 12-word hash of every window of min_passage words is an anchor, so a run of
that length has the same anchors wherever it stands. Around anchors of several documents 8-word hashes are compared, all
of them at the ends, which gives each run to its exact ends. Shared paragraphs and runs that lie close together make the passages.

The texts are read twice. The first reading gives every band key and anchor to one aggregation, which finds the keys that
more than one paragraph or document has. A bit map of fixed size says which these may be. The second reading gives only
rows of such keys: paragraphs with their shingles, and 8-word hashes. Exact joins decide from there, so a full map costs
rows and never changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, read_rows_only, save
from .components import components
from .words import BYTE_CODES, NOT_SPACE, U64, Slice, constants, mix, slices

#: Bands of two rows: at a similarity of 0.75 a pair is missed by all with a probability of 0.4375 ** 5, or 1.6 %; at
#: 0.9 with one of 0.025 %. Equal paragraphs are never missed.
BANDS, ROWS = 5, 2
MULTIPLY, ADD = constants(BANDS * ROWS, 21) | U64(1), constants(BANDS * ROWS, 22)
SIZE, LONG = 5, 32
#: Runs are compared by hashes of GRAM words. Anchors are hashes of ANCHOR words: longer, so that common phrases have none.
GRAM, ANCHOR = 8, 12
#: So many hashes can have more than one row in HOT.
HOT = 10_000
#: Inside a run, of every STEP hashes in a row the smallest is compared; at its ends all are.
STEP = 12
END = np.zeros(256, bool)
END[list(b".!?")] = True


def paragraphs(part: Slice, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, past the last word) of each paragraph of at least min_words words, words counted in the slice."""
    n = len(part.starts)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    newlines = np.concatenate([[0], np.cumsum(part.data == 10)])
    cut = np.zeros(n + 1, bool)
    cut[1:n] = END[part.data[part.ends[:-1] - 1]] | (newlines[part.starts[1:]] > newlines[part.ends[:-1]])
    cut[part.first] = True
    cut[0] = cut[n] = True
    # Sentences that are too short or very long are joined or cut where the words themselves say so, which is again the
    # same wherever the passage stands.
    hashes, edges = part.word_hashes(BYTE_CODES), np.flatnonzero(cut)
    sizes = np.diff(edges)
    inner = edges[1:-1]
    joined = (sizes[:-1] < min_words) & (sizes[1:] < min_words) & (hashes[inner - 1] % U64(4) != 0)
    cut[inner[joined]] = False
    in_long = np.repeat(sizes > LONG, sizes)
    cut[:n] |= in_long & (hashes % U64(16) == 0)
    cut[part.first] = True
    edges = np.flatnonzero(cut)
    a, b = edges[:-1], edges[1:]
    long_ = b - a >= max(min_words, SIZE)
    a, b = a[long_], b[long_]
    return np.searchsorted(part.first, a, "right") - 1, a, b


def _shingles(part: Slice) -> np.ndarray:
    words, factors = part.word_hashes(BYTE_CODES), constants(SIZE, 3) | U64(1)
    out = np.zeros(max(0, len(words) - SIZE + 1), U64)
    for k in range(SIZE):
        out += words[k : k + len(out)] * factors[k]
    return mix(out)


def _flat(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all shingles of the paragraphs a:b one after the other, and where each paragraph's begin."""
    sizes = b - a - SIZE + 1
    heads = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(heads - a, sizes), heads


def _classes(part: Slice, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of each paragraph's 128-bit class, and its distinct shingles, sorted, with where each one's begin.
    A class is made of two sums over the distinct shingles."""
    at, heads = _flat(a, b)
    shingles = _shingles(part)[at]
    owner = np.repeat(np.arange(len(a)), b - a - SIZE + 1)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[new], owner[new]
    heads = np.searchsorted(owner, np.arange(len(a)))
    high = mix(np.add.reduceat(mix(shingles + U64(1)), heads))
    low = mix(np.add.reduceat(mix(shingles ^ MULTIPLY[0]), heads))
    return high, low, shingles, heads


def _band_keys(shingles: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """BANDS rows of a key for each paragraph."""
    keys = np.empty((BANDS, len(heads)), U64)
    for band in range(BANDS):
        lowest = [np.minimum.reduceat(shingles * MULTIPLY[i] + ADD[i], heads) for i in range(band * ROWS, band * ROWS + ROWS)]
        keys[band] = mix(lowest[0] + mix(lowest[1] + U64(band)))
    return keys


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of `size` words from each word on."""
    factors = constants(size, 6) | U64(1)
    grams = np.zeros(max(0, len(words) - size + 1), U64)
    for k in range(size):
        grams += words[k : k + len(grams)] * factors[k]
    return mix(grams)


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The smallest (or largest) of each `width` values in a row."""
    have = 1
    while have < width and len(values):
        step = min(have, width - have)
        values, have = best(values[: max(0, len(values) - step)], values[step:]), have + step
    return values


def _anchor_size(min_passage: int) -> int:
    return min(ANCHOR, max(GRAM, min_passage))


def _compared(grams: np.ndarray, inside: np.ndarray, margin: int) -> np.ndarray:
    """Places of the hashes to compare, of those inside: all within `margin` of an end of their stretch, and the smallest of
    every STEP in a row, which are the same wherever the words stand."""
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    wanted = np.zeros(len(grams) + 1, np.int32)
    for a, b in ((edges[::2], np.minimum(edges[::2] + margin, edges[1::2])), (np.maximum(edges[1::2] - margin, edges[::2]), edges[1::2])):
        np.add.at(wanted, a, 1)
        np.add.at(wanted, b, -1)
    chosen = np.cumsum(wanted)[:-1] > 0
    if len(grams) >= STEP:
        lowest = _slide(grams, STEP, np.minimum)
        ends = np.concatenate([np.zeros(STEP - 1, U64), lowest, np.zeros(STEP - 1, U64)])
        chosen |= grams == _slide(ends, STEP, np.maximum)
    return np.flatnonzero(chosen & inside)


def _anchors(part: Slice, words: np.ndarray, min_passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of min_passage words inside one text: its first word, its text and the smallest hash of its ANCHOR (or,
    in shorter windows, GRAM) consecutive words."""
    size = _anchor_size(min_passage)
    lowest = _slide(_grams(words, size), min_passage - size + 1, np.minimum)
    sizes = np.maximum(np.diff(part.first) - min_passage + 1, 0)
    text = np.repeat(np.arange(part.n), sizes)
    at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + part.first[text]
    return at, text, mix(lowest[at])


def _key_rows(batches: Iterator[pa.RecordBatch], min_words: int, min_passage: int) -> Iterator[pa.RecordBatch]:
    """(k, x): each anchor with its document, and each band key with a hash of its paragraph's class and document."""
    for batch in batches:
        docs = batch["doc_id"].to_numpy()
        for part in slices(batch["text"], NOT_SPACE):
            own = docs[part.lo : part.lo + part.n]
            _, text, lowest = _anchors(part, part.word_hashes(BYTE_CODES), min_passage)
            new = np.ones(len(text), bool)
            new[1:] = (lowest[1:] != lowest[:-1]) | (text[1:] != text[:-1])
            k, x = [lowest[new]], [own[text[new]].view(U64)]
            text, a, b = paragraphs(part, min_words)
            if len(a):
                high, low, shingles, heads = _classes(part, a, b)
                k.append(_band_keys(shingles, heads).ravel())
                x.append(np.tile(mix(high + mix(low + mix(own[text].view(U64)))), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (k, x)], ["k", "x"])


FOUND = "h long, high long, low long, doc_id long, start_word long, n_words long, keys array<long>, shingles binary"


def _found_rows(batches: Iterator[pa.RecordBatch], min_words: int, min_passage: int, bits: np.ndarray, map_bits: int) -> Iterator[pa.RecordBatch]:
    """What the map holds, in rows of FOUND: 8-word hashes inside windows with such an anchor (h, doc_id, start_word), and paragraphs with such a band key, with those keys and their shingles."""

    def may_be_shared(keys: np.ndarray) -> np.ndarray:
        place = keys >> U64(64 - map_bits)
        return (bits[place >> U64(6)] >> (place & U64(63))) & U64(1) == 1

    names = [x.split(" ")[0] for x in FOUND.split(", ")]
    for batch in batches:
        docs = batch["doc_id"].to_numpy()
        for part in slices(batch["text"], NOT_SPACE):
            own = docs[part.lo : part.lo + part.n]
            words = part.word_hashes(BYTE_CODES)
            grams = _grams(words, GRAM)
            at, _, lowest = _anchors(part, words, min_passage)
            at = at[may_be_shared(lowest)]
            near = np.zeros(len(grams) + 1, np.int32)
            near[at] += 1
            near[at + min_passage - GRAM + 1] -= 1
            at = _compared(grams, np.cumsum(near)[:-1] > 0, min_passage - _anchor_size(min_passage) + 1)
            if len(at):
                text, n = np.searchsorted(part.first, at, "right") - 1, len(at)
                none = [pa.nulls(n, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), *none, pa.array(own[text]), pa.array(at - part.first[text]), none[0], pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names
                )
            text, a, b = paragraphs(part, min_words)
            if not len(a):
                continue
            high, low, shingles, heads = _classes(part, a, b)
            keys = _band_keys(shingles, heads).T
            hit = may_be_shared(keys)
            wanted = np.flatnonzero(hit.any(axis=1))
            if not len(wanted):
                continue
            key_ends = np.concatenate([[0], np.cumsum(hit[wanted].sum(axis=1))]).astype(np.int32)
            ends = pa.array(np.append(heads, len(shingles)).astype(np.int32) * 8)
            sets = pa.Array.from_buffers(pa.binary(), len(a), [None, ends.buffers()[1], pa.py_buffer(shingles.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(wanted), pa.int64()), *[pa.array(x[wanted].view(np.int64)) for x in (high, low)], pa.array(own[text[wanted]]),
                 pa.array((a - part.first[text])[wanted]), pa.array((b - a)[wanted]), pa.ListArray.from_arrays(pa.array(key_ends), pa.array(keys[hit].view(np.int64))), sets.take(pa.array(wanted))], names,
            )


def _bit_map(keys: DataFrame, map_bits: int) -> np.ndarray:
    """A bit for each value of the first map_bits bits of keys(k); at most 2 ** (map_bits - 6) rows come to the driver."""
    place = F.shiftrightunsigned("k", 64 - map_bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(k, {64 - map_bits}) & 63 as int))")
    found = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (map_bits - 6), U64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return out


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of doc_id -> tables of whole documents; a document's rows may be in several batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch["doc_id"][-1].as_py()
        if last != (held[0] if held else batch)["doc_id"][0].as_py():
            done = int(np.searchsorted(batch["doc_id"].to_numpy(), last))
            yield pa.Table.from_batches([*held, batch.slice(0, done)])
            held, batch = [], batch.slice(done)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _runs(rows: pa.Table, min_passage: int) -> pa.RecordBatch:
    """Shared hashes -> runs of hashes at most STEP words apart that span min_passage words, cut where first_doc changes."""
    doc, start, first_doc = (rows[c].to_numpy() for c in ("doc_id", "start_word", "first_doc"))
    order = np.lexsort((first_doc, start, doc))
    doc, start, first_doc = doc[order], start[order], first_doc[order]
    once = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1]))
    doc, start, first_doc = doc[once], start[once], first_doc[once]
    apart = np.append(True, (doc[1:] != doc[:-1]) | (np.diff(start) > STEP))
    heads = np.flatnonzero(apart)
    ends = start[np.append(heads[1:], len(doc)) - 1] + GRAM
    run = np.cumsum(apart) - 1
    heads = np.flatnonzero(apart | np.append(True, first_doc[1:] != first_doc[:-1]))
    # A part of a run goes on to the next part's beginning, or to the run's end.
    last, follows = np.append(heads[1:], len(doc)) - 1, np.append(run[heads[1:]] == run[heads[:-1]], False)
    until = np.where(follows, np.maximum(start[last] + GRAM, start[np.minimum(last + 1, len(doc) - 1)]), start[last] + GRAM)
    whole = (ends - start[apart])[run[heads]] >= min_passage
    columns = (doc[heads], start[heads], until - start[heads], first_doc[heads])
    return pa.RecordBatch.from_arrays([pa.array(x[whole]) for x in columns], ["doc_id", "start_word", "n_words", "first_doc"])


def verbatim_runs(grams: DataFrame, min_passage: int) -> DataFrame:
    """grams(h, doc_id, start_word) -> (doc_id, start_word, n_words, first_doc): runs that other documents have too, to their
    exact ends where unshared words follow; parts of a run with a different smallest document are rows of their own and
    may overlap. Inside a run, a few words that no other document has may be passed over."""
    spread = grams.groupBy("h").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n")).where("first_doc != last_doc")
    spread = save(spread.select("h", "first_doc", "n"), "spread")
    # At most HOT hashes have more than that share of all rows: few enough to be broadcast, so their rows stay where they are.
    bar = grams.count() // HOT
    hot, cold = F.broadcast(spread.where(F.col("n") > bar).select("h", "first_doc")), spread.where(F.col("n") <= bar).select("h", "first_doc")
    rows = grams.join(hot, "h").select("doc_id", "start_word", "first_doc")
    rows = rows.union(grams.join(hot, "h", "left_anti").join(cold, "h").select("doc_id", "start_word", "first_doc"))
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id")
    schema = "doc_id long, start_word long, n_words long, first_doc long"
    out = save(rows.mapInArrow(lambda batches: (_runs(x, min_passage) for x in _by_document(batches)), schema), "runs")
    forget(spread)
    return out


def _spans(rows: pa.Table, min_passage: int, max_gap: int) -> pa.RecordBatch:
    """The shared paragraphs and runs of whole documents -> passages. Each document's words lie one after the other in
    one array, the documents more than max_gap apart."""
    doc, start, size, first_doc = (rows[c].to_numpy() for c in ("doc_id", "start_word", "n_words", "first_doc"))
    is_run = rows["is_run"].to_numpy() == 1
    docs, of = np.unique(doc, return_inverse=True)
    room = np.full(len(docs), max_gap + 1)
    np.maximum.at(room, of, start + size + max_gap + 1)
    base = np.cumsum(room) - room
    at, total, own = start + base[of], int(room.sum()), first_doc == doc
    # A word of a shared paragraph is judged with it; another stays if this document is the first of any run there.
    state = np.zeros(total, np.int8)
    for rank, value in ((is_run & ~own, 1), (is_run & own, 2), (~is_run & ~own, 1), (~is_run & own, 2)):
        change = np.bincount(at[rank], minlength=total) - np.bincount((at + size)[rank], minlength=total)
        state[np.cumsum(change) > 0] = value
    first = np.full(total, np.iinfo(np.int64).max)
    words = np.repeat(at, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    np.minimum.at(first, words, np.repeat(first_doc, size))
    edges = np.flatnonzero(np.diff(state, prepend=0))
    a = edges[state[edges] > 0]
    b = edges[np.searchsorted(edges, a, "right")]
    heads = np.flatnonzero(np.append(True, (a[1:] - b[:-1] > max_gap) | (state[a[1:]] != state[a[:-1]])))
    lows = np.minimum.reduceat(np.minimum.reduceat(first, np.stack([a, b], 1).ravel())[::2], heads)
    a, b = a[heads], b[np.append(heads[1:], len(b)) - 1]
    of, removed, starts = np.searchsorted(base, a, "right") - 1, state[a] == 1, np.sort(at[~is_run])
    columns = (docs[of], a - base[of], b - a, np.searchsorted(starts, b) - np.searchsorted(starts, a), np.where(removed, lows, docs[of]), removed)
    return pa.RecordBatch.from_arrays([pa.array(x[b - a >= min_passage]) for x in columns], SPAN)


SPAN = ["doc_id", "start_word", "n_words", "n_paragraphs", "first_doc", "removed"]


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch["set_a"].to_pylist(), batch["set_b"].to_pylist()
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(a[i], np.uint64), np.frombuffer(b[i], np.uint64)
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], ["a", "b"])


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order (cluster, i, j, is_row): a block of members comes first and is kept, then each further row is
    compared with it. Of its links with the members of one component, one is enough."""
    block, units, comps, owner, flat, sizes = None, [], [], None, [], None
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in ("cluster", "i", "j")), strict=True))
        is_row, unit, comp, data = (batch[c].to_pylist() for c in ("is_row", "unit", "comp", "shingles"))
        links = []
        for k, key in enumerate(keys):
            if key != block:
                block, units, comps, owner, flat = key, [], [], None, []
            own = np.frombuffer(data[k], np.uint64)
            if not is_row[k]:
                units.append(unit[k])
                comps.append(comp[k])
                flat.append(own)
                continue
            if not units:
                continue
            if owner is None:
                sizes = np.array([len(x) for x in flat])
                owner, all_shingles, comp_of = np.repeat(np.arange(len(flat)), sizes), np.concatenate(flat), np.array(comps)
            hit = own[np.minimum(np.searchsorted(own, all_shingles), len(own) - 1)] == all_shingles
            common = np.bincount(owner, hit, len(sizes))
            linked = np.flatnonzero((100 * common >= percent * (len(own) + sizes - common)) & (comp_of != comp[k]))
            for m in linked[np.unique(comp_of[linked], return_index=True)[1]]:
                links.append((unit[k], units[m]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def across_components(members: DataFrame, sets: DataFrame, joined: DataFrame, percent: int, block_rows: int = 128) -> DataFrame:
    """members(k, unit) of buckets, sets(unit, shingles), joined(node, component): further confirmed links (a, b) between
    components that share a bucket. In each bucket with several components the members outside the largest one are
    compared with all, in blocks dealt over the tasks; blocks give back links, never pairs that were only compared."""
    labelled = members.join(joined, members.unit == joined.node, "left").select("k", "unit", F.coalesce("component", "unit").alias("comp"))
    parts = labelled.groupBy("k", "comp").agg(F.count("*").alias("rows"))
    largest = F.max_by("comp", F.struct("rows", -F.col("comp").cast("decimal(20,0)"))).alias("cluster")
    open_buckets = parts.groupBy("k").agg(F.sum("rows").alias("size"), F.max("rows").alias("most"), largest).where("size > most")
    held = save(labelled.join(open_buckets.select("k", "cluster"), "k").select("cluster", "unit", "comp").distinct(), "clusters")
    minor = F.col("comp") != F.col("cluster")
    sizes = held.groupBy("cluster").agg(F.ceil(F.count("*") / block_rows).alias("n_j"), F.ceil(F.count_if(minor) / block_rows).alias("n_i"))
    data, part = held.join(sets, "unit").join(sizes, "cluster"), F.xxhash64("unit")
    blocks = data.select("*", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)).alias("i"), F.pmod(part, "n_j").alias("j"), F.lit(0).alias("is_row"))
    rows = data.where(minor).select("*", F.pmod(part, "n_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)).alias("j"), F.lit(1).alias("is_row"))
    order = ["cluster", "i", "j", "is_row"]
    dealt = blocks.unionByName(rows).repartition("cluster", "i", "j").sortWithinPartitions(*order).select(*order, "unit", "comp", "shingles")
    out = save(dealt.mapInArrow(lambda batches: _across(batches, percent), "a long, b long"), "links")
    forget(held)
    return out


def repeated_passages(docs: DataFrame, percent: int = 75, min_words: int = 8, min_passage: int = 24, max_gap: int = 12, map_bits: int = 28) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, start_word, n_words, n_paragraphs, first_doc, removed), a row for each passage.

    A passage is made of paragraphs and verbatim runs that other documents have too, with at most max_gap words between,
    and has at least min_passage words. Any min_passage consecutive words that another document has are found, wherever
    sentences begin and end; white space and A-Z or a-z don't count. Paragraphs of min_words words or more are the same
    when 100 * |A & B| >= percent * |A | B| over their 5-word shingles, or linked through such. Each word is judged by
    the smallest doc_id that shares its paragraph or, outside of shared paragraphs, its 8-word runs: removed words are
    those that another document keeps, and a passage is all removed or all kept, so that one copy of everything stays.
    n_paragraphs counts the shared paragraphs that begin in it; first_doc is the smallest doc_id that shares some of it.
    Null and empty texts, rows without doc_id and empty tables have no passages; rows that repeat a
    doc_id count as one document. Whole texts are read, in slices; a text longer than a slice is one of its own. Other
    columns of docs are not read, so their names can't clash.

    map_bits: the map of keys has 2 ** map_bits bits, whatever the input. The more of them are set, the more rows that no
    other document shares pass to the joins, which leave them out; about 8 bits a shared key keep these few.
    """
    docs = read_rows_only(docs, doc_id="doc_id", text="text").where("doc_id is not null")
    keys = docs.mapInArrow(lambda batches: _key_rows(batches, min_words, min_passage), "k long, x long")
    keys = save(keys.groupBy("k").agg(F.min("x").alias("least"), F.max("x").alias("most")).where("least != most").select("k"), "shared-keys")
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(keys, map_bits))
    forget(keys)
    found = save(docs.mapInArrow(lambda batches: _found_rows(batches, min_words, min_passage, sent.value, map_bits), FOUND), "found")
    runs = verbatim_runs(found.where("h is not null").select("h", "doc_id", "start_word"), min_passage)
    places = found.where("h is null")
    classes = places.groupBy("high", "low").agg(
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.first("keys").alias("keys"), F.first("shingles").alias("shingles")
    )
    classes = save(classes.withColumn("unit", F.monotonically_increasing_id()), "classes")
    each = classes.select("unit", F.explode("keys").alias("k"))
    buckets = each.groupBy("k").agg(F.min("unit").alias("hub"), F.max("unit").alias("other")).where("hub != other").drop("other")
    members = save(each.join(buckets, "k"), "buckets")
    pairs = members.where("unit != hub").select("hub", "unit").distinct()
    sets = classes.select("unit", "shingles")
    set_a, set_b = sets.select(F.col("unit").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("unit").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.select(F.col("hub").alias("a"), F.col("unit").alias("b")).join(set_b, "b").join(set_a, "a")
    near = save(both.select("a", "b", "set_a", "set_b").mapInArrow(lambda batches: _similar(batches, percent), "a long, b long"), "links")
    first = components(near)
    across = across_components(members.select("k", "unit"), sets, first, percent)
    joined = components(near.union(across))
    spread = classes.join(joined, classes.unit == joined.node, "left").select("high", "low", "first_doc", "last_doc", F.coalesce("component", "unit").alias("component"))
    shared = spread.groupBy("component").agg(F.min("first_doc").alias("first"), F.max("last_doc").alias("last")).where("first != last").select("component", "first")
    firsts = save(spread.join(shared, "component").select("high", "low", F.col("first").alias("first_doc")), "shared")
    own = places.select("high", "low", "doc_id", "start_word", "n_words").join(firsts, ["high", "low"])
    own = own.select("doc_id", "start_word", "n_words", "first_doc", F.lit(0).alias("is_run")).distinct()
    rows = own.unionByName(runs.withColumn("is_run", F.lit(1))).repartition("doc_id").sortWithinPartitions("doc_id")
    schema = "doc_id long, start_word long, n_words long, n_paragraphs long, first_doc long, removed boolean"
    out = save(rows.mapInArrow(lambda batches: (_spans(x, min_passage, max_gap) for x in _by_document(batches)), schema), "passages")
    forget(found, runs, classes, members, near, first, across, joined, firsts)
    return out
