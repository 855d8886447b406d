"""Near duplicates by MinHash signatures and a multi-index Hamming join (operator 3).

A document's signature has CHUNKS * 4 symbols of 16 bits, each the b-bit MinHash of its shingle set. A chunk of four
symbols is one long. By the pigeonhole principle two signatures that differ in fewer than 2 * CHUNKS symbols have a
chunk with at most one differing symbol, so the four one-symbol errors of every chunk are enumerated (the symbol is
masked out), and every pair under that distance meets in a bucket of an equal masked chunk. Two sets of similarity
0.75 miss all ten chunks with a probability of 1.5e-6, however the rest of their signatures differs.

Buckets can hold any number of documents, so pairs within one are never listed:
1. exact copies (equal shingle sets) are one class, shown by its smallest doc_id;
2. in every bucket the members are compared with one hub. Candidates go through the size ratio and the signature
   distance, then the full shingle sets are compared, and confirmed links are joined into components;
3. only pairs across components are still of interest. In buckets with several components the members outside the
   largest one are compared with all members of a size near enough, in blocks dealt over the tasks, and a block gives
   back confirmed links only: of each member's links with a component, one.
Every pair that shares a bucket is thus compared, already in one component, or of sizes that no link can have: the
bucket's size changes nothing. A link is lost only where two documents share no bucket, or differ in more symbols than
five standard deviations allow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, read_rows_only, save
from .components import components
from .words import U64, constants, mix, shingle_sets

CHUNKS, SYMBOLS, BITS = 10, 4, 16
MULTIPLY, ADD = constants(CHUNKS * SYMBOLS, 11) | U64(1), constants(CHUNKS * SYMBOLS, 12)


def signature(found: np.ndarray) -> np.ndarray:
    """CHUNKS longs of SYMBOLS b-bit MinHashes each."""
    lowest = np.full(len(MULTIPLY), ~U64(0))
    for at in range(0, len(found), 1 << 12):
        part = found[None, at : at + (1 << 12)] * MULTIPLY[:, None] + ADD[:, None]
        np.minimum(lowest, part.min(axis=1), out=lowest)
    symbols = (mix(lowest) >> U64(64 - BITS)).reshape(CHUNKS, SYMBOLS)
    return np.bitwise_or.reduce(symbols << (np.arange(SYMBOLS, dtype=U64) * U64(BITS)), axis=1).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        n, hi, lo = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        signs = np.zeros((rows, CHUNKS), np.int64)
        for i, found in enumerate(shingle_sets(batch["text"])):
            n[i] = len(found)
            if len(found):
                digest = xxhash.xxh3_128_digest(found.tobytes())
                hi[i], lo[i] = np.frombuffer(digest, np.int64)
                signs[i] = signature(found)
        offsets = np.arange(0, (rows + 1) * CHUNKS, CHUNKS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n), pa.array(hi), pa.array(lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signs.ravel()))],
            ["doc_id", "n_shingles", "set_hi", "set_lo", "sig"],
        )


def masked_chunks(sig: Column) -> Column:
    """One key for each chunk and each symbol left out of it."""
    masks = [((1 << 64) - 1) ^ (((1 << BITS) - 1) << (BITS * p)) for p in range(SYMBOLS)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.xxhash64(F.lit(c * SYMBOLS + p), sig[c].bitwiseAND(F.lit(masks[p]))) for c in range(CHUNKS) for p in range(SYMBOLS)])


def distance(a: str, b: str) -> Column:
    """The number of differing symbols of two signatures, given as columns <a>0, <a>1, ... of a chunk each."""
    lanes = [F.lit(m - (1 << 64) if m >> 63 else m) for m in (((1 << BITS) - 1) << (BITS * p) for p in range(SYMBOLS))]
    differs = [F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}")).bitwiseAND(m) != 0 for c in range(CHUNKS) for m in lanes]
    return sum((x.cast("int") for x in differs[1:]), differs[0].cast("int"))


def _compared(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order (hub, block, doc): a block's first rows, with a null doc, have the hub's text (or its texts, where
    rows share the hub's doc_id)."""
    hub_sets: list[np.ndarray] = []
    block = None
    for batch in batches:
        hubs, blocks, docs = (batch[c].to_pylist() for c in ("hub", "block", "doc"))
        links = []
        for i, found in enumerate(shingle_sets(batch["text"])):
            if docs[i] is None:
                hub_sets = [*hub_sets, found] if block == (hubs[i], blocks[i]) else [found]
                block = (hubs[i], blocks[i])
                continue
            assert block == (hubs[i], blocks[i]), "a block without its hub"
            for hub_set in hub_sets:
                both = np.sort(np.concatenate([hub_set, found]))
                common = int((both[1:] == both[:-1]).sum())
                if common and 100 * common >= percent * (len(both) - common):
                    links.append((hubs[i], docs[i]))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, block_rows: int = 64, salts: int = 16) -> DataFrame:
    """Those of pairs(hub, doc) whose full shingle sets are similar enough, as (a, b). A hub's documents are dealt into
    blocks of about block_rows, each with its own copy of the hub's text, so no hub fills a task. Only hubs of more than
    one block have a row of sizes, once a salt, and a hub's pairs meet it in as many tasks as there are salts."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / block_rows).alias("n_blocks"))
    large = sizes.where("n_blocks > 1").select("hub", "n_blocks", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(salts)).cast("int"))
    dealt = salted.join(large, ["hub", "salt"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("n_blocks")), F.lit(0)))
    docs = dealt.join(texts, dealt.doc == texts.doc_id).select("hub", "block", "doc", "text")
    hubs = (
        sizes.join(texts, sizes.hub == texts.doc_id)
        .select("hub", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("doc"), "text")
    )
    return (
        docs.union(hubs).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("doc").asc_nulls_first())
        .mapInArrow(lambda batches: _compared(batches, percent), "a long, b long")
    )


def _across(batches: Iterator[pa.RecordBatch], percent: int, furthest: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order (cluster, at, i, j, is_row): a block of members comes first and is kept, then each row of `rows` is
    compared with it. Of the members of one component that a row is linked with, one link is enough."""
    block, members = None, {}
    for batch in batches:
        keys = list(zip(*(batch[c].to_pylist() for c in ("cluster", "at", "i", "j")), strict=True))
        is_row, reps, comps, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("is_row", "rep", "comp", "n"))
        sigs = np.stack([batch[f"s{c}"].to_numpy() for c in range(CHUNKS)], axis=1)
        links: list[tuple[int, int]] = []
        for k, found in enumerate(shingle_sets(batch["text"])):
            if keys[k] != block:
                block, members = keys[k], {"rep": [], "comp": [], "n": [], "sig": [], "set": []}
            if not is_row[k]:
                for name, value in (("rep", reps[k]), ("comp", comps[k]), ("n", n[k]), ("sig", sigs[k]), ("set", found)):
                    members[name].append(value)
                continue
            if isinstance(members["rep"], list):
                members = {name: np.array(x) if name != "set" else x for name, x in members.items()}
            if not len(members["rep"]):
                continue
            apart = (members["sig"].view(np.uint16).reshape(len(members["rep"]), -1) != sigs[k].view(np.uint16)).sum(axis=1)
            sized = 100 * np.minimum(members["n"], n[k]) >= percent * np.maximum(members["n"], n[k])
            linked = set()
            for m in np.flatnonzero((members["comp"] != comps[k]) & (apart <= furthest) & sized):
                if members["comp"][m] not in linked:
                    own = members["set"][m]
                    if not len(own):
                        continue
                    at = np.minimum(np.searchsorted(own, found), len(own) - 1)
                    common = int((own[at] == found).sum())
                    if 100 * common >= percent * (len(own) + len(found) - common):
                        linked.add(members["comp"][m])
                        links.append((int(reps[k]), int(members["rep"][m])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def same_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of a doc_id that rows of different sets share; there are hardly any."""
    repeated = filled.groupBy("doc_id").agg(F.min("set_hi").alias("least"), F.max("set_hi").alias("most")).where("least != most")
    own = filled.join(repeated.select("doc_id"), "doc_id").join(classes, ["set_hi", "set_lo"]).select("doc_id", "rep")
    return own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a != rep").select("a", F.col("rep").alias("b"))


def across_components(held: DataFrame, texts: DataFrame, signs: DataFrame, percent: int, furthest: int, block_rows: int) -> DataFrame:
    """held(cluster, rep, comp, n): confirmed links (a, b) between components that share a cluster.

    Sizes make bands as wide as the similarity allows, so a row meets only members of its own band and the two beside it:
    of any others the smaller set can't be similar enough to the larger."""
    width = math.log(100 / percent) * (1 + 1e-6) if percent < 100 else 1e-9
    held = held.withColumn("band", F.floor(F.log("n") / width))
    members = held.select("cluster", F.col("band").alias("at"), "rep", "comp", "n")
    rows = held.where("comp != cluster").select("cluster", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("at"), "rep", "comp", "n")
    sizes = members.groupBy("cluster", "at").agg(F.ceil(F.count("*") / block_rows).alias("n_j"))
    sizes = sizes.join(rows.groupBy("cluster", "at").agg(F.ceil(F.count("*") / block_rows).alias("n_i")), ["cluster", "at"])

    def whole(side: DataFrame) -> DataFrame:
        own = side.join(sizes, ["cluster", "at"]).join(texts, side.rep == texts.doc_id).drop("doc_id")
        return own.join(signs, "rep").withColumn("part", F.xxhash64("rep"))

    members = whole(members).select("*", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)).alias("i"), F.pmod("part", "n_j").alias("j"), F.lit(0).alias("is_row"))
    rows = whole(rows).select("*", F.pmod("part", "n_i").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)).alias("j"), F.lit(1).alias("is_row"))
    order = ["cluster", "at", "i", "j", "is_row"]
    dealt = members.unionByName(rows).repartition("cluster", "at", "i", "j").sortWithinPartitions(*order)
    dealt = dealt.select(*order, "rep", "comp", "n", *signs.columns[1:], "text")
    return save(dealt.mapInArrow(lambda batches: _across(batches, percent, furthest), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, percent: int = 75, block_rows: int = 128) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's set is that of its 5-word
    shingles. Documents are linked when 100 * |A & B| >= percent * |A | B|. component_id is the smallest doc_id that
    links reach, kept marks the document that has it. Null, empty and blank texts have no shingles and no links: they
    are kept, as themselves. Repeated rows get the same result each; rows that share a doc_id but not the text are one
    document, with the links of each of its texts. A row without doc_id is linked with nothing and kept, its
    component_id null. An empty table gives no rows. Whole texts are read, however long. Other columns of docs are not
    read, so their names can't clash.

    block_rows: about so many documents a block of comparisons across components; it decides no link.
    """
    docs = read_rows_only(docs, doc_id="doc_id", text="text")
    shapes = save(docs.mapInArrow(_fingerprints, "doc_id long, n_shingles long, set_hi long, set_lo long, sig array<long>"), "fingerprints")
    filled = shapes.where("n_shingles > 0 and doc_id is not null")
    classes = save(
        filled.groupBy("set_hi", "set_lo").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(F.col("sig")[c]).alias(f"s{c}") for c in range(CHUNKS)]
        ),
        "classes",
    )
    keys = classes.select("rep", "n", F.explode(masked_chunks(F.array(*[f"s{c}" for c in range(CHUNKS)]))).alias("k"))
    buckets = keys.groupBy("k").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1")
    members = save(keys.join(buckets, "k").select("k", "rep", "n", "hub"), "buckets")
    shown = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = save(docs.join(shown, "doc_id", "left_semi").distinct(), "candidates")

    signs = classes.select("rep", *[f"s{c}" for c in range(CHUNKS)])
    symbols = CHUNKS * SYMBOLS
    furthest = round(symbols * (100 - percent) / 100 + 5 * (symbols * percent * (100 - percent)) ** 0.5 / 100)
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    near = distance("s_a", "s_b") <= furthest

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"s_{name}{c[1:]}" if c in signs.columns[1:] else f"{c}_{name}") for c in df.columns])

    def compare(pairs: DataFrame) -> DataFrame:
        """pairs(hub, doc) of equal enough sizes -> those confirmed."""
        close = pairs.join(side(signs, "b"), F.col("doc") == F.col("rep_b")).join(side(signs, "a"), F.col("hub") == F.col("rep_a"))
        close = save(close.where(near).select("hub", "doc").distinct(), "pairs")
        found = save(confirmed(close, texts, percent), "links")
        forget(close)
        return found

    hubs = members.select("k", "hub", F.col("n").alias("hub_n")).where("rep = hub")
    first = members.where("rep != hub").drop("hub").join(hubs, "k").where(f"least(n, hub_n) * 100 >= greatest(n, hub_n) * {percent}")
    links = compare(first.select("hub", F.col("rep").alias("doc")).distinct()).union(same_id(filled, classes))
    joined = components(links)
    rest = members.where("rep != hub").select("k", "rep", "n")
    labelled = rest.join(joined, rest.rep == joined.node, "left").select("k", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    # The rows of buckets with several components. The buckets with one largest component (of equal ones, the smallest)
    # make one cluster: a document comes once a cluster, not once a bucket.
    parts = labelled.groupBy("k", "comp").agg(F.count("*").alias("rows"))
    largest = F.max_by("comp", F.struct("rows", -F.col("comp"))).alias("cluster")
    several = parts.groupBy("k").agg(F.sum("rows").alias("size"), F.max("rows").alias("most"), largest).where("size > most")
    held = save(labelled.join(several.select("k", "cluster"), "k").select("cluster", "rep", "comp", "n").distinct(), "clusters")
    if not held.isEmpty():
        last = across_components(held, texts, signs, percent, furthest, block_rows)
        before, joined = joined, components(links.union(last))
        forget(before, last)
    forget(held, members, texts)

    found = classes.join(joined, classes.rep == joined.node, "left").select("set_hi", "set_lo", F.coalesce("component", "rep").alias("component_id"))
    alone = shapes.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = filled.join(found, ["set_hi", "set_lo"]).select("doc_id", "n_shingles", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
