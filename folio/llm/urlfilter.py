"""URL filters over a sorted digest array (operator 10).

Listed hosts with paths are kept as one array sorted by 64-bit xxhash keys. Spark sorts and packs it into files in the
shared folder; each executor fetches them once, and every Python worker maps them into memory and probes with numpy's
binary search. Digests are computed inside the JVM, by the same xxhash. A found key is confirmed against the stored full
string, so a collision never decides. Rules for hosts with all subdomains are a small array of the same form.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, read_rows_only

#: (verdict, rule): the rule is a host and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The seed of Spark's xxhash64().
SEED = 42


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class DigestArray:
    """Strings with a verdict each, sorted by digest, in one buffer: their number, digests, ends, verdicts (1: block) and
    bytes. The buffer can be a mapped file; nothing of it is copied."""

    def __init__(self, buffer: np.ndarray):
        n = int(buffer[:8].view(np.int64)[0])
        self.digests = buffer[8 : 8 + 8 * n].view(np.int64)
        self.blocks = buffer[16 * n + 16 : 17 * n + 16]
        ends, data = buffer[8 * n + 8 : 16 * n + 16], buffer[17 * n + 16 :]
        self.texts = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data))

    @staticmethod
    def pack(digests: np.ndarray, texts: pa.Array, blocks: np.ndarray) -> bytes:
        """The buffer for strings in the order of their digests."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        data = b"".join(x.encode() for x in texts.to_pylist())
        return b"".join([np.array([len(digests)], np.int64).tobytes(), digests.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes(), blocks.astype(np.uint8).tobytes(), data])

    @classmethod
    def of(cls, entries: list[tuple[str, str]]) -> DigestArray:
        """(verdict, string) pairs; of equal strings the last counts."""
        rows = sorted((signed(xxhash.xxh64_intdigest(e.encode(), seed=SEED)), e, v == "block") for e, v in {e: v for v, e in entries}.items())
        packed = cls.pack(np.array([r[0] for r in rows], np.int64), pa.array([r[1] for r in rows], pa.string()), np.array([r[2] for r in rows], bool))
        return cls(np.frombuffer(packed, np.uint8))

    def find(self, digests: np.ndarray, probes: pa.Array) -> np.ndarray:
        """The place of each probe, given with its digest; -1 if it isn't there."""
        out = np.full(len(digests), -1)
        at = np.searchsorted(self.digests, digests)
        rows = np.arange(len(digests))
        while len(rows):  # once, and again only for the probes whose digest another string has
            there = at[rows] < len(self.digests)
            rows = rows[there]
            rows = rows[self.digests[at[rows]] == digests[rows]]
            same = pc.equal(self.texts.take(pa.array(at[rows])), probes.take(pa.array(rows)).cast(pa.large_string())).to_numpy(zero_copy_only=False).astype(bool)
            out[rows[same]] = at[rows[same]]
            rows = rows[~same]
            at[rows] += 1
        return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows (digest, key, block), in order, as one buffer."""
    table = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"digest": pa.array([], pa.int64()), "key": pa.array([], pa.string()), "block": pa.array([], pa.bool_())})])
    if table.num_rows:
        packed = DigestArray.pack(table["digest"].to_numpy(), table["key"].combine_chunks(), table["block"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["buffer"])


def ship(listed: DataFrame, shard_rows: int = 1_000_000) -> list[str]:
    """listed(key, block boolean) -> names of the array's files, in the order of the digests, which every executor fetches
    once. Tasks pack shards of about shard_rows rows; no row comes to the driver. The files stay in the shared folder for
    executors that join later."""
    spark = listed.sparkSession
    rows = listed.where("key is not null").groupBy("key").agg(F.max("block").alias("block")).select(F.xxhash64("key").alias("digest"), "key", "block")
    n = max(1, -(-rows.count() // shard_rows))
    path = new_path(spark, "digests")
    shards = rows.repartitionByRange(n, "digest").sortWithinPartitions("digest", "key").mapInArrow(_packed, "buffer binary")
    # The text writer puts a string's bytes into the file as they are, with a newline behind, which is not read.
    shards.select(F.col("buffer").cast("string")).write.text(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm_path)
    files = sorted(str(x.getPath()) for x in files if x.getLen() > 8 and x.getPath().getName().startswith("part-"))
    for file in files:
        spark.sparkContext.addFile(file)
    return [file.rsplit("/", 1)[1] for file in files]


@lru_cache(16)
def mapped(names: tuple[str, ...]) -> tuple[list[DigestArray], np.ndarray]:
    """The arrays of the files, mapped once a worker, and the first digest of each."""
    arrays = sorted((DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r")) for name in names), key=lambda x: x.digests[0])
    return arrays, np.array([x.digests[0] for x in arrays], np.int64)


def _listed_verdicts(names: tuple[str, ...], digests: np.ndarray, probes: pa.Array) -> np.ndarray:
    """-1 where a probe isn't listed, else 1 for block and 0 for allow."""
    out = np.full(len(digests), -1)
    arrays, firsts = mapped(names)
    shard = np.searchsorted(firsts, digests, "right") - 1
    for k in np.unique(shard[shard >= 0]):
        rows = np.flatnonzero(shard == k)
        found = arrays[k].find(digests[rows], probes.take(pa.array(rows)))
        out[rows[found >= 0]] = arrays[k].blocks[found[found >= 0]]
    return out


def _judged(batches: Iterator[pa.RecordBatch], rules: list[tuple[str, str]], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    array = DigestArray.of(rules)
    sizes = pc.binary_length(array.texts).to_numpy(zero_copy_only=False)
    verdicts = np.array([None, "allow", "block"], object)
    for batch in batches:
        n = batch.num_rows
        probes, owner = batch["probes"].flatten(), np.repeat(np.arange(n), batch["probes"].value_lengths().to_numpy())
        found = array.find(batch["digests"].flatten().to_numpy(), probes)
        # The longest rule that fits a row is the last one after sorting by length.
        hit = np.flatnonzero(found >= 0)
        hit = hit[np.argsort(sizes[found[hit]], kind="stable")]
        rule = np.full(n, -1)
        rule[owner[hit]] = found[hit]
        code = np.full(n, -1)
        code[rule >= 0] = array.blocks[rule[rule >= 0]]
        if names:
            code = np.where(rule >= 0, code, _listed_verdicts(names, batch["digest"].to_numpy(), batch["place"]))
        texts = array.texts.take(pa.array(rule, mask=rule < 0)).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["host"], batch["path"], texts, pa.array(verdicts[code + 1], pa.string())], ["page_id", "host", "path", "rule", "verdict"]
        )


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, otherwise: str = "allow", max_bytes: int = 16 << 30) -> DataFrame:
    """pages(page_id, url), listed(key, block boolean) -> (page_id, host, path, rule, verdict), a row for each row of pages.

    rules: (allow or block, host and start of path). A rule fits its host and all its subdomains where the url's path
    starts with the rule's path; the longest that fits wins. rule and verdict are the winner's. A url that none fits has a
    null rule and the verdict of its host and path in `listed` (of repeated keys, block wins), or else `otherwise`. A null
    url or one without :// has an empty host and path, which no rule fits. Repeated rows are judged alike; long urls are
    judged whole; an empty table gives no rows; without rules or listed keys every url is `otherwise`. Further columns are
    not read, so their names can't clash.

    The listed strings are counted first. Up to max_bytes they go to the executors' disks as mapped files and nothing is
    shuffled; a larger list is joined by digest and string, with the same result.
    """
    host, path = host_and_path(F.col("url"))
    rows = read_rows_only(pages, page_id="page_id", url="url").select("page_id", host.alias("host"), path.alias("path"))
    starts = sorted({len(rule) - (rule + "/").index("/") for _, rule in rules})
    parts = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    heads = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in starts]).cast("array<string>"), lambda x: x.isNotNull())
    probes = F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda x: F.concat(h, x))))
    rows = rows.withColumns({"place": F.concat("host", "path"), "probes": F.when(F.col("host") != "", probes).otherwise(F.array().cast("array<string>"))})
    rows = rows.withColumns({"digests": F.transform("probes", lambda x: F.xxhash64(x)), "digest": F.xxhash64("place")})
    names: tuple[str, ...] = ()
    known = None
    if listed is not None:
        listed = read_rows_only(listed, key="key", block="block").where("key is not null and block is not null")
        if (listed.agg(F.sum(F.octet_length("key") + 17)).first()[0] or 0) <= max_bytes:
            names = tuple(ship(listed))
        else:
            known = listed.groupBy("key").agg(F.max("block").alias("block")).withColumn("digest", F.xxhash64("key"))
    schema = "page_id long, host string, path string, rule string, verdict string"
    out = rows.mapInArrow(lambda batches: _judged(batches, list(rules), names), schema)
    if known is not None:
        place = F.concat("host", "path")
        out = out.join(known, (F.xxhash64(place) == known.digest) & (place == known.key), "left")
        out = out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block"), "block").when(~F.col("block"), "allow")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def thin_pages(pages: DataFrame, least: int = 2) -> DataFrame:
    """pages(url, html) -> listed(key, block): hosts with paths of pages with fewer than `least` paragraphs, which hold no text
    worth reading again wherever they are linked from. Pages without url or html say nothing."""
    host, path = host_and_path(F.col("url"))
    paragraphs = F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0)))
    thin = pages.where(F.col("url").contains("://") & (paragraphs < least))
    return thin.select(F.concat(host, path).alias("key"), F.lit(True).alias("block"))
