"""Token ids in binary shards with Elias-Fano coded document boundaries (operator 13).

A shard is a row of a Parquet table: the concatenated ids of consecutive documents as little-endian integers, and two
monotone sequences in Elias-Fano form, where documents begin and which ids they have. Parquet is what Spark writes to any
file system and commits once, whatever executors are lost.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import new_path, read_rows_only
from .words import slices

#: Every SAMPLE-th one of the high bits has its place stored.
SAMPLE = 64
#: Plain pieces that are encoded in one text.
JOINED = 200
HEAD = struct.Struct("<qqqB")


class EliasFano:
    """A sequence of non-decreasing integers: `low` bits of each number as they are, and the rest in unary, with the place
    of every SAMPLE-th one beside them. It takes about 2 + log2(range / length) bits a number. select() finds numbers by
    their places without decoding the others."""

    def __init__(self, n: int, first: int, size: int, low: int, low_bits: bytes, high_bits: bytes, samples: bytes):
        self.n, self.first, self.size, self.low, self.low_bits = n, first, size, low, low_bits
        self.high = np.frombuffer(high_bits, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @staticmethod
    def encode(numbers: np.ndarray) -> bytes:
        numbers = np.asarray(numbers, np.int64)
        n, first = len(numbers), int(numbers[0]) if len(numbers) else 0
        offsets = (numbers - first).astype(np.uint64)
        size = int(offsets[-1]) if n else 0
        low = max(0, (size // max(n, 1)).bit_length() - 1)
        ones = (offsets >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        bits = ((offsets[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return b"".join([HEAD.pack(n, first, size, low), np.packbits(bits, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()])

    @classmethod
    def of(cls, data: bytes) -> EliasFano:
        n, first, size, low = HEAD.unpack_from(data)
        a = HEAD.size
        b = a + (n * low + 7) // 8
        c = b + ((n + (size >> low)) + 7) // 8 if n else b
        return cls(n, first, size, low, data[a:b], data[b:c], data[c:])

    def _place(self, i: int) -> int:
        """Of the i-th one in the high bits: from the sample before it, over the bits' bytes."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        left += int(np.bitwise_count(self.high[byte] & np.uint8((1 << (at & 7)) - 1)))  # ones of this byte before the sample
        while True:
            part = self.high[byte : byte + SAMPLE]
            ones = np.cumsum(np.bitwise_count(part), dtype=np.int64)
            if ones[-1] > left:
                k = int(np.searchsorted(ones, left, "right"))
                inside = np.flatnonzero(np.unpackbits(part[k : k + 1], bitorder="little"))
                return (byte + k) * 8 + int(inside[left - (int(ones[k - 1]) if k else 0)])
            left -= int(ones[-1])
            byte += SAMPLE

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = i * self.low
        bits = int.from_bytes(self.low_bits[start >> 3 : (start + self.low + 7) >> 3], "little") >> (start & 7)
        return self.first + ((self._place(i) - i) << self.low | bits & ((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        """All numbers, from one pass."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(np.frombuffer(self.low_bits, np.uint8), bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        low = (bits.astype(np.int64) << np.arange(self.low)).sum(1) if self.low else 0
        return self.first + (high << self.low | low)


class Shard:
    """Documents of one row: ids of each, found through the boundaries."""

    def __init__(self, ids: bytes, width: int, bounds: bytes, doc_ids: bytes, n_null: int):
        self.ids, self.bounds, self.doc_ids, self.n_null = np.frombuffer(ids, f"<u{width}"), EliasFano.of(bounds), EliasFano.of(doc_ids), n_null

    def __len__(self) -> int:
        return self.bounds.n - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.doc_ids.select(i - self.n_null)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[0] : start[0] + size[0]], values[start[1] : ...] and so on, one after the other."""
    return values[np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)]


class PieceTable:
    """Ids of distinct pieces of words, for tokenizers that never join what white space divides.

    A word of plain characters is put in small letters and divided by the tokenizer's own pattern, so `Word,` and `word`
    share a piece; any other word goes to the library as it is. Distinct words and pieces of a slice of texts are found by
    Arrow, the table holds pieces only. It is emptied when it would hold more than max_pieces.
    """

    #: No other character of this range changes by NFC, is white space, or has a small form of more than one character.
    PLAIN = "^[!-~\u00a1-\u012f\u0131-\u017f]*$"

    def __init__(self, model: str, max_pieces: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        spec = json.loads(model)
        self.tokenizer, self.max_pieces = Tokenizer.from_str(model), max_pieces
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.pattern = next(s["pattern"]["Regex"] for s in _steps(spec, "pre_tokenizer", "pretokenizers") if s["type"] == "Split")
        self.lower = any(s["type"] == "Lowercase" for s in _steps(spec, "normalizer", "normalizers"))
        self.one_piece = re.compile("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u017f]+").fullmatch
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        if not suffix:
            self.one_piece = lambda piece: None
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.size, self.start, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 12, np.uint32), 0

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, size) of pieces. Plain ones are encoded many in one text: the ids that end a piece tell them apart."""
        whole = [bool(p) and self.one_piece(p) is not None for p in pieces]
        plain = [p for p, w in zip(pieces, whole, strict=True) if w]
        joined = [" ".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
        parts = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *parts])
        sizes = np.diff(np.flatnonzero(self.ends_piece[flat]), prepend=-1)
        assert len(sizes) == len(plain), "an id within a piece looks like its end"
        each = [x.ids for x in self.tokenizer.encode_batch_fast([p for p, w in zip(pieces, whole, strict=True) if not w], add_special_tokens=False)]
        size, whole = np.empty(len(pieces), np.int64), np.array(whole, bool)
        size[whole], size[~whole] = sizes, [len(x) for x in each]
        ids, is_plain = np.empty(int(size.sum()), np.uint32), np.repeat(whole, size)
        ids[is_plain], ids[~is_plain] = flat, [i for x in each for i in x]
        return ids, size

    def rows(self, pieces: list[str]) -> np.ndarray:
        """The places of distinct pieces in the table."""
        new = [w for w in pieces if w not in self.at]
        if new and len(self.at) + len(new) > self.max_pieces:
            self.clear()
            new = pieces
        if new:
            flat, sizes = self._encode(new)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.used += len(flat)
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): those of words[i] are ids[start[i] : start[i] + size[i]]."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        text = words.filter(plain)
        text = pc.utf8_lower(text) if self.lower else text
        letters = pc.utf8_is_alpha(text)  # most words are one piece
        spaced = pc.replace_substring_regex(text.filter(pc.invert(letters)), self.pattern, "\\0 ")
        lists = pc.ascii_split_whitespace(pc.replace_with_mask(text, pc.invert(letters), spaced))
        rest = words.filter(pc.invert(plain))
        pieces = pa.concat_arrays([lists.flatten().cast(rest.type), rest]).dictionary_encode()
        rows = self.rows(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        ids = _gather(self.ids, self.start[rows], self.size[rows])
        ends = np.concatenate([[0], np.cumsum(self.size[rows])])
        n_plain = len(lists.flatten())
        bounds = np.concatenate([ends[lists.offsets.to_numpy()[:-1]], ends[n_plain:]])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))])
        start, size = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[order], size[order] = bounds[:-1], np.diff(bounds)
        return ids, start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        if not len(each):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ids, start, size = self._words(each.dictionary)
        places = each.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size[places])])
        return _gather(ids, start[places], size[places]), np.diff(ends[words.offsets.to_numpy() - words.offsets[0].as_py()])


@lru_cache(1)
def piece_table(model: str, max_pieces: int) -> PieceTable:
    """One for each Python worker, kept from task to task."""
    return PieceTable(model, max_pieces)


def _steps(spec: dict, kind: str, many: str) -> list[dict]:
    step = spec[kind] or {}
    return step.get(many, [step] if step else [])


def check_model(model: str) -> int:
    """The width of an id in bytes; an error if the tokenizer could join or change something across white space."""
    spec = json.loads(model)
    fits = {
        "NFC": lambda s: True, "Lowercase": lambda s: True,
        "Replace": lambda s: s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ",
        "Split": lambda s: s["behavior"] == "Removed" and s["invert"] and "[^\\s" in s["pattern"]["Regex"],
        "ByteLevel": lambda s: not s["add_prefix_space"] and not s["use_regex"],
    }
    steps = [*_steps(spec, "normalizer", "normalizers"), *_steps(spec, "pre_tokenizer", "pretokenizers")]
    split = [s for s in steps if s["type"] == "Split"]
    added = any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    if len(split) != 1 or added or spec["post_processor"] or spec["truncation"] or not all(s["type"] in fits and fits[s["type"]](s) for s in steps):
        raise ValueError("words of this tokenizer can't be encoded on their own")
    return 2 if Tokenizer.from_str(model).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _shards(batches: Iterator[pa.RecordBatch], model: str, end_id: int, width: int, shard_ids: int, max_pieces: int) -> Iterator[pa.RecordBatch]:
    """Sorted documents as shards of at least shard_ids ids, but for the last."""
    table, part, shard = piece_table(model, max_pieces), TaskContext.get().partitionId(), 0
    docs: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        held = pa.concat_arrays(docs)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        own = held.drop_null().to_numpy()
        out = {
            "part": part, "shard": shard, "n_docs": len(held), "n_ids": int(bounds[-1]), "n_null": held.null_count, "width": width,
            "doc_ids": EliasFano.encode(own), "bounds": EliasFano.encode(bounds), "ids": np.concatenate(ids).astype(f"<u{width}").tobytes(),
        }
        return pa.RecordBatch.from_pylist([out], SHARD_ARROW)

    for batch in batches:
        for cut in slices(batch["text"], slice_bytes=1 << 24):
            flat, n = table.encode(pc.fill_null(batch["text"].slice(cut.lo, cut.n), ""))
            ends = np.cumsum(n)
            ids.append(np.insert(flat, ends, end_id))  # an end id behind each document
            sizes.append(n + 1)
            docs.append(batch["doc_id"].slice(cut.lo, cut.n))
            if sum(map(len, ids)) >= shard_ids:
                yield row()
                shard, docs, sizes, ids = shard + 1, [], [], []
    if docs:
        yield row()


SHARD = "part int, shard int, n_docs long, n_ids long, n_null long, width int, doc_ids binary, bounds binary, ids binary"
SHARD_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.binary()), ("bounds", pa.binary()), ("ids", pa.binary())])


def write_token_shards(docs: DataFrame, path: str, model: str, end_id: int = 2, shard_ids: int = 1 << 20, max_pieces: int = 1_000_000) -> None:
    """documents(doc_id, text) -> shards at path, in ascending doc_id order: documents are dealt by ranges of doc_id (rows
    of one id by the hash of their text, so that no id is too many for a task), and a task writes its range as shards of
    about shard_ids ids. (part, shard) is the order of the shards.

    model: the JSON of a tokenizer whose words are encoded on their own (see check_model); ids equal the library's
    encode(text, add_special_tokens=False), with end_id behind each document. Null texts are empty and have the end id
    only; null ids come first; repeated rows are documents of their own; an empty table writes no shard. A document is in
    one shard, however long. Other columns are not read.
    """
    width = check_model(model)
    docs = read_rows_only(docs, doc_id="doc_id", text="text").withColumn("tie", F.xxhash64("text"))
    dealt = docs.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    dealt.mapInArrow(lambda batches: _shards(batches, model, end_id, width, shard_ids, max_pieces), SHARD).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards at path with `start`, the ids in all shards before. Only counts are gathered for that: the parts' sums
    run over one row for each task that wrote."""
    shards = spark.read.schema(SHARD).parquet(path)
    each = shards.select("part", "shard", "n_ids")
    parts = each.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = each.withColumn("inside", before).join(parts, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))
    return shards.join(starts, ["part", "shard"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(r["ids"], r["width"], r["bounds"], r["doc_ids"], r["n_null"])
            bounds = shard.bounds.all()
            ids = shard.ids.astype("<u4")
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            doc_ids = [None] * r["n_null"] + shard.doc_ids.all().tolist()
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(r["start"] + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The shards at path -> (doc_id, start, n_tokens, ids_crc32), a row for each document: where its ids begin in the
    whole corpus, how many they are, with the end id, and their CRC-32 as little-endian unsigned 32-bit integers."""
    shards = read_token_shards(spark, path)
    return shards.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, model: str, end_id: int = 2) -> DataFrame:
    """Write docs as token shards in the shared folder and read every document back from them. See write_token_shards."""
    spark = docs.sparkSession
    path = new_path(spark, "token-shards")
    write_token_shards(docs, path, model, end_id)
    return read_documents(spark, path)
