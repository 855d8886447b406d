"""SentencePiece encoding and decoding through a table of distinct chunks (operator 5).

No piece of such a model has a white-space marker behind another character, nor a newline beside another character
(this is checked when the model is loaded). BPE merges therefore never cross the start of a marked word or a newline:
each chunk, markers and what follows them, is segmented on its own. A task keeps a table of the chunks it has met: each
is segmented once, and the ids are joined back by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import read_rows_only
from .words import slices

MARK = "▁"
#: Texts of more characters are segmented in parts.
LONG = 1 << 21
CHUNK = re.compile(r" *[^ \n]+|\n| +")


class ChunkTable:
    """Ids of distinct chunks; emptied when it would hold more than max_chunks, so its memory is bounded."""

    def __init__(self, model: bytes, max_chunks: int):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        crossing = [p.piece for p in proto.pieces if p.type == 1 and (MARK in p.piece.lstrip(MARK) or "\n" in p.piece[1:] or p.piece.startswith("\n") and p.piece != "\n")]
        if crossing or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("chunks of this model can't be segmented on their own")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.prefix = " " if spec.add_dummy_prefix else ""
        spec.add_dummy_prefix = False
        self.parts = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.max_chunks = max_chunks
        self.ends = np.array([self.whole.bos_id()], np.uint32), np.array([self.whole.eos_id()], np.uint32)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.size, self.start, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), 0

    def _add(self, chunks: list[str]) -> None:
        ids = self.parts.encode(chunks, num_threads=1)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))
        self.at.update(zip(chunks, range(len(self.at), len(self.at) + len(chunks)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, flat])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with begin and end ids, as SentencePieceProcessor.encode gives them."""
        if sum(map(len, texts)) <= LONG:
            return [np.concatenate([self.ends[0], x, self.ends[1]]) for x in self._segmented([CHUNK.findall(self.prefix + t.replace(MARK, " ")) if t else [] for t in texts])]
        out = []
        for t in texts:  # a long text's chunks are met some at a time
            chunks = CHUNK.finditer(self.prefix + t.replace(MARK, " ")) if t else iter(())
            parts = [self.ends[0]]
            while some := [m[0] for m in islice(chunks, 100_000)]:
                parts += self._segmented([some])
            out.append(np.concatenate([*parts, self.ends[1]]))
        return out

    def _segmented(self, chunks: list[list[str]]) -> list[np.ndarray]:
        met = set(chain.from_iterable(chunks))
        new = [x for x in met if x not in self.at]
        if new and len(self.at) + len(new) > self.max_chunks:
            self.clear()
            new = list(met)
        if new:
            self._add(new)
        out = []
        for own in chunks:
            rows = np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))
            size = self.size[rows]
            places = np.arange(int(size.sum())) + np.repeat(self.start[rows] - np.cumsum(size) + size, size)
            out.append(self.ids[places])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes, max_chunks: int) -> Iterator[pa.RecordBatch]:
    chunks = ChunkTable(model, max_chunks)
    for batch in batches:
        for part in slices(batch["text"], slice_bytes=1 << 20):
            texts = [x or "" for x in batch["text"].slice(part.lo, part.n).to_pylist()]
            ids = chunks.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(part.lo, part.n), pa.array([len(x) for x in ids], pa.int64()),
                 pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([chunks.decode(x) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )


def encode_and_decode(docs: DataFrame, model: bytes, max_chunks: int = 400_000) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_tokens, ids, decoded), a row for each row of docs.

    model: the bytes of a SentencePiece BPE model file. ids: begin id, the ids of the whole text exactly as the library
    gives them, end id, packed as little-endian unsigned 32-bit integers. decoded: the library's decode() of them. Null
    and empty texts have the begin and end ids only. Rows are independent: nothing is shuffled, repeated rows and null
    ids pass as they are, an empty table gives no rows; other columns are not read, so their names can't clash. A slice with more distinct chunks than max_chunks is
    still encoded whole; the bound is then that slice's.
    """
    docs = read_rows_only(docs, doc_id="doc_id", text="text")
    return docs.mapInArrow(lambda batches: _encoded(batches, model, max_chunks), "doc_id long, n_tokens long, ids binary, decoded string")


def load_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()
