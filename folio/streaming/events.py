"""Streams: the newest row of a key, sessions, chunk upserts, and the answer text out of a reply that arrives in pieces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key, by one aggregate that is combined before the shuffle."""
    others = [c for c in events.columns if c != key]
    picked = events.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return picked.select(key, "r.*")


def sessions(events: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """(key, start, end, n), a session ending after `gap` without events; over a stream, late rows go by the watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, watermark) if watermark else rows
    found = rows.groupBy(key, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, replace):
    """Start a query that replaces the documents of each micro-batch in the index by `replace(spark, rows, path)`. A batch that
    runs again replaces the same documents by the same rows."""
    return chunks.writeStream.foreachBatch(lambda rows, _: replace(rows.sparkSession, rows, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class AnswerText:
    """The text of the top-level "answer" of a JSON object, as far as the pieces so far tell it. Its state is the text itself, so
    any cut is the same to it; a reply is a few thousand characters."""

    def __init__(self, seen: str = "", sent: int = 0):
        self.seen, self.sent = seen, sent

    def feed(self, piece: str) -> str:
        self.seen += piece
        text = self._answer()
        new, self.sent = text[self.sent :], max(self.sent, len(text))
        return new

    def _answer(self) -> str:
        s, i, depth, key = self.seen, 0, 0, None
        expecting = False
        while i < len(s):
            c = s[i]
            if c == '"':
                end, whole = self._string_end(i)
                if depth == 1 and expecting and key == "answer":
                    return self._decoded(s[i + 1 : end])
                if not whole:
                    return ""
                if depth == 1 and not expecting:
                    key = json.loads(s[i : end + 1])
                i = end
            elif c in "{[":
                depth += 1
                expecting = False if c == "{" and depth == 1 else expecting
            elif c in "}]":
                depth -= 1
            elif depth == 1 and c in ":,":
                expecting = c == ":"
            i += 1
        return ""

    def _string_end(self, start: int) -> tuple[int, bool]:
        i = start + 1
        while i < len(self.seen):
            if self.seen[i] == "\\":
                i += 1
            elif self.seen[i] == '"':
                return i, True
            i += 1
        return len(self.seen), False

    @staticmethod
    def _decoded(raw: str) -> str:
        """What is whole of a string: not a half escape, nor the first half of a surrogate pair."""
        for cut in range(0, 13):
            part = raw[: len(raw) - cut] if cut else raw
            try:
                text = json.loads(f'"{part}"', strict=False)
            except ValueError:
                continue
            if not text or not 0xD800 <= ord(text[-1]) <= 0xDBFF:
                return text
        return ""


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, sent = state.get if state.exists else ("", 0)
    reader = AnswerText(seen, sent)
    pieces = pd.concat(list(frames)).sort_values("seq")
    out = "".join(reader.feed(p) for p in pieces.piece)
    state.update((reader.seen, reader.sent))
    yield pd.DataFrame({"reply_id": [key[0]], "text": [out]})


def answer_tokens(pieces: DataFrame) -> DataFrame:
    """A stream of pieces(reply_id long, seq long, piece) -> (reply_id, text): what each micro-batch adds to the answer."""
    return pieces.groupBy("reply_id").applyInPandasWithState(_advance, "reply_id long, text string", "seen string, sent long", "append", GroupStateTimeout.NoTimeout)
