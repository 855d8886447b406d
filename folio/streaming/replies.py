"""The answer text of JSON replies that arrive in pieces, as a stream: an automaton for each reply, held by Spark as state.

Each character is looked at once, whatever came before it; what is held between pieces is a few numbers and at most one
unfinished escape or key. Needs the RocksDB state store (see STATE_STORE), as transformWithState does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
FIELD = "answer"
#: Where the automaton stands: between strings, in a key, in a string that is passed over, in the answer, behind it.
OUTSIDE, KEY, PASSED, INSIDE, DONE = range(5)
STRUCTURE, QUOTED = re.compile(r'[\[\]{},:"]'), re.compile(r'["\\]')
#: Raw characters of a key beyond which it can't be FIELD, however it is escaped.
LONGEST_KEY = 6 * len(FIELD)
ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|[^u])")


def unescaped(raw: str) -> str:
    """An escape's character; what is none, or half a pair, becomes the replacement character."""
    try:
        text = json.loads(f'"{raw}"')
    except ValueError:
        return "�"
    return "".join("�" if 0xD800 <= ord(c) <= 0xDFFF else c for c in text)


def _take(held: str, end: bool) -> tuple[str, str]:
    """What of raw answer text is decided, decoded, and the rest: an unfinished escape, or half a surrogate pair."""
    out, at = [], 0
    while at < len(held):
        if held[at] != "\\":
            stop = held.find("\\", at)
            stop = len(held) if stop < 0 else stop
            out.append(held[at:stop])
            at = stop
            continue
        size = 6 if held[at + 1 : at + 2] == "u" else 2
        if re.match(r"\\u[dD][89abAB]", held[at:]) and (len(held) < at + 12 and not end or re.match(r"\\u[dD][c-fC-F]", held[at + 6 :])):
            # The first half of a pair: the other half, or whatever comes in its place, decides. Six characters behind it
            # are needed only while they can still become the second half.
            rest = held[at + 6 : at + 12]
            if not end and len(rest) < 6 and "\\udc00"[: min(len(rest), 2)] == rest[:2].lower():
                return "".join(out), held[at:]
            size = 12 if ESCAPE.fullmatch(rest) and re.match(r"\\u[dD][c-fC-F]", rest) else 6
        if len(held) < at + size:
            return ("".join(out), held[at:]) if not end else ("".join([*out, "�"]), "")
        out.append(unescaped(held[at : at + size]))
        at += size
    return "".join(out), ""


def advance(state: tuple, piece: str) -> tuple[tuple, str]:
    """state (mode, depth, value, wanted, held) and the next piece -> the state behind it and the answer's text in it. `value`:
    a value and no key is due; `wanted`: the last key of the outer object was FIELD."""
    mode, depth, value, wanted, held = state
    out, at = [], 0
    while at < len(piece) and mode != DONE:
        if mode == OUTSIDE:
            found = STRUCTURE.search(piece, at)
            if not found:
                break
            sign, at = found[0], found.end()
            if sign in "{[":
                depth += 1
                value = not (sign == "{" and depth == 1)
            elif sign in "}]":
                depth -= 1
            elif sign == '"':
                key = depth == 1 and not value
                mode, held = (KEY if key else INSIDE if depth == 1 and wanted else PASSED), ""
            elif depth == 1:
                value = sign == ":"
            continue
        # In a string: up to its closing quote. A backslash at the end of the piece before escapes this piece's first character.
        escaped = held.endswith("\\") and (len(held) - len(held.rstrip("\\"))) % 2 == 1
        start, end = at, None
        at += escaped
        while end is None and (found := QUOTED.search(piece, at)):
            at = found.end() + (found[0] == "\\")
            if found[0] == '"':
                end = found.start()
        at = min(at, len(piece)) if end is not None else len(piece)
        raw = held + piece[start : len(piece) if end is None else end]
        if mode == INSIDE:
            text, held = _take(raw, end is not None)
            out.append(text)
            mode = DONE if end is not None else mode
        elif mode == PASSED:
            held = raw[len(raw.rstrip("\\")) :] if end is None else ""
            held = held[: len(held) % 2]
            mode = OUTSIDE if end is not None else mode
        elif end is not None:
            wanted, mode, held = len(raw) <= LONGEST_KEY and unescaped(raw) == FIELD, OUTSIDE, ""
        else:
            held = raw if len(raw) <= LONGEST_KEY else "x" * (LONGEST_KEY + 1) + "\\" * ((len(raw) - len(raw.rstrip("\\"))) % 2)
    return (mode, depth, value, wanted, held), "".join(out)


START = (OUTSIDE, 0, True, False, "")


class AnswerPieces(StatefulProcessor):
    """Pieces (reply_id, seq, piece, last) -> (reply_id, text). Pieces are taken in the order of seq from 0; early ones wait as
    map state, repeated ones tell nothing. Once the answer is closed or the last piece is in, no more than a mark is held; a
    timer that each batch of pieces sets anew removes everything of a reply that falls silent."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next long, timer long, mode int, depth int, value boolean, wanted boolean, held string")
        self.early = handle.getMapState("early", "seq long", "piece string, last boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        place, timer, *state = self.at.get() if self.at.exists() else (0, None, *START)
        state, out = tuple(state), []
        waiting = {k[0]: tuple(v) for k, v in self.early.iterator()}
        before = set(waiting)
        for part in rows:
            for seq, piece, last in zip(part["seq"], part["piece"], part["last"], strict=True):
                if seq >= place and state[0] != DONE:
                    waiting.setdefault(int(seq), (piece or "", bool(last)))
        while state[0] != DONE and place in waiting:
            piece, last = waiting.pop(place)
            state, text = advance(state, piece)
            out.append(text)
            place += 1
            if last:
                state = (DONE, *START[1:])
        if state[0] == DONE:
            state, waiting = (DONE, *START[1:]), {}
        for seq in before - set(waiting):
            self.early.removeKey((seq,))
        for seq in set(waiting) - before:
            self.early.updateValue((seq,), waiting[seq])
        now = timerValues.getCurrentProcessingTimeInMs()
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.timeout_ms)
        self.at.update((place, now + self.timeout_ms, *state))
        if text := "".join(out):
            yield pd.DataFrame({"reply_id": [key[0]], "text": [text]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        self.early.clear()
        return iter(())

    def close(self) -> None:
        pass


def answer_pieces(pieces: DataFrame, timeout_ms: int = 600_000) -> DataFrame:
    """A stream of pieces(reply_id long, seq long, piece, last boolean) -> (reply_id, text): what each micro-batch adds to the
    top-level answer of each reply. Null pieces are empty; rows of null reply_id or seq are left out."""
    rows = pieces.select("reply_id", "seq", "piece", "last").dropna(subset=["reply_id", "seq"])
    return rows.groupBy("reply_id").transformWithStateInPandas(
        AnswerPieces(timeout_ms), StructType.fromDDL("reply_id long, text string"), outputMode="Append", timeMode="ProcessingTime"
    )
