"""The streamed answer at every cut, and as state in a stream."""

import json
import random
import time

import pytest

from folio.streaming.replies import START, STATE_STORE, advance, answer_pieces

WHOLE = json.dumps({"meta": {"answer": "no", "list": ["answer"]}, "answer": 'He said "é🎉\\" and\nleft', "sources": [{"answer": "x"}]})
PIECES = "reply_id long, seq long, piece string, last boolean"


def run(pieces):
    state, out = START, ""
    for p in pieces:
        state, text = advance(state, p)
        out += text
        assert len(state[-1]) <= 40
    return out


@pytest.mark.parametrize(
    ("whole", "want"),
    [
        (WHOLE, json.loads(WHOLE)["answer"]),
        ('{"\\u0061nswer": "x\\ud83d\\ude00y\\ud83dz\\udc00\\q \\uZZZZ"', "x😀y�z�� �"),
        ('{"status": "answer", "answer":"ok", "later": "answer"}', "ok"),
        ('{"k' + "x" * 300 + '\\"answer": "no", "answer" : "yes"}', "yes"),
        ('{"answer": 5, "b": "c"}', ""), ('[{"answer": "no"}]', ""), ('{"answer": ["x"], "b": "y"}', ""), ("not json", ""), ("", ""),
        ('{"answer": "\\ud83d\\ud83d\\ude00\\\\"}', "�😀\\"), ('{"answer": "end\\', "end"),
    ],
)
def test_answer_at_every_cut(whole, want):
    rng = random.Random(1)
    assert run([whole]) == want == run(list(whole))
    for cut in range(len(whole) + 1):
        assert run([whole[:cut], whole[cut:]]) == want
    for _ in range(50):
        cuts = sorted(rng.randrange(len(whole) + 1) for _ in range(5))
        assert run([whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]) == want


def test_work_does_not_grow_with_what_came_before():
    """A hundred thousand one-character pieces: reading all again at each would take hours."""
    began = time.process_time()
    assert run(['{"answer": "', *["x"] * 100_000]) == "x" * 100_000
    assert time.process_time() - began < 5


def test_stream_with_late_and_repeated_pieces(spark, tmp_path):
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    src, out = str(tmp_path / "in"), []

    def step(rows, timeout_ms=3_600_000):
        spark.createDataFrame(rows, PIECES).coalesce(1).write.mode("append").parquet(src)
        found = answer_pieces(spark.readStream.schema(PIECES).parquet(src), timeout_ms)
        batches = []

        def take(df, batch_id):
            out.extend(df.collect())
            batches.append(batch_id)

        q = found.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).start()
        until = time.time() + 60
        while len(batches) < 3 and q.isActive and time.time() < until:  # timers keep batches coming without new rows
            time.sleep(0.1)
        q.stop()
        assert len(batches) >= 3
        got = sorted((r.reply_id, r.text) for r in out)
        out.clear()
        return got

    assert step([(1, 1, '"one', False), (2, 0, '{"answer": "a', False), (None, 0, "x", True)]) == [(2, "a")]
    assert step([(1, 0, '{"answer": ', False), (1, 1, '"repeated', False), (1, 3, ' three"}', True), (2, 0, "again", False)]) == [(1, "one")]
    got = step([(1, 2, " two", False), (2, 1, None, False), (2, 2, "b", True)])
    assert got == [(1, " two three"), (2, "b")]
    assert step([(1, 4, " more", False), (2, 3, "c", False)]) == []
    # The timers of replies that fell silent remove their state, so a reply's number can begin anew.
    step([(1, 9, "x", False), (2, 9, "x", False)], timeout_ms=1)
    time.sleep(0.1)
    assert step([(3, 0, '{"answer": "z"', True)], timeout_ms=1) == [(3, "z")]
    got = step([(1, 0, '{"answer": "new"}', True)])
    assert got == [(1, "new")]
