"""From questions and hits to parsed answers, with an injected generator that Spark's tasks call."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import answer

#: A question and its rendered context to a reply in JSON.
Generator = Callable[[str, str], str]
NOTHING_FOUND = json.dumps({"status": "insufficient_context", "answer": "", "sources": []})
REPLIES = "qid long, reply string, error string, latency_ms long"


def _called(batches: Iterator[pa.RecordBatch], generate: Generator, tries: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        replies, errors, took = [], [], []
        for question, context in zip(batch["question"].to_pylist(), batch["context"].to_pylist(), strict=True):
            began, reply, error = time.monotonic(), None, None
            for _ in range(tries):
                try:
                    reply, error = generate(question, context), None
                    break
                except Exception as e:  # noqa: BLE001
                    error = f"{type(e).__name__}: {e}"[:300]
            replies.append(reply)
            errors.append(error)
            took.append(int((time.monotonic() - began) * 1000))
        yield pa.RecordBatch.from_arrays([batch["qid"], pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(took, pa.int64())], ["qid", "reply", "error", "latency_ms"])


def replies(questions: DataFrame, contexts: DataFrame, generate: Generator, tries: int = 2, partitions: int | None = None) -> DataFrame:
    """questions(qid, question), contexts of answer.context() -> (qid, reply, error, latency_ms), a row for each question.

    The generator is called in tasks, once a question that has a context; one without gets its reply without a call. A call that
    fails `tries` times gives a row with its error and no reply, and no other question's is lost. Calls wait for a service, so
    `partitions` (of the session's shuffles, if not given) says how many run at once. A context is bounded by its budget."""
    place = F.substring("place", 2, 12).cast("int")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "rendered"))), lambda x: x["rendered"]), "\n")
    asked = questions.select(F.col("qid").cast("long").alias("qid"), "question")
    whole = asked.join(contexts.groupBy(F.col("qid").cast("long").alias("qid")).agg(joined.alias("context")), "qid", "left")
    waiting = whole.where("context is not null and question is not null")
    waiting = waiting.repartition(partitions, "qid") if partitions else waiting.repartition("qid")
    called = waiting.select("qid", "question", "context").mapInArrow(lambda batches: _called(batches, generate, tries), REPLIES)
    return called.union(whole.where("context is null or question is null").select("qid", F.lit(NOTHING_FOUND), F.lit(None).cast("string"), F.lit(0).cast("long")))


def answers(questions: DataFrame, hits: DataFrame, generate: Generator, budget: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected): the stages context, generator and parser over questions(qid, question) and hits(qid, rank, chunk_id,
    text, company, fiscal_year, section, page). answers are those of answer.parse_replies() with latency_ms; rejected(qid,
    reason) are questions whose generator failed or whose reply is malformed. Write the replies first (see replies()) where a
    generator's calls must not be made twice."""
    contexts = answer.context(hits, budget)
    made = replies(questions, contexts, generate)
    parsed = answer.parse_replies(made.where("error is null").select("qid", "reply"), contexts.select(F.col("qid").cast("long").alias("qid"), "place", "chunk_id", "text"))
    bad = made.where("error is not null").select("qid", F.col("error").alias("reason")).union(parsed.where("status = 'malformed'").select("qid", F.lit("malformed")))
    return parsed.where("status != 'malformed'").join(made.select("qid", "latency_ms"), "qid"), bad
