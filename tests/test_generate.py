"""The answer stages with an injected generator."""

import json

from folio.operators import generate


def test_stages(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(question, context):
        calls.add(1)
        if "fails" in question:
            raise ValueError("no service")
        if "odd" in question:
            return "no json"
        assert context.startswith('<document id="D1"') and "</document>" in context
        return json.dumps({"status": "answered", "answer": f"{question} [2], [1].", "sources": [{"doc_id": "D1", "excerpt": "alpha"}, {"doc_id": "D2", "excerpt": "beta"}]})

    questions = spark.createDataFrame([(1, "first"), (2, "empty"), (3, "fails"), (4, "odd"), (5, None)], "qid long, question string")
    row = lambda q, rank, text: (q, rank, f"c{rank}", text, "Acme", 2020, "Item 1", 1)
    hits = spark.createDataFrame([row(1, 2, "has beta"), row(1, 1, "has alpha"), row(3, 1, "x"), row(4, 1, "x"), row(5, 1, "x")], "qid long, rank int, chunk_id string, text string, company string, fiscal_year int, section string, page int")
    answers, rejected = generate.answers(questions, hits, model)
    found = sorted((r.qid, r.status, r.position or 0, r.chunk_id or "", r.excerpt or "") for r in answers.collect())
    assert found == [(1, "answered", 1, "c1", "alpha"), (1, "answered", 2, "c2", "beta"), (2, "insufficient_context", 0, "", ""), (5, "insufficient_context", 0, "", "")]
    assert sorted(tuple(r) for r in rejected.collect()) == [(3, "ValueError: no service"), (4, "malformed")]
    # Without hits there is no call at all, and with them one for each question but for tries that fail.
    calls.value = 0
    nothing = generate.replies(questions, generate.answer.context(hits.limit(0)), model).collect()
    assert calls.value == 0 and {r.reply for r in nothing} == {generate.NOTHING_FOUND}
    made = {r.qid: r for r in generate.replies(questions, generate.answer.context(hits), model, tries=3, partitions=2).collect()}
    assert calls.value == 5 and made[3].error == "ValueError: no service" and json.loads(made[1].reply)["answer"].startswith("first") and made[1].latency_ms >= 0
