"""Filings through all checks, and what is shown and written of answers."""

import datetime
import json

from pyspark.sql import functions as F

from folio.operators import extraction, presentation

PROSE = " ".join(["the company sells many good products to the people of the land and earns money"] * 4)
COVER = ["FORM 10-K", "Securities and Exchange Commission", "Washington, D.C. 20549", "Acme Widgets, Inc.", "(Exact name of registrant as specified in its charter)", "For the fiscal year ended September 28, 2019", "Trading symbol: ACM", PROSE]
SIGNED = ["Pursuant to the requirements of Section 13 or 15(d) of the Act", PROSE]


def extracted(spark, documents, scope="10k"):
    lines = [(d, p, n, x) for d, pages in documents.items() for p, page in enumerate(pages, 1) for n, x in enumerate(page)]
    meta = spark.createDataFrame([(d, "ACM", "acme-widgets-inc", 2019) for d in documents if d != "unknown"], "doc_id string, ticker string, company string, fiscal_year int")
    vocabulary = spark.createDataFrame([(w,) for w in {*PROSE.split()}], "word string")
    return extraction.extract(spark.createDataFrame(lines, "doc_id string, page long, line_no long, line string"), meta, vocabulary, scope)


def test_extraction(spark):
    body = [[f"Page head {i}", f"own line {'abcdefg'[i]}", PROSE, f"tail line {'abcdefg'[i]}", f"{i}"] for i in range(1, 7)]
    garbled = [["xq zzk vvw qqj " * 12]] * 2
    documents = {
        "good": [["letter " * 30], COVER, *body, SIGNED, ["exhibits " * 30]], "scan": [["x"], ["y"]], "garbled": [COVER, *garbled, SIGNED], "garbled_wrapper": [*garbled, COVER, [PROSE], SIGNED],
        "other": [[x.replace("Acme", "Beta").replace("ACM", "BET") for x in COVER], SIGNED], "report": [[PROSE], [PROSE]], "unknown": [COVER],
    }
    docs, lines, rejected = extracted(spark, documents)
    assert {r.doc_id: r.reason for r in rejected.collect()} == {"scan": "scanned", "garbled": "unreadable text", "other": "wrong company", "report": "out of scope"}
    found = {r.doc_id: r for r in docs.collect()}
    g = found["good"]
    assert set(found) == {"good", "garbled_wrapper"} and (g.n_pages, g.doc_type, g.first, g.last, g.company_name, g.fiscal_year_end) == (10, "10-K_wrapped", 2, 9, "Acme Widgets, Inc.", datetime.date(2019, 9, 28))
    kept = lines.where("doc_id = 'good'").orderBy("page", "line_no").collect()
    assert {r.page for r in kept} == set(range(2, 10)) and [r.line for r in kept if r.page == 3] == ["own line b", PROSE, "tail line b"]
    docs, lines, rejected = extracted(spark, documents, "all")
    assert "report" in {r.doc_id for r in docs.collect()} and lines.where("doc_id = 'good'").select("page").distinct().count() == 10


def label(spark, *values):
    df = spark.createDataFrame([values], "i int, name string, y int, section string, page int")
    return df.select(presentation.source_label(*map(F.col, df.columns)).alias("x")).first().x


def test_labels_and_shown_answers(spark):
    assert label(spark, 1, "AAPL", 2020, "Item 7", 31) == "1. AAPL 2020 · Item 7 · p. 31"
    assert label(spark, 2, "AAPL", 2020, "Unknown", 3) == "2. AAPL 2020 · No section · p. 3" == label(spark, 2, "AAPL", 2020, None, 3)
    assert label(spark, 1, "AAPL", 2024, "Yahoo Finance (annual figures, fetched on 2026-10-20)", 0) == "1. AAPL 2024 · Yahoo Finance · fetched on 2026-10-20"
    assert label(spark, 1, "AAPL", 2024, "Yahoo Finance", 0).endswith("fetched on unknown date")
    df = spark.createDataFrame([("A", ["1. x", "2. y"], 12), ("B", [], None)], "a string, l array<string>, t int")
    shown = [r.x for r in df.select(presentation.shown_answer(F.col("a"), F.col("l"), F.col("t")).alias("x")).collect()]
    assert shown == ["A\n\n**Citations:**\n- 1. x\n- 2. y\n\n_Response time: 12 ms_", "B"]
    seen = spark.createDataFrame([("Co", 2020, "Item 7", 3, "t"), ("Co", 2024, "Yahoo Finance (x)", 0, "t")], "c string, y int, s string, p int, t string")
    assert [r.x for r in seen.select(presentation.as_seen(*map(F.col, "cyspt")).alias("x")).collect()] == ["Source: Co, fiscal 2020 10-K, Item 7, page 3\nt", "Source: Co, fiscal 2024, Yahoo Finance (x)\nt"]


def test_public_answers(spark):
    df = spark.createDataFrame([("a", "answered", [("c1", "x")])], "answer string, status string, sources array<struct<chunk_id:string,excerpt:string>>")
    out = presentation.public(df)
    assert out.columns == ["answer", "sources"] and out.first().sources[0].asDict() == {"excerpt": "x"}


def test_run_summary_and_files(spark, tmp_path):
    records = spark.createDataFrame([("answered", "A", "A", 5, 10, 1), ("answered", "A", "B", 9, None, 2), ("error", None, None, None, None, None), ("answered", "C", "C", 7, 1, 1), ("answered", "D", "D", 1, 1, 1)], "status string, detected string, expected string, latency_ms int, input_tokens int, output_tokens int")
    scored = spark.createDataFrame([("1", "x", 0.5, None, "q1"), ("2", "x", 1.0, float("nan"), "q2"), ("3", "y", None, None, "q3")], "id string, category string, faithfulness double, answer_relevancy double, question string")
    s = presentation.run_summary(records, scored.drop("answer_relevancy")).first()
    assert (s.questions, s.scored, s.status, s.detected_as_labeled, s.input_tokens, s.output_tokens, s.median_latency_ms_answered) == (5, 3, {"answered": 4, "error": 1}, 4, 12, 5, 7)
    assert s.average.faithfulness == 0.75 and [(c.category, c.n, c.average.faithfulness) for c in s.by_category] == [("x", 2, 0.75), ("y", 1, None)]
    presentation.write_scores(scored.drop("answer_relevancy"), str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).columns == ["id", "category", "faithfulness", "question"]
    snapshots = spark.createDataFrame([("A", "ok", 1.0), ("B", "no_data", None)], "ticker_10k string, status string, v double")
    presentation.write_snapshots(snapshots, str(tmp_path / "snapshots"))
    assert json.loads(next((tmp_path / "snapshots" / "ticker=A").glob("*.json")).read_text())["v"] == 1.0 and not (tmp_path / "snapshots" / "ticker=B").exists()
    assert presentation.load_snapshot(snapshots, "A").count() == 1 and presentation.load_snapshot(snapshots, "../A").count() == 0
    hits = spark.createDataFrame([("A", 2020, "a-inc"), ("A", 2021, "a-inc")], "ticker string, fiscal_year int, company string")
    named = presentation.with_official_company(hits, spark.createDataFrame([("A", 2020, "A, Inc.")], "ticker string, fiscal_year int, name string"))
    assert sorted((r.fiscal_year, r.company) for r in named.collect()) == [(2020, "A, Inc."), (2021, "a-inc")]
