"""Heading forms, consistency, selection by priority, and labels by category."""

import pytest

from folio.operators import evaluation, profile

REVENUE, INCOME = r"\bnet sales\b|\brevenues?\b", r"\bnet (?:income|loss)\b"
QUESTION = "qid string, doc_id string, category string, sections array<string>, figures array<struct<figure:string,metric:string>>, pattern string, least int"


def labels(spark, question, chunks):
    asked = spark.createDataFrame([("Q", "d", *question), ("other", "e", *question)], QUESTION)
    rows = spark.createDataFrame([("d", *c) for c in chunks], "doc_id string, chunk_id string, section string, text string")
    found = evaluation.relevance_labels(asked, rows).collect()
    assert {r.qid for r in found} <= {"Q"}
    return sorted(r.chunk_id for r in found)


def test_labels_by_category(spark):
    numeric = [
        ("statement", "Item 8", "Table (Item 8): INCOME\n| Total net sales | 274,515 | 260,174 |"), ("other_row", "Item 8", "Table (Item 8): LEASES\n| Lease payments | 274,515 |\n| Net sales | 1 |"),
        ("sentence", "Item 7", "Net income was 57,411 in 2020. Other items were small."), ("apart", "Item 7", "Net income rose. It was 57,411."), ("null", "Item 7", None),
    ]
    assert labels(spark, ("numeric_results", [], [("274,515", REVENUE), ("57,411", INCOME)], None, None), numeric) == ["sentence", "statement"]
    controls = [("definition", "Item 9A", "Disclosure controls are designed to ensure..."), ("conclusion", "Item 9A", "We believe that our disclosure controls were  not Effective."), ("elsewhere", "Item 7", "were effective"), ("word", "Item 9A", "We CONCLUDED so.")]
    assert labels(spark, ("controls", ["Item 9A"], None, None, None), controls) == ["conclusion", "word"]
    risks = [("two", "Item 1A", "We face intense competition, and our cloud services may fail."), ("one", "Item 1A", "We face competition and COMPETITion."), ("wrong_section", "Item 7", "Competition and cloud services."), ("no_section", None, "competition, cloud")]
    topics = r"competit|cloud|security (?:breach|incident)"
    assert labels(spark, ("risk_factors", ["Item 1A"], None, topics, None), risks) == ["two"]
    assert labels(spark, ("risk_factors", ["Item 1A"], None, topics, 1), risks) == ["one", "two"]
    assert labels(spark, ("market_risk", ["Item 7A", "Item 1A"], None, None, None), [*risks, ("rate", "Item 7A", "")]) == ["one", "rate", "two"]
    assert labels(spark, ("risk_factors", ["Item 1A"], None, None, None), risks) == []


def test_labels_are_written_for_all_or_not_at_all(spark, tmp_path):
    questions = spark.createDataFrame([("a", ["old"]), ("b", None)], "qid string, relevant_chunk_ids array<string>")
    some = spark.createDataFrame([("a", "c2"), ("a", "c1")], "qid string, chunk_id string")
    path = str(tmp_path / "labels")
    with pytest.raises(ValueError, match="b"):
        evaluation.write_labels(questions, some, path)
    assert not (tmp_path / "labels").exists()
    evaluation.write_labels(questions, some.union(spark.createDataFrame([("b", "c3")], some.schema)), path)
    assert {r.qid: r.relevant_chunk_ids for r in spark.read.parquet(path).collect()} == {"a": ["c1", "c2"], "b": ["c3"]}


def test_item_formats(spark):
    text = "Item 1. x ITEM 1A: y item 2 — z Item 3 . w ITEM 9B- item 7 Items 8. iTEM 9: " + "ITEM 4. " * 3
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", "Item 1. " * 199 + "ITEM 2: ITEM 3: ")], "doc_id string, text string")
    found = sorted((r.doc_id, r.place, r.form, r.n) for r in profile.item_formats(rows).collect())
    assert found == [
        ("a", 1, "MAYUSCULAS + '.'", 3), ("a", 2, "Capitalizado + '.'", 2), ("a", 3, "MAYUSCULAS + ':'", 1), ("a", 4, "minusculas + '—'", 1), ("a", 5, "MAYUSCULAS + '-'", 1),
        ("c", 1, "Capitalizado + '.'", 199), ("c", 2, "MAYUSCULAS + ':'", 1),
    ]


def test_consistency(spark):
    rows = [("a", "Form 10-K of brk.b in 2020", "BRK.B", 2020), ("b", "BRKxB 12020 form 10-Q", "BRK.B", 2020), ("c", None, "A", 2020), ("d", "x" * 20_000 + " A 2020 annual report", "A", 2020)]
    found = {r.doc_id: (r.has_ticker, r.has_year, r.has_form) for r in profile.consistency(spark.createDataFrame(rows, "doc_id string, text string, ticker string, fiscal_year int")).collect()}
    assert found == {"a": (True, True, True), "b": (False, False, False), "c": (False,) * 3, "d": (False,) * 3}


def test_rank_and_priority(spark):
    rows = spark.createDataFrame([("x", "BB", 5.0), ("x", "AA", 5.0), ("y", "CC", 7.0), ("z", "DD", None)], "g string, item string, v double")
    assert [tuple(r) for r in profile.rank_by_best(rows, "g", "item", "v", 5).collect()] == [("y", "CC", 7.0), ("x", "AA", 5.0)]
    filings = [(c, y, t, s) for c, t, s in (("acme", "acm", 1.04), ("beta", "BET", 1.0), ("gone", "ZZZ", 1.0)) for y in (2019, 2020)] + [("half", 2019, "BET", 1.0), ("acme", 2018, "BET", 9.0), ("acme", 2020, "ALT", 1.0)]
    df = spark.createDataFrame(filings, "company string, y int, ticker string, mb double")
    known = spark.createDataFrame([("bet", 0), ("ALT", 2), ("ACM", 1)], "item string, priority int")
    found = profile.complete_by_priority(df, "company", "y", [2019, 2020], "ticker", known, 5, "mb")
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(1, "beta", "BET", 2.0), (2, "acme", "ACM", 3.1)]
    assert profile.complete_by_priority(df, "company", "y", [2019, 2020], "ticker", known, 1, "mb").count() == 1


def test_quartiles_are_exact_and_no_task_has_all_values(spark):
    import numpy as np

    from folio.operators.profile import describe

    rng = np.random.default_rng(3)
    for xs in ([], [4.0], [2.0, 2.0, 2.0], [1.0, 2.0], [1e9, *rng.random(500).tolist(), None], rng.integers(0, 9, 1000).astype(float).tolist()):
        out = describe(spark.createDataFrame([(x,) for x in xs], "x double"), "x")
        row, known = out.first(), [x for x in xs if x is not None]
        want = [round(float(q), 6) for q in np.quantile(known, [0.25, 0.5, 0.75])] if known else [None] * 3
        assert [row.p25, row.p50, row.p75] == want and row.n == len(known)
    assert "percentile(" not in out._jdf.queryExecution().toString()
