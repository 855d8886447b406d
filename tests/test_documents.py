import json

from pyspark.sql import functions as F

from folio.operators import answer, chunking, figures, profile, sections
from folio.plans import SQL
from folio.sources import files
from folio.streaming.events import AnswerText, answer_tokens, latest


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def lines(spark, *pages):
    return spark.createDataFrame([("d", p, n, x) for p, page in enumerate(pages, 1) for n, x in enumerate(page)], "doc_id string, page long, line_no long, line string")


def test_sections_carry_forward(spark):
    toc = [f"Item {i}. Something {i}0" for i in range(1, 6)]
    doc = lines(spark, toc, ["intro", "Item 1. Business", "text", "see Item 7 for more"], ["PART | ITEM 7. Discussion of Results", "Consolidated Balance Sheets"], ["Pursuant to the requirements of Section 13 or 15(d)"], ["Index to Consolidated Financial Statements", "1"])
    got = [r.section for r in sections.label_lines(doc).orderBy("page", "line_no").collect()]
    assert got == ["Unknown"] * 6 + ["Item 1"] * 3 + ["Item 7"] * 2 + ["Item 7"] + ["Item 8"] * 2
    plain = lines(spark, ["x", "INDEX TO FINANCIAL STATEMENTS", "y"])
    assert [r.section for r in sections.label_lines(plain).orderBy("line_no").collect()] == ["Unknown", "Item 8", "Item 8"]


def test_headings(spark):
    label = lambda *page: [r.section for r in sections.label_lines(lines(spark, page)).orderBy("line_no").collect()]
    for line in ("Item 1A. Risk Factors", "ITEM 7: MANAGEMENT'S DISCUSSION", "Item 8", "Item 2 | Properties", "Item 9B Other Information"):
        assert label(line)[0].startswith("Item"), line
    for line in ("Item 7 of this Annual Report explains", "item 1a risks are many", "Item 1. Business – “Employees and Labor Relations.”", "x | Item 1A. Risk Factors included in this report."):
        assert label("Item 1. Business", line) == ["Item 1", "Item 1"], line
    assert label("Dear shareholders", "BUSINESS", "We make software.", "Risk Factors", "MANAGEMENT’S DISCUSSION AND ANALYSIS OF FINANCIAL CONDITION") == ["Unknown", "Item 1", "Item 1", "Item 1", "Item 7"]


def test_segments(spark):
    page = ["We sold more than before in all of our regions. The following table shows it:", "Sales by region", "Region | 2020 | 2019", "North | 1 | 2", "Other regions", "South | 3 | 4", "A long text line follows here that goes on and on until it has more than twelve words."]
    rows_ = sections.label_lines(lines(spark, page))
    found = [(r.kind, r.run) for r in chunking.segments(rows_).orderBy("line_no").collect()]
    assert found == [("text", 1)] + [("table", 2)] * 5 + [("text", 3)]
    made = {r.chunk_id: r.text for r in chunking.chunk(rows_).collect()}
    table = "Table (Unknown): The following table shows it: Sales by region\n| Region | 2020 | 2019 |\n|---|---|---|\n| North | 1 | 2 |\n| Other regions |  |  |\n| South | 3 | 4 |"
    assert made["d_p1_c2"] == table and len(made) == 3


def test_chunks_against_brute_force():
    """Greedy packing, one sentence at a time: a chunk ends where the next sentence would pass TARGET; the next one begins with
    the longest tail of whole sentences within OVERLAP if that and the next sentence stay within CAP."""
    import random

    rng = random.Random(3)
    for _ in range(40):
        sizes = [rng.choice([3, 12, 30, 49, 120, 300, 380]) for _ in range(rng.randrange(1, 30))]
        sentences = [" ".join(f"W{i}" for _ in range(n - 1)) + f" w{i}." for i, n in enumerate(sizes)]
        chunks, held = [], []
        for i, n in enumerate(sizes):
            if held and sum(sizes[j] for j in held) + n > chunking.TARGET:
                chunks.append(held)
                tail = max((held[k:] for k in range(1, len(held) + 1) if sum(sizes[j] for j in held[k:]) <= chunking.OVERLAP), key=len)
                held = tail if sum(sizes[j] for j in tail) + n <= chunking.CAP else []
            held = [*held, i]
        chunks.append(held)
        assert [t for _, t in chunking.text_chunks([(1, x) for x in sentences])] == [" ".join(sentences[j] for j in c) for c in chunks]


def test_names(spark):
    long = "The Very Long Name Of A Company That Has Many Words"
    known = answer.aliases(spark.createDataFrame([("EL", "Estée Lauder Companies Inc."), ("LONG", long)], "ticker string, name string"))
    asked = spark.createDataFrame([(1, "What did Estee Lauder Companies earn?"), (2, f"How is {long} doing in 2020?")], "qid int, question string")
    assert rows(answer.resolve(asked, known), "qid", "ticker") == [(1, "EL"), (2, "LONG")]


def test_repeated_edges_and_cleaning(spark):
    doc = lines(spark, *[["ACME Report 2020", f"body {i}", "middle", f"other {'x' * i}", f"{i}"] for i in range(1, 7)])
    assert rows(sections.repeated_edges(doc), "norm", "pages") == [("#", 6), ("acme report #", 6), ("body #", 6)]
    left = [r.line for r in sections.clean_lines(doc).where("page = 2").orderBy("line_no").collect()]
    assert left == ["middle", "other xx"]
    assert sections.repeated_edges(lines(spark, ["a"], ["a"])).count() == 0


def test_report_range(spark):
    cover, end = "FORM 10-K\nSecurities and Exchange Commission\nWashington, D.C. 20549", "Pursuant to the requirements of Section 13 or 15(d)"
    pages = [("a", 1, cover), ("a", 2, "x"), ("a", 3, end), ("a", 4, "t\nF-1"), ("a", 5, "x"), ("a", 6, "F-2"), ("a", 20, "F-9"), ("b", 1, "letter"), ("b", 2, cover), ("b", 3, "x"), ("c", 1, "nothing")]
    found = rows(sections.report_range(spark.createDataFrame(pages, "doc_id string, page int, text string")), "doc_id", "doc_type", "first", "last")
    assert found == [("a", "10-K", 1, 6), ("b", "10-K_wrapped", 2, 3), ("c", "annual_report", None, None)]


def test_chunks(spark):
    sentence = " ".join(["word"] * 99) + " end."
    text = lambda n: [(1, sentence.capitalize()) for _ in range(n)]
    made = chunking.text_chunks(text(10))
    assert all(len(t.split()) <= chunking.CAP for _, t in made) and len(made) == 4
    long = chunking.text_chunks([(3, " ".join(f"w{i}" for i in range(1000)))])
    assert all(len(t.split()) <= chunking.TARGET for _, t in long) and long[1][1].split()[0] == "w330"
    table = [(1, "Sales by year"), (1, "Region | 2020 | 2019")] + [(i // 30 + 1, f"Row {i} | 1,{i:03} | 2,{i:03}") for i in range(90)]
    pieces = chunking.table_chunks(table, "Item 7")
    assert len(pieces) > 1 and all(p.startswith("Table (Item 7): Sales by year\n| Region | 2020 | 2019 |") for _, p in pieces) and all(len(p.split()) <= chunking.CAP for _, p in pieces)
    doc = lines(spark, ["one two three four five.", "A | 1 | 2", "B | 3 | 4", "no"]).withColumn("section", F.lit("Item 1"))
    assert [(r.chunk_id, r.content_type) for r in chunking.chunk(doc).collect()] == [("d_p1_c1", "text"), ("d_p1_c2", "table")]


def test_figures(spark):
    filings = [("a", "2020-12-31", 2020), ("a", "2019-12-31", 2019), ("b", "2020-01-31", 2019), ("b", None, 2018), ("c", None, 2020), ("d", "2020-06-01", 1999)]
    df = spark.createDataFrame(filings, "t string, e string, y int").withColumn("e", F.col("e").cast("date"))
    assert rows(figures.rule_for(df, "t", "e", "y"), "t", "rule", "assumed") == [("a", "end_year", False), ("b", "most_months", False), ("c", "end_year", True), ("d", None, False)]
    values = spark.createDataFrame([("A", "Ann", "USD", "Cash", 2022, 5.0), ("A", "Ann", "USD", "Revenue", 2022, 2e6)], "ticker string, company string, currency string, figure string, fiscal_year int, value double")
    hit = figures.snapshot_chunks(values, ["Revenue"]).first()
    assert (hit.chunk_id, hit.page, hit.text) == ("yahoo-A-2022", 0, "Revenue: 2,000,000 USD (about 2.0 million)\nCash: 5 USD")


def test_selection(spark):
    df = spark.createDataFrame([("a", 2019), ("a", 2020), ("b", 2019), ("b", 2019)], "c string, y int")
    assert rows(profile.complete(df, "c", "y", [2019, 2020]), "c") == [("a",)]
    assert rows(profile.missing_values(df, "c", "y", [2020, 2021]), "c", "missing") == [("a", "2021"), ("b", "2020,2021")]


def test_company_and_year(spark):
    known = answer.aliases(spark.createDataFrame([("AAPL", "Apple Inc."), ("MSFT", "The Microsoft Corporation")], "ticker string, name string"))
    asked = ["Revenue of Apple in 2020?", "apple or Microsoft corporation", "AAPL in 2019 and 2020", "aapl pineapple", "$MSFT"]
    found = {r.qid: r for r in answer.resolve(spark.createDataFrame(list(enumerate(asked)), "qid int, question string"), known).collect()}
    assert [(found[i].ticker, found[i].fiscal_year, found[i].ambiguous_company, found[i].ambiguous_year) for i in range(5)] == [
        ("AAPL", 2020, False, False), (None, None, True, False), ("AAPL", None, False, True), (None, None, False, False), ("MSFT", None, False, False)
    ]


def test_answer_text_at_every_cut(spark):
    whole = json.dumps({"meta": {"answer": "no"}, "answer": 'He said "é🎉\\" and\nleft', "sources": ["answer"]})
    want = json.loads(whole)["answer"]
    for cut in range(len(whole) + 1):
        reader = AnswerText()
        assert reader.feed(whole[:cut]) + reader.feed(whole[cut:]) == want
    reader = AnswerText()
    assert "".join(reader.feed(c) for c in whole) == want


def test_streamed_answers(spark, tmp_path):
    whole = json.dumps({"answer": "one two three"})
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, i, c) for i, c in enumerate(whole)], "reply_id long, seq long, piece string").coalesce(1).write.parquet(src)
    stream = answer_tokens(spark.readStream.schema("reply_id long, seq long, piece string").parquet(src))
    q = stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert "".join(r.text for r in spark.table("answers").collect()) == "one two three"


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (1, 4, 9, "c")], "k int, ts int, id int, v string")
    assert rows(latest(df, "k", ["ts", "id"]), "k", "v") == [(1, "b")]


def test_sources(spark, tmp_path):
    keys = [("acme/NYSE_ACM_2020.pdf", 1048576), ("acme/NYSE_ACM_2020_abcdef12.pdf", 1), ("odd.txt", 1), (None, 1)]
    good, bad = files.parse_listing(spark.createDataFrame(keys, "key string, bytes long"))
    assert rows(files.one_per_year(good), "company", "ticker", "fiscal_year", "size_mb", "has_hash_suffix") == [("acme", "ACM", 2020, 1.0, False)] and bad.count() == 2
    assert rows(files.missing_files(good.select("company").distinct(), [2019, 2020], good), "fiscal_year") == [(2019,)]
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "Q1"}, {"id": "Q2"}]}))
    (tmp_path / "r.json").write_text(json.dumps([{"id": "Q3"}]))
    assert rows(files.read_records(spark, str(tmp_path / "*.json"), "id:string"), "id") == [("Q1",), ("Q2",), ("Q3",)]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a.pdf").write_bytes(b"one\ntwo\x0cthree")
    (tmp_path / "bin" / "b.pdf").write_bytes(b"\xff")
    parsed = files.read_lines(spark, str(tmp_path / "bin"), lambda b: [p.split("\n") for p in b.decode().split("\x0c")])
    assert sorted((r.page, r.line) for r in parsed.where("error is null").collect()) == [(1, "one"), (1, "two"), (2, "three")] and parsed.where("error is not null").count() == 1
    inventory = spark.createDataFrame([("x.pdf", "ZZ", 2021)], "file string, ticker string, fiscal_year int")
    named = files.with_metadata(spark.createDataFrame([("x.pdf",), ("AB_2020.pdf",), ("none.pdf",)], "file string"), inventory)
    assert rows(named.fillna("-"), "file", "doc_id") == [("AB_2020.pdf", "AB_2020_10K"), ("none.pdf", "-"), ("x.pdf", "ZZ_2021_10K")]


def test_table_rows_are_those_of_the_sql(spark, tmp_path):
    """Figures between bars in a document; items with missing, negative and large values."""
    import duckdb

    from folio.plans import documents

    docs = [(1, "Net income | 55,256 | 59,531\nCosts | 12 | —\nplain | 4026083977531332 | word"), (2, ""), (3, None)]
    items = [(1, 1, 155, 17.0, "A"), (1, 2, 155, 17.0, "A"), (2, 2, None, 17.0, "R"), (3, 2, -12, 17.0, "N"), (4, 2, 7, None, "N"), (5, 2, 7, 3e10, "N"), (6, 2, 7, -4.0, None), (6, 3, 7, 1.0, None), (7, None, 7, 1.0, "A")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for name in ("documents", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = [tuple(r) for r in documents.table_row_detect(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(db.execute(SQL["table_row_detect"]).fetchall(), key=repr)
