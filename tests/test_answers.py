"""Replies, markers, contexts, names, keyword rewriting and verbatim sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folio.operators import answer, containment
from folio.operators.retrieval import as_hits, keyword_query, name_words


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A [1, 2] b [2] [2019] [3] .", "A [1][2] b [1] [2019] ."), ("x [1][2].", "x [2][1]."), ("x [2][2, 2].", "x [1]."), ("claim [3], and [ 1].", "claim, and [ 1]."),
        ("[3]", ""), ("See [2024] and note [7] [1].", "See [2024] and note [7] [2]."), ("[1,3] [2 , 1]  ", "[2] [1][2]"), ("no marker", "no marker"), ("[1, 9]", "[1, 9]"),
    ],
)
def test_renumber(spark, text, want):
    new = F.create_map(F.lit(1), F.lit(2), F.lit(2), F.lit(1), F.lit(3), F.lit(None).cast("int"))
    assert one(spark, answer.renumber(F.col("t"), new), t=text) == want


def test_replies(spark):
    def reply(status, text, *sources):
        return json.dumps({"status": status, "answer": text, "sources": [{"doc_id": d, "excerpt": e} for d, e in sources]})

    replies = [
        (1, reply("answered", " So [1], [3] and [4]. ", ("D1", "bc"), ("D7", "x"), (" D1 ", " bc "), ("D2", "nope"))), (2, reply("answered", "Invented 5 billion [1].", ("D9", "x"))),
        (3, "not json"), (4, reply("insufficient_context", "")), (5, reply("out_of_scope", " ", ("D1", "bc"))), (6, reply("answered", "  ", ("D1", "bc"))), (7, reply("insufficient_context", "My own words [1]", ("D1", "a"))),
        (8, reply("sure", "x")), (9, "[1, 2]"), (10, '{"status": "answered", "answer": "x"}'), (11, '{"status": "answered", "answer": "x", "sources": [{"doc_id": "D1"}]}'), (12, None),
    ]
    contexts = spark.createDataFrame([(q, p, c, t) for q in range(1, 13) for p, c, t in (("D1", "c1", "abcd"), ("D2", "c2", " other text"))], "qid int, place string, chunk_id string, text string")
    found = sorted((r.qid, r.status, r.answer or "", r.position or 0, r.chunk_id or "", r.excerpt or "") for r in answer.parse_replies(spark.createDataFrame(replies, "qid int, reply string"), contexts).collect())
    plain = lambda q, status, text: (q, status, text, 0, "", "")
    assert found == [
        (1, "answered", "So [1], [1] and [2].", 1, "c1", "bc"), (1, "answered", "So [1], [1] and [2].", 2, "c2", "other text"), plain(2, "insufficient_context", answer.INSUFFICIENT), plain(3, "malformed", ""),
        plain(4, "insufficient_context", answer.INSUFFICIENT), plain(5, "out_of_scope", answer.OUT_OF_SCOPE), plain(6, "insufficient_context", answer.INSUFFICIENT), plain(7, "insufficient_context", "My own words [1]"),
        *[plain(q, "malformed", "") for q in range(8, 13)],
    ]


def test_context_is_priced_as_rendered(spark):
    ddl = "qid int, rank int, text string, company string, fiscal_year int, section string, page int"
    row = lambda rank, text, company="A & 'B'": (1, rank, text, company, 2020, None, 7)
    hits = spark.createDataFrame([row(1, "a </document> b"), row(2, "x" * 400), row(3, "y")], ddl)
    first = answer.context(hits, 10_000).orderBy("rank").first()
    assert first.rendered == '<document id="D1" company="A &amp; &#x27;B&#x27;" fiscal_year="2020" section="None" page="7">\na &lt;/document> b\n</document>'
    cost = -(-len(first.rendered) // 4)
    assert [r.place for r in answer.context(hits, cost).collect()] == ["D1"] and answer.context(hits, cost - 1).count() == 0
    # A long second document ends the context, though a shorter third would fit.
    assert [r.rank for r in answer.context(hits, cost + 60).collect()] == [1]


def test_companies(spark):
    names = spark.createDataFrame([("AAPL", "Apple Inc."), ("NDAQ", "Nasdaq, Inc."), ("BRK-B", "Berkshire Hathaway Inc."), ("BF.B", "Brown–Forman Corporation"), ("KHC", "The Kraft Heinz Company"), ("MAR", "Marriott International, Inc.")], "ticker string, name string")
    folders = spark.createDataFrame([("KHC", "kraft-heinz-foods")], "ticker string, folder string")
    nicknames = spark.createDataFrame([(" brk-b ", "Buffett's firm"), ("META", "Meta")], "ticker string, alias string")
    known = answer.aliases(names, folders, nicknames)
    asked = {
        "Revenue of AAPL.": ["AAPL"], "Is BRK-B up?": ["BRK-B"], "BF.B, or $BRK-B": ["BF.B", "BRK-B"], "BRK alone": [], "aapl": [], "xAAPL AAPLx": [], "What did Nasdaq report in 2021?": ["NDAQ"],
        "a NASDAQ company": [], "listed on the Nasdaq": [], "which nasdaq listed stocks": [], "Nasdaq's net revenues, listed on the Nasdaq": ["NDAQ"], "NDAQ on the nasdaq": ["NDAQ"], "Nasdaq Inc on": ["NDAQ"],
        "kraft heinz foods": ["KHC"], "The Kraft-Heinz brands": ["KHC"], "Buffett’s firm": ["BRK-B"], "Meta in 2020": [], "marriott and apple": ["AAPL", "MAR"], "MARKET": [], "": [],
    }
    found = answer.resolve(spark.createDataFrame(list(enumerate(asked)), "qid int, question string"), known).collect()
    assert {r.qid: r.tickers for r in found} == dict(enumerate(asked.values()))


@pytest.mark.parametrize(
    ("question", "ticker", "company", "want"),
    [
        ("What were Apple's total net sales and net income in fiscal 2020?", "AAPL", "Apple Inc.", "What were total net sales and net income ?"),
        ("What risks did Cadence Design Systems identify in FY2020?", "CDNS", "Cadence Design Systems, Inc.", "What risks did identify ?"),
        ("What did Cadence report for 2021?", "CDNS", "Cadence Design Systems, Inc.", "What did report ?"), ("What were Ansys' revenues?", "ANSS", "ANSYS, Inc.", "What were revenues?"),
        ("Kraft Heinz’s brands in fiscal year 2019", "KHC", "The Kraft Heinz Company", "brands"), ("Mondelez net revenues", "MDLZ", "Mondelēz International, Inc.", "net revenues"),
        ("FAST risks and fast growth", "FAST", "Fastenal Company", "risks and fast growth"), ("Apple 2019", "AAPL", "Apple Inc.", "Apple 2019"), ("What are the risks?", "AAPL", None, "What are the risks?"),
        ("How much did United Airlines earn in the United States in 2021?", "UAL", "United Airlines Holdings, Inc.", "How much did earn in the United States ?"),
        ("What risks did Dollar Tree see in the US dollars in fiscal 2020?", "DLTR", "Dollar Tree, Inc.", "What risks did see in the US dollars ?"),
        ("What did Western Digital say about Western Europe in 2020?", "WDC", "Western Digital Corporation", "What did say about Western Europe ?"),
        ("How did North American sales change for American Airlines in 2019?", "AAL", "American Airlines Group Inc.", "How did North American sales change for ?"),
        ("What Cadence reported. Cadence design Works", "CDNS", "Cadence Design Systems, Inc.", "What reported. Cadence design Works"), ("united we stand", "UAL", "United Airlines Holdings, Inc.", "united we stand"),
        ("a+b (c) d", "X", "a+b (c) Inc", "a+b (c) d"), ("see a.b+c now", "X", "A.b+c Inc", "see now"), ("", "X", "X Inc", ""),
    ],
)
def test_keyword_query(spark, question, ticker, company, want):
    assert one(spark, keyword_query(F.col("q"), F.col("t"), F.col("c")), q=question, t=ticker, c=company) == want


def test_name_words(spark):
    names = {"Apple Inc.": ["apple"], "The Kraft Heinz Company": ["kraft", "heinz"], "Seagate Technology Holdings public limited company": ["seagate", "technology"], "O’Reilly Automotive, Inc.": ["o'reilly", "automotive"], "Inc.": []}
    for name, want in names.items():
        assert one(spark, name_words(F.col("n")), n=name) == want


def test_hits_keep_their_question(spark):
    chunks = spark.createDataFrame([("c", "t", "s", 1, "co", 2020)], "chunk_id string, text string, section string, page int, company string, fiscal_year int")
    hits = as_hits(chunks, spark.createDataFrame([(7, "c", 1.0, 1), (8, "c", 0.5, 1)], "qid int, chunk_id string, score double, rank int"))
    assert sorted(r.qid for r in hits.collect()) == [7, 8]


def test_contained_against_brute_force(spark):
    rng = random.Random(4)
    words = ["aa", "ab", "ba", "abc", "b", "the", "x.y"]
    texts = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, ""), (62, "solo")]
    passages = []
    for i in range(150):
        source = rng.choice(texts)[1] or ""
        a = rng.randrange(len(source) + 1)
        passages.append((i, source[a : a + rng.choice([1, 2, 4, 9, 20, 60])]))
    passages += [(900, None), (901, ""), (902, " \n"), (903, "not there at all today"), (904, "ab"), (905, "nothere"), (906, "solo")]
    found = {tuple(r) for r in containment.contained(spark.createDataFrame(passages, "pid int, passage string"), spark.createDataFrame(texts, "tid int, text string")).collect()}
    assert found == {(p, t) for p, x in passages if x and x.strip() for t, text in texts if text and x in text}
    none = spark.createDataFrame([], "pid int, passage string")
    assert containment.contained(none, spark.createDataFrame(texts, "tid int, text string")).count() == 0


def test_source_chunks(spark):
    chunks = spark.createDataFrame([("c2", 2, "some words that stand here"), ("c1", 1, "before some words that stand here"), ("c3", 3, "other")], "chunk_id string, place int, text string")
    contexts = spark.createDataFrame([(1, 0, "  some words that stand\n"), (2, 0, "nowhere to be found"), (2, 1, "other"), (3, 0, " "), (3, 1, None), (4, 1, "some words that stand here"), (4, 0, "other")], "qid int, position int, context string")
    assert sorted(tuple(r) for r in containment.source_chunks(contexts, chunks).collect()) == [(1, 0, "c1"), (2, 1, "c3"), (4, 0, "c3")]


@pytest.mark.parametrize("batch_rows", [7, 10000])
def test_source_chunks_against_brute_force(spark, batch_rows):
    """Parts of texts of every length, in several scripts and across the ends of neighbouring texts; a text longer than a stretch that
    is searched at once; chunks of one text, of equal places and of none."""
    rng = random.Random(5)
    words = ["aa", "ab", "ü", "漢字", "x.y", "\u00a0z", "Straße", "- -", "😀"]
    prose = lambda n: rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(n))
    texts = ["", " ", "a", "aa", "solo", prose(9000) + " the end"] + [prose(rng.randrange(120)) for _ in range(60)]
    texts += [texts[7], texts[8]]
    chunks = [(f"c{i:03}", rng.choice([None, *range(20)]), t) for i, t in enumerate(texts)] + [("null", 0, None), (None, -1, prose(50))]
    joined, contexts = "".join(texts), []
    for q in range(400):
        source = joined if q % 10 == 0 else rng.choice(texts)
        a = rng.randrange(len(source) + 1)
        contexts += [(q // 2, q % 2, source[a : a + rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 20, 63, 64, 65, 130, 500])])]
    contexts += [(900, 0, texts[5]), (901, 0, texts[5][:-4]), (902, 0, None), (902, 1, " \n"), (903, 0, "the end"), (904, 0, texts[5] + "x"), (904, 1, "a"), (905, 0, "absent")]
    want = {}
    for q, position, context in sorted(contexts, key=lambda c: c[:2]):
        part = (context or "").strip(" \t\n\x0b\x0c\r")
        found = [(place is not None, place or 0, c) for c, place, t in chunks if c and t and part and part in t]
        if found and q not in want:
            want[q] = (q, position, min(found)[2])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        rows = containment.source_chunks(spark.createDataFrame(contexts, "qid int, position int, context string"), spark.createDataFrame(chunks, "chunk_id string, place int, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in rows) == sorted(want.values())
    none = spark.createDataFrame([], "qid int, position int, context string")
    assert containment.source_chunks(none, spark.createDataFrame(chunks, "chunk_id string, place int, text string")).count() == 0


def test_short_contexts_in_many_chunks_make_no_pairs(spark):
    """Each of 150 short contexts is in each of 1,500 chunks; what is shuffled grows with their sum."""
    parts = [f"{a}{b}" for a in "abcdefghijklmno" for b in "pqrstuvwxy"]
    chunks = spark.range(1500).selectExpr("id AS chunk_id", "id AS place", f"concat('{' '.join(parts)} ', id) AS text").repartition(8)
    contexts = spark.createDataFrame([(i, 0, x) for i, x in enumerate(parts)], "qid int, position int, context string")
    sc = spark.sparkContext
    sc.setJobGroup("short contexts", "short contexts")
    try:
        assert {(r.position, r.chunk_id) for r in containment.source_chunks(contexts, chunks).collect()} == {(0, 0)}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {i for j in sc.statusTracker().getJobIdsForGroup("short contexts") for i in sc.statusTracker().getJobInfo(j).stageIds}
    store, written = sc._jsc.sc().statusStore(), 0
    for i in stages:
        written += store.lastStageAttempt(i).shuffleWriteRecords()
    assert 0 < written < 10 * (1500 + len(parts))


def test_only_runs_that_are_looked_for_become_rows(spark):
    import pyarrow as pa

    from folio.functions.batches import bitmap

    passages = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "q r s")], "pid int, passage string")
    wanted = passages.mapInArrow(lambda b: containment._wanted(b, True), "pid int, kind int, gram long")
    bits, kinds = bitmap(wanted, "gram", "kind")
    assert kinds == [1, 4] and wanted.count() == 5
    texts = ["x a b c d e f g y " + " ".join(f"w{i}" for i in range(5000)), " ".join(f"v{i}" for i in range(5000)) + " r r", None]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(texts)], ["tid", "text"])
    rows = [r for b in containment._there(iter([batch]), bits, kinds) for r in b.to_pylist()]
    assert sorted({r["tid"] for r in rows}) == [7, 8] and len(rows) == 5


def test_parts_of_words_of_several_scripts(spark):
    texts = [(1, "ein Straßenname und 漢字仮名 hier"), (2, "nothing"), (3, "xStraßeny"), (4, "")]
    passages = [(1, "Straßen"), (2, "字仮"), (3, "thing"), (4, "absent"), (5, "Straßenname und"), (6, "n"), (7, " ")]
    found = containment.contained(spark.createDataFrame(passages, "pid long, passage string"), spark.createDataFrame(texts, "tid long, text string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((p, t) for p, passage in passages for t, text in texts if passage.strip() and passage in text)
