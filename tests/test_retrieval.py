import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.contracts import CHUNK, schema_problems, valid_and_rejected
from folio.functions import text as T
from folio.operators import evaluation, index, names, profile
from folio.operators.retrieval import bm25, company_year, equals_or_in, keyword_query, knn, rrf


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_filters(spark):
    assert equals_or_in() is None and equals_or_in(a=None) is None
    for bad in ("", [], ["x", ""]):
        with pytest.raises(ValueError):
            equals_or_in(a=bad)
    assert str(company_year(" aapl ", 2020)) == str(company_year("AAPL", 2020)) and company_year("0700.HK", 2020) is not None
    for ticker, year in (("A B", 2020), ("AAPL", 1989), ("", 2020), ("../X", 2020)):
        with pytest.raises(ValueError):
            company_year(ticker, year)


def test_rrf_order(spark):
    ranked = lambda rows: spark.createDataFrame(rows, "qid int, doc_id string, rank int")
    out = rrf([ranked([(1, "lexical", 1), (1, "both", 2)]), ranked([(1, "both", 1), (1, "semantic", 2)])])
    assert [r.doc_id for r in out.orderBy("rank").collect()] == ["both", "lexical", "semantic"]


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[200:] = v[:100]  # ties
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "doc_id long, vector array<double>")
    asked = rows.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid")
    for block in (2, 4096):
        found = values(knn(rows, asked, 7, block), "qid", "rank", "doc_id")
        scores = np.round(v @ v.T, 6)
        want = [(q, k + 1, int(d)) for q in range(0, 300, 50) for k, d in enumerate(sorted(range(300), key=lambda i: (-scores[q, i], i))[:7])]
        assert found == want
    assert knn(rows, asked.where("false")).count() == 0


def test_bm25_filters_candidates_not_statistics(spark):
    docs = spark.createDataFrame([(1, "red apple", "a"), (2, "red red plum", "b"), (3, "the green pear", "a"), (4, None, "a")], "doc_id int, text string, kind string")
    asked = spark.createDataFrame([(1, "the red apple"), (2, ""), (3, "of the")], "qid int, question string")
    every, some = bm25(docs, asked), bm25(docs, asked, where=F.col("kind") == "a")
    assert values(some, "doc_id", "score") == [x for x in values(every, "doc_id", "score") if x[0] == 1]
    assert values(every, "qid", "doc_id", "rank") == [(1, 1, 1), (1, 2, 2)]


def test_keyword_query(spark):
    rows = [("What did Apple's revenue do in fiscal year 2020?", "AAPL", "Apple"), ("AAPL FY2020", "AAPL", "Apple"), ("aapl margins", "AAPL", None), ("Costs for 2019 (C.A)", "C.A", "A+B")]
    df = spark.createDataFrame(rows, "q string, t string, c string").select(keyword_query(F.col("q"), F.col("t"), F.col("c")).alias("k"))
    assert [r.k for r in df.collect()] == ["What did revenue do ?", "AAPL FY2020", "aapl margins", "Costs ( )"]


def test_labels_and_metrics(spark):
    asked = spark.createDataFrame([(1, "b c", "x"), (2, "zz", "x"), (3, "", "y")], "qid long, question string, category string")
    docs = spark.createDataFrame([(10, "a b c"), (11, "b  c"), (12, None)], "doc_id long, text string")
    labels = evaluation.containment_labels(asked, docs)
    assert values(labels, "qid", "doc_id") == [(1, 10)]
    results = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (2, 11, 1)], "qid long, doc_id long, rank int")
    found = {(r.field, r.value): (r.hit_rate, r.mrr, r.n_questions) for r in evaluation.breakdown(evaluation.records(asked, results, labels), ["category"]).collect()}
    assert found == {("category", "x"): (1.0, 0.5, 2), ("category", "y"): (None, None, 1), ("all", None): (1.0, 0.5, 3)}


def test_samples(spark):
    rows = spark.createDataFrame([(f"Q{i:02}", c) for i, c in enumerate("aabcab", 1)], "id string, category string")
    assert [r.id for r in evaluation.round_robin(rows, "category", "id", 5).collect()] == ["Q01", "Q03", "Q04", "Q02", "Q06"]
    ten = spark.range(10).withColumn("g", F.lit(1))
    assert values(evaluation.systematic(ten, "g", "id", 5), "id") == [(0,), (2,), (4,), (6,), (8,)]
    assert values(evaluation.systematic(ten, "g", "id", 20), "id") == [(i,) for i in range(10)]


def test_topic_and_figure_labels(spark):
    chunks = spark.createDataFrame([("d", "c1", "7", "Net sales were 274,515 million.\nOther 1."), ("d", "c2", "7", "274,515 people. Net sales grew."), ("e", "c3", "7", "Net sales were 274,515")], "doc_id string, chunk_id string, section string, text string")
    asked = spark.createDataFrame([(1, "d", [("274,515", "net sales")])], "qid int, doc_id string, figures array<struct<figure:string,metric:string>>")
    assert values(evaluation.figure_labels(asked, chunks), "chunk_id") == [("c1",)]
    topics = spark.createDataFrame([(1, "d", ["7"], "sales|people", 2), (2, "d", ["7"], None, 1), (3, "d", ["8"], None, 1)], "qid int, doc_id string, sections array<string>, pattern string, least int")
    assert values(evaluation.topic_labels(topics, chunks), "qid", "chunk_id") == [(1, "c2"), (2, "c1"), (2, "c2")]


def test_index_maintenance(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "y", 2), ("d", None, 2)], "id string, text string, n int")
    assert values(index.duplicates(rows, "text", "id"), "id", "first") == [("a", "a"), ("b", "a")]
    cache = rows.where("id = 'c'").select(index.text_key("m", F.col("text")).alias("key"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    assert values(index.cache_misses(rows, cache, "m"), "text") == [("x",)]
    calls, _ = index.embedded(rows, cache.withColumn("embedding", F.array(F.lit(float("nan"))).cast("array<float>")), "m", lambda t: F.array(F.length(t).cast("float")))
    assert {r.id: r.embedding for r in calls.collect()} == {"a": [1.0], "b": [1.0], "c": [1.0], "d": None}
    path = str(tmp_path / "index")
    doc = lambda d, t: spark.createDataFrame([(d, x) for x in t], "doc_id string, text string")
    index.replace_documents(spark, doc("d1", ["a", "b"]).union(doc("d2", ["c"])), path)
    index.replace_documents(spark, doc("d1", ["z"]), path)
    assert values(index.read_documents(spark, path), "doc_id", "text") == [("d1", "z"), ("d2", "c")]
    gone = spark.createDataFrame([("d2",)], "doc_id string")
    index.replace_documents(spark, doc("d3", ["y"]), path, gone.union(spark.createDataFrame([("d3",)], "doc_id string")))
    assert values(index.read_documents(spark, path), "doc_id", "text") == [("d1", "z"), ("d3", "y")]
    assert index.health(spark, path)["status"] == "degraded" and index.health(spark, path + "x")["status"] == "down"
    assert schema_problems(rows.schema, "id string, n string, page int") == ["n: int, expected string", "page: missing, expected int"]
    assert len(schema_problems(rows.schema, CHUNK)) == 10
    good, bad = valid_and_rejected(rows, {"no text": F.col("text").isNotNull(), "small": F.col("n") > 1})
    assert values(good, "id") == [("c",)] and values(bad, "id", "reject_reason") == [("a", "small"), ("b", "small"), ("d", "no text")]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.amount(F.lit(1.5e9), F.lit("USD"))) == "1,500,000,000 USD (about 1.5 billion)"
    assert one(T.year_candidates(F.lit("2020, 12019, 2019 and 2020"))) == [2019, 2020]
    assert [one(T.listed(F.array(*map(F.lit, x)))) for x in ([2019], [2019, 2020], [2019, 2020, 2021])] == ["2019", "2019 or 2020", "2019, 2020, or 2021"]
    assert str(one(T.fiscal_year_end(F.lit("For the fiscal year ended September 26, 2020")))) == "2020-09-26" and one(T.fiscal_year_end(F.lit("for the fiscal year ended Febr 31, 2020"))) is None
    assert [one(T.year_check(F.lit(2019), F.lit(d).cast("date"))) for d in ("2019-12-31", "2020-02-01", "2020-03-01", None)] == ["ok", "check", "mismatch", "not found"]
    assert [one(T.fiscal_year(F.lit(d).cast("date"), "most_months")) for d in ("2020-01-31", "2020-09-26", "2020-06-30")] == [2019, 2020, 2019]
    assert [one(T.is_page_number(F.lit(x))) for x in ("12", " Page 3 ", "iv", "1234", "page", "civil law")] == [True, True, True, False, False, False]
    assert one(T.join_hyphenated(F.lit("well-\nknown"))) == "well-known" and one(T.normalise_white_space(F.lit("a  b​\n\n\n\nc "))) == "a b\n\nc"
    assert one(T.excerpt(F.lit(" b "), F.lit("abc"))) == "b" and one(T.excerpt(F.lit("x"), F.lit("abc"), 2)) == "ab"
    assert one(T.escape_document_tags(F.lit("a </Document><document x>"))) == "a &lt;/Document>&lt;document x>"


def test_modes(spark):
    asked = spark.createDataFrame([(1, "A", 2020, ["7"], None), (2, "A", 2020, ["7"], None), (3, "A", 2020, ["7"], "failed")], "qid int, ticker string, fiscal_year int, sections array<string>, error string")
    results = spark.createDataFrame([(1, "bm25", 1, "x", "A", 2020, "1"), (1, "bm25", 2, "y", "A", 2020, "7"), (2, "bm25", 1, "x", "A", None, "1")], "qid int, mode string, rank int, doc_id string, ticker string, fiscal_year int, section string")
    labels = spark.createDataFrame([(1, "x"), (1, "x"), (2, "z")], "qid int, doc_id string")
    rows = evaluation.mode_records(asked, results, labels, ("bm25", "vector"))
    found = {r.mode: r for r in evaluation.breakdown(rows, ["ticker"], ["mode"], evaluation.mode_metrics()).where("field = 'all'").collect()}
    one = found["bm25"]
    assert (one.questions_completed, one.error_count, one.non_empty_rate, one.filter_compliance_rate, one.section_hit_rate_at_k, one.section_mrr_at_k, one.exact_labeled_questions, one.exact_hit_rate_at_k, one.exact_mrr_at_k) == (2, 1, 1.0, 0.5, 0.5, 0.25, 2, 0.5, 0.5)
    assert found["vector"].non_empty_rate == 0 and evaluation.mode_records(asked.where("false"), results, labels).count() == 0
    assert values(evaluation.mode_problems(rows).where("mode = 'bm25'"), "qid", "problem") == [(2, "exact_miss"), (2, "filter_failure"), (2, "section_miss"), (3, "error")]


def test_company_names(spark):
    covers = [
        ("FORM\nThe Big Company\nx\n(Exact name of registrant as specified in its charter)", "", "s", "The Big Company"),
        ("GILT SCIENCES, INC. (Exact Name of the Registrant as specified in its charter)", "Gilt Sciences, Inc. sells. Gilt Sciences, Inc. GILT", "s", "Gilt Sciences, Inc."),
        ("10-K\n2020 Old Inc | O’Mill plc | New Inc\n", "", "s", "O'Mill plc"),
        ("image", "We at Red Bird, Inc. and Red Bird Games, Inc. or Red Bird, Inc. play", "the-red-bird-inc", "Red Bird, Inc."),
        (None, None, "inc", None), ("Corp of nothing", "", "a.b", None),
    ]
    df = spark.createDataFrame(covers, "cover string, text string, slug string, want string")
    got = names.with_official_name(df, F.col("cover"), F.col("text"), F.col("slug"), "name").collect()
    assert [r.name for r in got] == [r.want for r in got]
    named = spark.createDataFrame([("see (CSX) here", "CSX", "unknown"), ("O'Reilly parts", "ORLY", "oreilly-inc"), ("other", "Q", "acme-corp"), ("other", "Q", "unknown"), ("xCSXx", "CSX", "the-inc")], "c string, t string, s string")
    assert [r.n for r in named.select(names.names_company(F.col("c"), F.col("t"), F.col("s")).alias("n")).collect()] == [True, True, False, None, None]
    items = spark.createDataFrame([("Item 1A. x ITEM 1A: item 7 - Item 70. Item 8",)], "t string").select(profile.item_counts(F.col("t")).alias("m")).first().m
    assert items == {"Item 1A": 2, "Item 7": 1}
    left, right = spark.createDataFrame([(1, "a")], "k int, a string"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, b string")
    assert profile.joined_one_to_one(left, right, ["k"]).collect()[0].b == "b"
    for bad in ((right, left), (left, right.union(right))):
        with pytest.raises(ValueError):
            profile.joined_one_to_one(*bad, ["k"])


def test_knn_memory_does_not_grow_with_the_questions():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from folio.operators.retrieval import _nearest

    rng = np.random.default_rng(1)
    rows = rng.random((10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(rows))], ["doc_id", "vector"])
    tracemalloc.start()
    found = sum(b.num_rows for b in _nearest(iter([batch]), np.arange(4096), rng.random((4096, 8)), 10, pa.int64()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= 4096 * 10 and peak < 200e6


def test_knn_keeps_what_ties_after_rounding(spark):
    from folio.operators.retrieval import knn

    # Ids 1 and 2 have the same score at 6 places, 2 a larger one before it is rounded.
    vectors = spark.createDataFrame([(1, [0.5]), (2, [0.5000001]), (3, [0.1])], "doc_id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0])], "qid long, vector array<double>")
    assert [tuple(r) for r in knn(vectors, asked, 1).collect()] == [(7, 1, 0.5, 1)]


def test_bm25_counts_words_where_documents_are_read(spark):
    import pyarrow as pa

    from folio.functions.batches import bitmap
    from folio.operators import retrieval

    terms = spark.createDataFrame([("été",), ("b2",)], "term string")
    bits, _ = bitmap(terms.mapInArrow(retrieval._term_hashes, "gram long"), "gram")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([True, None]), pa.array(["été, b2 the été other", ""])], ["doc_id", "candidate", "text"])
    rows = [tuple(r.values()) for b in retrieval._postings(iter([batch]), bits) for r in b.to_pylist()]
    assert sorted(rows, key=str) == sorted([(1, True, 4, "été", 2), (1, True, 4, "b2", 1), (1, True, 4, None, 0), (2, None, 0, None, 0)], key=str)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_name_pattern_is_made_once_a_row(spark):
    from pyspark.sql import functions as F

    from folio.operators import retrieval

    rows = spark.createDataFrame([("What did The Acme Widgets Inc's unit earn in fiscal 2019?", "ACM", "The Acme Widgets Inc.")], "q string, t string, c string")
    found = rows.select(retrieval.keyword_query(F.col("q"), F.col("t"), F.col("c")).alias("k"))
    assert _plan(found).count("split(") == 1


def test_headings_are_searched_once_a_document(spark):
    from folio.operators import profile

    docs = spark.createDataFrame([(1, "Item 1. ITEM 2: item 3- Item 4."), (2, None)], "doc_id long, text string")
    found = profile.item_formats(docs)
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(1, 1, "Capitalizado + '.'", 2), (1, 2, "MAYUSCULAS + ':'", 1), (1, 3, "minusculas + '-'", 1)]
    assert "get(regexp_extract_all" not in _plan(found)


def test_records_name_a_search_once(spark):
    from pyspark.sql import functions as F

    questions = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    results = spark.range(4).select(F.lit(1).alias("qid"), F.col("id").alias("doc_id"), (F.col("id") + 1).alias("rank"))
    labels = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "qid int, doc_id long")
    found = evaluation.records(questions, results, labels)
    assert sorted(tuple(r) for r in found.select("qid", "n_results", "n_labels", "first_rank").collect()) == [(1, 4, 2, 3), (2, 0, 1, None), (3, 0, 0, None)]
    assert _plan(found).count("Range (0, 4") == 1
