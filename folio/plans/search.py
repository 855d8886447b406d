"""Filters, retrieval, evaluation and index maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import schema_diff
from ..functions.text import STOP_WORDS
from ..operators import containment, evaluation, index
from ..operators.retrieval import as_hits, bm25, equals_or_in, hashed_bag, hybrid, keyword_query, knn, rrf
from . import query, table

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def words_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({STOPS}))"


def bm25_sql(k: int, where: str = "true") -> str:
    return f"""
d AS (SELECT doc_id, ({where}) AS candidate, {words_sql('text')} AS w FROM documents),
p AS (SELECT doc_id, candidate, len(w) AS dl, unnest(w) AS term FROM d),
tf AS (SELECT doc_id, candidate, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
c AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM d),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({words_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT qid, doc_id, round(sum(qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), c WHERE candidate GROUP BY qid, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= {k})"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src1'")
def doc_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(equals_or_in(lang="en", source="src1")).select("doc_id", "lang", "source", "n_chars")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT'")
def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = equals_or_in(o_orderstatus=["F", "P"], o_orderpriority="1-URGENT")
    return table(spark, sf_dir, "orders").where(wanted).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""WITH """ + bm25_sql(5) + """ SELECT CAST(doc_id AS VARCHAR) AS chunk_id, sha256(text) AS text, score, source AS section, 1 AS page, lang AS company, 2000 + n_chars % 20 AS fiscal_year, CAST(rank AS BIGINT) AS rank
FROM bm JOIN documents USING (doc_id)""")
def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("section"), F.lit(1).alias("page"), F.col("lang").alias("company"), (2000 + F.col("n_chars") % 20).alias("fiscal_year"))
    ranked = bm25(docs, questions(spark, sf_dir), 5).select(F.col("doc_id").cast("string").alias("chunk_id"), "score", F.col("rank").cast("long").alias("rank"))
    return as_hits(chunks, ranked).withColumn("text", F.sha2("text", 256))


@query("WITH " + bm25_sql(20) + " SELECT qid, doc_id, score, CAST(rank AS BIGINT) AS rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 20)
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("WITH " + bm25_sql(20, "lang = 'en'") + " SELECT qid, doc_id, score, CAST(rank AS BIGINT) AS rank FROM bm")
def bm25_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bm25(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 20, F.col("lang") == "en")
    return out.withColumn("rank", F.col("rank").cast("long"))


KNN = """
WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {where}),
s AS (SELECT qid, doc_id, round(list_dot_product(q.e, v.e), 6) AS score FROM q, v)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"), rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


@query(KNN.format(where="true"))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(*_vectors(spark, sf_dir), 10).withColumn("rank", F.col("rank").cast("long"))


@query(KNN.format(where="label = 3"))
def knn_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return knn(vectors.where("label = 3"), asked, 10).withColumn("rank", F.col("rank").cast("long"))


RRF_SQL = """
r AS (SELECT qid, doc_id, rank, 0 AS list FROM bm UNION ALL SELECT qid, doc_id, rank, 1 AS list FROM {second}),
f AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list) AS l, min(rank) AS best FROM r GROUP BY qid, doc_id)
SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, l, best, doc_id) AS rank FROM f QUALIFY rank <= 5"""

LONGEST = "(SELECT item_id AS qid, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY d.n_chars DESC, doc_id) AS rank FROM benchmark JOIN documents d ON d.source = 'src' || (item_id % 20) QUALIFY rank <= 50)"


@query("WITH " + bm25_sql(50) + ", second AS " + LONGEST + "," + RRF_SQL.format(second="second"))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    from ..operators.retrieval import top_k

    keyed = asked.withColumn("source", F.concat(F.lit("src"), F.col("qid") % 20))
    second = top_k(keyed.join(docs, "source").select("qid", "doc_id", F.col("n_chars").alias("score")), 50)
    return rrf([bm25(docs, asked, 50), second], 5).withColumn("rank", F.col("rank").cast("long"))


BAG = "list_transform(range(64), lambda b: CAST(len(list_filter(list_transform({words}, lambda w: CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64), lambda x: x = b)) AS DOUBLE))"
HYBRID = (
    "WITH " + bm25_sql(50, "lang = 'en'")
    + ", dv AS (SELECT doc_id, " + BAG.format(words="w") + " AS v FROM d WHERE len(w) > 0 AND candidate)"
    + ", qv AS (SELECT item_id AS qid, " + BAG.format(words=words_sql("text")) + " AS v FROM benchmark)"
    + ", cs AS (SELECT qid, doc_id, round(list_dot_product(qv.v, dv.v) / sqrt(list_dot_product(qv.v, qv.v)) / sqrt(list_dot_product(dv.v, dv.v)), 6) AS score FROM qv, dv)"
    + ", vec AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM cs QUALIFY rank <= 50),"
    + RRF_SQL.format(second="vec")
)


@query(HYBRID)
def hybrid_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return hybrid(docs, questions(spark, sf_dir), hashed_bag, where=equals_or_in(lang="en"))["hybrid"].withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT c_custkey, 'What did ' || c_mktsegment || ' business ( ) earn and ?' AS keywords FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def keyword_query_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = F.concat(F.lit("What did "), F.initcap("n_name"), F.lit("'s "), F.col("c_mktsegment"), F.lit(" business (C"), F.col("n_nationkey").cast("string"), F.lit(") earn in fiscal year 2019 and in 2020?"))
    return customers.select("c_custkey", keyword_query(asked, F.concat(F.lit("C"), F.col("n_nationkey").cast("string")), F.col("n_name")).alias("keywords"))


LABELS = "labels0 AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.containment_labels(questions(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("WITH " + LABELS + " SELECT DISTINCT qid, doc_id FROM labels0")
def labels_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query("""WITH c AS (SELECT doc_id AS qid, 0 AS position, 'nowhere ' || doc_id AS context FROM documents UNION ALL SELECT doc_id, 1, substr(text, 30, 150) FROM documents
UNION ALL SELECT d.doc_id, 2, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 20),
u AS (SELECT DISTINCT trim(context, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM c),
m AS (SELECT p, min(doc_id) AS chunk_id FROM u JOIN documents d ON p <> '' AND contains(d.text, p) GROUP BY p)
SELECT qid, min(position) AS position, arg_min(chunk_id, position) AS chunk_id FROM c JOIN m ON p = trim(context, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) GROUP BY qid""")
def context_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk that each document's passages come from: of three contexts the first that any document has."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("context"))
    context = lambda position, text: docs.select(F.col("doc_id").alias("qid"), F.lit(position).alias("position"), text.alias("context"))
    asked = docs.select(F.col("doc_id").alias("qid")).join(items, F.col("qid") % 20 == F.col("item_id")).select("qid", F.lit(2).alias("position"), "context")
    contexts = context(0, F.concat(F.lit("nowhere "), F.col("doc_id").cast("string"))).union(context(1, F.substring("text", 30, 150))).union(asked)
    return containment.source_chunks(contexts, docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("place"), "text"))


@query(r"""WITH q AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'numeric_results' WHEN 1 THEN 'market_risk' WHEN 2 THEN 'controls' ELSE 'risk_factors' END AS category,
  string_split(text, ' ') AS w FROM benchmark), c AS (SELECT doc_id, lang AS section, text, source FROM documents),
u AS (SELECT doc_id, source, unnest(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(regexp_replace(x, '([.!?])[\t\x0B\f\r ]+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1))))) AS unit FROM c),
n AS (SELECT DISTINCT qid, doc_id FROM u JOIN q ON source = 'src' || (qid % 20) WHERE category = 'numeric_results' AND contains(unit, ' ' || w[2] || ' ') AND contains(lower(unit), lower(w[3]))),
b AS (SELECT qid, category, w, doc_id, text FROM c JOIN q ON source = 'src' || (qid % 20) WHERE section = 'en' AND category <> 'numeric_results')
SELECT qid, doc_id AS chunk_id FROM n UNION ALL SELECT qid, doc_id FROM b WHERE category = 'market_risk' OR (category = 'controls' AND regexp_matches(text, '(?i)(were|was|are|is)\s+(not\s+)?effective|conclu'))
OR (category = 'risk_factors' AND list_unique(list_transform(regexp_extract_all(text, '(?i)\b(the|was|' || w[2] || ')\b'), lambda x: lower(x))) >= 2)""")
def label_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as filings and documents as their chunks; questions and figures are words of the benchmark."""
    w = F.split("text", " ")
    category = F.element_at(F.array(*[F.lit(x) for x in ("numeric_results", "market_risk", "controls", "risk_factors")]), (F.col("item_id") % 4 + 1).cast("int"))
    figures = F.array(F.struct(F.concat(F.lit(" "), F.get(w, 1), F.lit(" ")).alias("figure"), F.concat(F.lit("\\Q"), F.get(w, 2), F.lit("\\E")).alias("metric")))
    pattern = F.concat(F.lit(r"\b(the|was|"), F.get(w, 1), F.lit(r")\b"))
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc_id"), category.alias("category"), F.array(F.lit("en")).alias("sections"),
        figures.alias("figures"), pattern.alias("pattern"), F.lit(None).cast("int").alias("least"),
    )
    chunks = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("section"), "text")
    return evaluation.relevance_labels(asked, chunks)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).withColumns({"category": F.concat(F.lit("c"), F.col("qid") % 3), "difficulty": F.when(F.length("question") > 150, "hard").otherwise("easy")})
    results = bm25(table(spark, sf_dir, "documents"), asked, 5)
    return evaluation.records(asked, results, _labels(spark, sf_dir))


RECORDS = "WITH " + bm25_sql(5) + ", " + LABELS + """,
rec AS (SELECT b.item_id AS qid, 'c' || (b.item_id % 3) AS category, CASE WHEN length(b.text) > 150 THEN 'hard' ELSE 'easy' END AS difficulty,
  (SELECT count(*) FROM bm WHERE bm.qid = b.item_id) AS n_results, (SELECT count(*) FROM labels0 l WHERE l.qid = b.item_id) AS n_labels,
  (SELECT min(rank) FROM bm JOIN labels0 USING (qid, doc_id) WHERE qid = b.item_id) AS first_rank FROM benchmark b)"""
METRICS = """count(*) AS n_questions, round(avg(CAST(n_results > 0 AS DOUBLE)), 6) AS non_empty_rate,
  round(avg(CASE WHEN n_labels > 0 THEN CAST(first_rank IS NOT NULL AS DOUBLE) END), 6) AS hit_rate,
  round(avg(CASE WHEN n_labels > 0 THEN coalesce(1.0 / first_rank, 0) END), 6) AS mrr"""


@query(RECORDS + " SELECT qid, first_rank FROM rec WHERE first_rank IS NOT NULL")
def rank_of_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("first_rank is not null").select("qid", F.col("first_rank").cast("long").alias("first_rank"))


@query(RECORDS + f" SELECT {METRICS} FROM rec")
def hit_rate_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).agg(*evaluation.metrics())


@query(RECORDS + f""" SELECT 'category' AS field, category AS value, {METRICS} FROM rec GROUP BY category UNION ALL
SELECT 'difficulty', difficulty, {METRICS} FROM rec GROUP BY difficulty UNION ALL SELECT 'all', NULL, {METRICS} FROM rec""")
def metric_breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.breakdown(_records(spark, sf_dir), ["category", "difficulty"])


@query(RECORDS + """ SELECT qid, 'empty' AS problem FROM rec WHERE n_results = 0 UNION ALL SELECT qid, 'missed' FROM rec WHERE n_labels > 0 AND first_rank IS NULL
UNION ALL SELECT qid, 'unlabelled' FROM rec WHERE n_labels = 0""")
def diagnostic_id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.diagnostics(_records(spark, sf_dir))


MODE_RECORDS = "WITH " + bm25_sql(5) + ", " + LABELS + ", second AS " + LONGEST + """,
res AS (SELECT r.*, d.lang AS ticker, d.n_chars % 2 AS fiscal_year, d.source AS section FROM
  (SELECT qid, 'bm25' AS mode, rank, doc_id FROM bm UNION ALL SELECT qid, 'vector', rank, doc_id FROM second WHERE rank <= 5) r JOIN documents d USING (doc_id)),
want AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS ticker, item_id % 3 AS fiscal_year, ['src' || (item_id % 20), 'src1'] AS sections,
  CASE WHEN item_id % 10 = 7 THEN 'failed' END AS error, 'c' || (item_id % 3) AS category FROM benchmark),
rec AS (SELECT want.qid, m.mode, want.error, want.category, want.ticker, count(r.rank) AS n_results, coalesce(bool_and(r.ticker = want.ticker AND r.fiscal_year = want.fiscal_year), false) AS filters_match,
  min(r.rank) FILTER (WHERE list_contains(want.sections, r.section)) AS section_rank, min(r.rank) FILTER (WHERE l.doc_id IS NOT NULL) AS exact_rank,
  (SELECT count(*) FROM labels0 x WHERE x.qid = want.qid) AS n_labels
  FROM want CROSS JOIN (VALUES ('bm25'), ('vector'), ('hybrid')) m(mode) LEFT JOIN res r ON r.qid = want.qid AND r.mode = m.mode LEFT JOIN labels0 l ON l.qid = r.qid AND l.doc_id = r.doc_id GROUP BY ALL)"""
MODE_METRICS = """count(*) FILTER (WHERE error IS NULL) AS questions_completed, count(error) AS error_count,
  coalesce(round(avg(CAST(n_results > 0 AS DOUBLE)) FILTER (WHERE error IS NULL), 6), 0) AS non_empty_rate, coalesce(round(avg(CAST(filters_match AS DOUBLE)) FILTER (WHERE error IS NULL), 6), 0) AS filter_compliance_rate,
  coalesce(round(avg(CAST(section_rank IS NOT NULL AS DOUBLE)) FILTER (WHERE error IS NULL), 6), 0) AS section_hit_rate_at_k, coalesce(round(avg(coalesce(1.0 / section_rank, 0)) FILTER (WHERE error IS NULL), 6), 0) AS section_mrr_at_k,
  count(*) FILTER (WHERE error IS NULL AND n_labels > 0) AS exact_labeled_questions, round(avg(CAST(exact_rank IS NOT NULL AS DOUBLE)) FILTER (WHERE error IS NULL AND n_labels > 0), 6) AS exact_hit_rate_at_k,
  round(avg(coalesce(1.0 / exact_rank, 0)) FILTER (WHERE error IS NULL AND n_labels > 0), 6) AS exact_mrr_at_k"""


def _mode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import top_k

    docs, asked = table(spark, sf_dir, "documents"), questions(spark, sf_dir)
    keyed = asked.withColumn("source", F.concat(F.lit("src"), F.col("qid") % 20))
    longest = top_k(keyed.join(docs, "source").select("qid", "doc_id", F.col("n_chars").alias("score")), 5)
    ranked = bm25(docs, asked, 5).select("qid", "doc_id", "rank", F.lit("bm25").alias("mode")).unionByName(longest.select("qid", "doc_id", "rank", F.lit("vector").alias("mode")))
    results = ranked.join(docs.select("doc_id", F.col("lang").alias("ticker"), (F.col("n_chars") % 2).alias("fiscal_year"), F.col("source").alias("section")), "doc_id")
    want = asked.select(
        "qid", F.when(F.col("qid") % 2 == 0, "en").otherwise("de").alias("ticker"), (F.col("qid") % 3).alias("fiscal_year"),
        F.array(F.concat(F.lit("src"), F.col("qid") % 20), F.lit("src1")).alias("sections"), F.when(F.col("qid") % 10 == 7, "failed").alias("error"), F.concat(F.lit("c"), F.col("qid") % 3).alias("category"),
    )
    return evaluation.mode_records(want, results, _labels(spark, sf_dir))


@query(MODE_RECORDS + f""" SELECT mode, 'category' AS field, category AS value, {MODE_METRICS} FROM rec GROUP BY mode, category UNION ALL
SELECT mode, 'ticker', ticker, {MODE_METRICS} FROM rec GROUP BY mode, ticker UNION ALL SELECT mode, 'all', NULL, {MODE_METRICS} FROM rec GROUP BY mode""")
def evaluation_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.breakdown(_mode_records(spark, sf_dir), ["category", "ticker"], ["mode"], evaluation.mode_metrics())


@query(MODE_RECORDS + """ SELECT mode, 'error' AS problem, qid FROM rec WHERE error IS NOT NULL UNION ALL SELECT mode, 'empty_result', qid FROM rec WHERE error IS NULL AND n_results = 0
UNION ALL SELECT mode, 'filter_failure', qid FROM rec WHERE error IS NULL AND n_results > 0 AND NOT filters_match UNION ALL SELECT mode, 'section_miss', qid FROM rec WHERE error IS NULL AND section_rank IS NULL
UNION ALL SELECT mode, 'exact_miss', qid FROM rec WHERE error IS NULL AND n_labels > 0 AND exact_rank IS NULL""")
def evaluation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mode_problems(_mode_records(spark, sf_dir))


@query("""WITH t AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier)
SELECT * FROM t ORDER BY turn, s_nationkey, s_suppkey LIMIT 30""")
def stratified_round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.round_robin(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey", 30)
    return out.withColumn("turn", F.col("turn").cast("long"))


@query("""WITH p AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT DISTINCT p_partkey, p_brand, place FROM p, range(8) r(i) WHERE place = floor(i * n / 8)""")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.systematic(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 8)
    return out.withColumn("place", F.col("place").cast("long"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n, count(DISTINCT o_custkey) AS n_ids FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority")) + " UNION ALL SELECT 'all', NULL, count(*), count(DISTINCT o_custkey) FROM orders")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.stats(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_custkey")


@query("""SELECT c_nationkey, c_mktsegment, n FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS p
FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE p = 1""")
def catalog_top_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.most_frequent(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment")


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_doc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000 AND o_custkey IS NOT NULL)")
def stale_rows_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return index.stale(table(spark, sf_dir, "customer"), current, "c_custkey")


@query("SELECT l_partkey AS p_partkey FROM lineitem WHERE l_quantity > 49 UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 EXCEPT SELECT p_partkey FROM part WHERE p_size > 10")
def orphan_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return index.orphans([lines.where("l_quantity > 49"), lines.where("l_discount > 0.09")], table(spark, sf_dir, "part").where("p_size > 10"), "p_partkey")


@query("""WITH k AS (SELECT sha256('m1' || chr(10) || text) AS key, text, lang FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT key, length(text) AS n FROM k WHERE key NOT IN (SELECT key FROM k WHERE lang = 'en')""")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("lang = 'en'").select(index.text_key("m1", F.col("text")).alias("key"))
    return index.cache_misses(docs, cache, "m1").select("key", F.length("text").cast("long").alias("n"))


@query("""SELECT sha256(text) AS hash, doc_id, n, first FROM documents JOIN (SELECT text AS t, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1) ON text = t""")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT 'doc_id' AS field, 'bigint, expected string' AS problem UNION ALL SELECT 'section', 'missing, expected string' UNION ALL SELECT 'page', 'missing, expected int'")
def index_schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_diff(spark, table(spark, sf_dir, "documents").schema, "doc_id string, text string, section string, page int")
