"""Retrieval evaluation over tables of questions, results and labels, and the samples drawn for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sentence_units
from .containment import contained


def containment_labels(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """questions(qid, question), docs(doc_id, text) -> (qid, doc_id) of documents that have the whole question verbatim. Empty
    and null questions are nowhere."""
    passages = questions.select(F.col("qid").alias("pid"), F.col("question").alias("passage"))
    found = contained(passages, docs.select(F.col("doc_id").alias("tid"), "text"))
    return found.select(F.col("pid").alias("qid"), F.col("tid").alias("doc_id"))


def first_ranks(results: DataFrame, labels: DataFrame) -> DataFrame:
    """results(qid, doc_id, rank), labels(qid, doc_id) -> (qid, first_rank) where any labelled row was returned."""
    return results.join(labels, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first_rank"))


def records(questions: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a question: n_results, n_labels, first_rank (null: missed, or nothing to find)."""
    # Results are named once, as each naming of a search runs it again.
    relevant = labels.select("qid", "doc_id").distinct().withColumn("relevant", F.lit(True))
    counted = results.join(relevant, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("*").alias("n_results"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"))
    wanted = labels.groupBy("qid").agg(F.count("*").alias("n_labels"))
    return (
        questions.join(counted, "qid", "left").join(wanted, "qid", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_results", "n_labels")})
    )


def metrics() -> list[Column]:
    """Aggregates over records(): misses count 0 in MRR; without any label hit rate and MRR are null, not 0."""
    labelled = F.col("n_labels") > 0
    return [
        F.count("*").alias("n_questions"),
        F.round(F.avg((F.col("n_results") > 0).cast("double")), 6).alias("non_empty_rate"),
        F.round(F.avg(F.when(labelled, F.col("first_rank").isNotNull().cast("double"))), 6).alias("hit_rate"),
        F.round(F.avg(F.when(labelled, F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))), 6).alias("mrr"),
    ]


def breakdown(rows: DataFrame, fields: list[str], by: list[str] | None = None, aggregates: list[Column] | None = None) -> DataFrame:
    """Aggregates (metrics() unless given) by each of the fields and over all, in one pass of grouping sets, within each value
    of `by`: (*by, field, value, aggregates)."""
    by = by or []
    sets = [[F.col(c) for c in [*by, f]] for f in fields] + [[F.col(c) for c in by]]
    out = rows.groupingSets(sets, *by, *fields).agg(*(aggregates or metrics()), F.grouping_id(*by, *fields).alias("gid"))
    # grouping_id has a bit for each column that a set does not group by, the first column's highest; those of `by` are 0.
    full = (1 << len(fields)) - 1
    label = F.lit("all")
    value = F.lit(None).cast("string")
    for i, f in enumerate(fields):
        gid = full ^ (1 << (len(fields) - 1 - i))
        label, value = F.when(F.col("gid") == gid, f).otherwise(label), F.when(F.col("gid") == gid, F.col(f).cast("string")).otherwise(value)
    return out.withColumns({"field": label, "value": value}).drop("gid", *[f for f in fields if f not in ("field", "value")])


#: The ways of retrieval that an evaluation compares, and the fields that it is broken down by.
MODES = ("bm25", "vector", "hybrid")


def mode_records(questions: DataFrame, results: DataFrame, labels: DataFrame, modes: tuple[str, ...] = MODES) -> DataFrame:
    """questions(qid, ticker, fiscal_year, sections, error, ...), results(qid, mode, rank, doc_id, ticker, fiscal_year, section),
    labels(qid, doc_id) -> a row for each question and mode: n_results, filters_match (there are results and all are of the
    asked ticker and year; a null is no match), section_rank, exact_rank (null: none), n_labels."""
    asked = questions.select("qid", F.col("ticker").alias("want_ticker"), F.col("fiscal_year").alias("want_year"), F.col("sections").alias("want_sections"))
    wanted = labels.select("qid", "doc_id").distinct()
    marked = results.join(wanted.withColumn("relevant", F.lit(True)), ["qid", "doc_id"], "left").join(asked, "qid")
    fits = F.coalesce((F.col("ticker") == F.col("want_ticker")) & (F.col("fiscal_year") == F.col("want_year")), F.lit(False))
    found = marked.groupBy("qid", "mode").agg(
        F.count("*").alias("n_results"), F.bool_and(fits).alias("filters_match"),
        F.min(F.when(F.array_contains("want_sections", F.col("section")), F.col("rank"))).alias("section_rank"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("exact_rank"),
    )
    every = questions.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    out = every.join(found, ["qid", "mode"], "left").join(wanted.groupBy("qid").agg(F.count("*").alias("n_labels")), "qid", "left")
    return out.withColumns({"filters_match": F.coalesce("filters_match", F.lit(False)), **{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_results", "n_labels")}})


def mode_metrics() -> list[Column]:
    """Aggregates over mode_records(): rates over the questions without error (0 where there are none); misses count 0 in MRR;
    exact rates are over labelled questions, null without any."""
    done = F.col("error").isNull()
    labelled = done & (F.col("n_labels") > 0)
    share = lambda among, x: F.round(F.avg(F.when(among, x.cast("double"))), 6)
    all_of = lambda x: F.coalesce(share(done, x), F.lit(0.0))
    inverse = lambda rank: F.coalesce(1 / F.col(rank), F.lit(0.0))
    return [
        F.count_if(done).alias("questions_completed"), F.count_if(~done).alias("error_count"),
        all_of(F.col("n_results") > 0).alias("non_empty_rate"), all_of(F.col("filters_match")).alias("filter_compliance_rate"),
        all_of(F.col("section_rank").isNotNull()).alias("section_hit_rate_at_k"), all_of(inverse("section_rank")).alias("section_mrr_at_k"),
        F.count_if(labelled).alias("exact_labeled_questions"), share(labelled, F.col("exact_rank").isNotNull()).alias("exact_hit_rate_at_k"),
        share(labelled, inverse("exact_rank")).alias("exact_mrr_at_k"),
    ]


def mode_problems(rows: DataFrame) -> DataFrame:
    """(mode, problem, qid) of mode_records(): a row for each question to look at. Questions with an error have that only."""
    done = F.col("error").isNull()
    kinds = F.array_compact(F.array(
        F.when(~done, F.lit("error")), F.when(done & (F.col("n_results") == 0), F.lit("empty_result")),
        F.when(done & (F.col("n_results") > 0) & ~F.col("filters_match"), F.lit("filter_failure")),
        F.when(done & F.col("section_rank").isNull(), F.lit("section_miss")),
        F.when(done & (F.col("n_labels") > 0) & F.col("exact_rank").isNull(), F.lit("exact_miss")),
    ))
    return rows.select("mode", F.explode(kinds).alias("problem"), "qid")


def diagnostics(rows: DataFrame) -> DataFrame:
    """(problem, qid): a row for each question without results, labelled and missed, or unlabelled."""
    kinds = F.array_compact(F.array(
        F.when(F.col("n_results") == 0, F.lit("empty")), F.when((F.col("n_labels") > 0) & F.col("first_rank").isNull(), F.lit("missed")),
        F.when(F.col("n_labels") == 0, F.lit("unlabelled")),
    ))
    return rows.select(F.explode(kinds).alias("problem"), "qid")


def round_robin(rows: DataFrame, category: str, order: str, limit: int) -> DataFrame:
    """A stratified sample: the first of each category (in the order of their names), then the second of each, and so on
    until `limit`; returned with the rank within its category."""
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy(order)))
    return ranked.where(F.col("turn") <= limit).orderBy("turn", category, order).limit(limit)


def systematic(rows: DataFrame, group: str, order: str, count: int) -> DataFrame:
    """Of each group, `count` rows at even steps through its order: those at floor(i * n / count)."""
    by = Window.partitionBy(group)
    placed = rows.withColumn("place", F.row_number().over(by.orderBy(order)) - 1).withColumn("n", F.count("*").over(by))
    # Row p is taken if some i in 0..count-1 has floor(i * n / count) = p.
    i = F.ceil(F.col("place") * count / F.col("n"))
    taken = (F.floor(i * F.col("n") / count) == F.col("place")) & (i < count)
    return placed.where(taken).drop("n")


def figure_labels(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions(qid, doc_id, figures array<struct<figure, metric>>), chunks(doc_id, chunk_id, text) -> (qid, chunk_id): a
    unit (line or sentence) of the question's own filing has a figure and, in the same unit, its metric's pattern."""
    units = chunks.select("doc_id", "chunk_id", F.explode(sentence_units(F.col("text"))).alias("unit"))
    wanted = questions.select("qid", "doc_id", F.explode("figures").alias("f")).select("qid", "doc_id", "f.figure", "f.metric")
    found = units.join(wanted, "doc_id").where(F.col("unit").contains(F.col("figure")) & F.expr("unit rlike concat('(?i)', metric)"))
    return found.select("qid", "chunk_id").distinct()


def topic_labels(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions(qid, doc_id, sections, pattern, least), chunks(doc_id, chunk_id, section, text) -> (qid, chunk_id): a chunk of
    an expected section with at least `least` distinct matches of the pattern; a null pattern takes whole sections."""
    both = chunks.join(questions, "doc_id").where(F.array_contains("sections", F.col("section")))
    found = F.size(F.array_distinct(F.transform(F.expr("regexp_extract_all(text, concat('(?i)(', pattern, ')'), 1)"), lambda x: F.lower(x))))
    return both.where(F.col("pattern").isNull() | (found >= F.col("least"))).select("qid", "chunk_id").distinct()


#: Categories of which whole sections count, the one that needs a conclusion, and what a conclusion says.
WHOLE_SECTIONS, CONCLUDED, NUMERIC = ("legal_proceedings", "market_risk"), "controls", "numeric_results"
CONCLUSION = r"(?i)(were|was|are|is)\s+(not\s+)?effective|conclu"


def relevance_labels(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions(qid, doc_id, category, sections array<string>, figures array<struct<figure, metric>>, pattern, least),
    chunks(doc_id, chunk_id, section, text) -> (qid, chunk_id), the relevant chunks of each question's own filing.

    numeric_results: a line or sentence has one of the figures and, in the same one, its metric's pattern, in any section. All
    others need an expected section: legal_proceedings and market_risk nothing more, controls a conclusion, any other category
    `least` distinct matches (2 where it is null) of the pattern of its topics, whatever their case. One join by filing; the
    predicate is chosen by category, so each pair is looked at once."""
    both = chunks.join(questions, "doc_id")
    in_section = F.coalesce(F.array_contains("sections", F.col("section")), F.lit(False))
    near = lambda u, f: u.contains(f["figure"]) & F.regexp_like(u, F.concat(F.lit("(?i)"), f["metric"]))
    figure = F.exists(sentence_units(F.col("text")), lambda u: F.exists("figures", lambda f: near(u, f)))
    topics = F.regexp_extract_all("text", F.concat(F.lit("(?i)"), F.col("pattern")), F.lit(0))
    enough = F.size(F.array_distinct(F.transform(topics, lambda x: F.lower(x)))) >= F.coalesce("least", F.lit(2))
    category = F.col("category")
    relevant = F.when(category == NUMERIC, figure).when(~in_section, F.lit(False)).when(category.isin(*WHOLE_SECTIONS), F.lit(True)).when(category == CONCLUDED, F.col("text").rlike(CONCLUSION)).otherwise(enough)
    return both.where(F.coalesce(relevant, F.lit(False))).select("qid", "chunk_id").distinct()


def write_labels(questions: DataFrame, labels: DataFrame, path: str) -> None:
    """Write the questions with relevant_chunk_ids, in order, as Parquet at path; if a question has none, nothing is written and
    the error names some of those without."""
    ids = labels.groupBy("qid").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant_chunk_ids"))
    if missing := [r["qid"] for r in questions.join(ids, "qid", "left_anti").select("qid").orderBy("qid").take(20)]:
        raise ValueError(f"no relevant chunk for {missing}")
    questions.drop("relevant_chunk_ids").join(ids, "qid").write.mode("overwrite").parquet(path)


def score_summary(answers: DataFrame, metric_columns: list[str]) -> DataFrame:
    """answers(status, category, latency_ms, scores): averages of the scores that there are, NaN taken for null, rounded to
    3 places; the median latency is the upper middle one, taken by rank."""
    clean = [F.round(F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))), 3).alias(c) for c in metric_columns]
    by = Window.partitionBy("category")
    timed = answers.withColumn("place", F.row_number().over(by.orderBy(F.col("latency_ms").asc_nulls_last()))).withColumn("timed", F.count("latency_ms").over(by))
    median = F.max(F.when(F.col("place") == F.floor(F.col("timed") / 2) + 1, F.col("latency_ms")))
    return timed.groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "answered").alias("answered"), *clean,
        median.alias("median_latency_ms"),
    )
