"""What readers and evaluators are shown of answers, and the files that evaluations leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The section of annual figures, and what is said where a section or a date is unknown.
FIGURES, NO_SECTION, NO_DATE = "Yahoo Finance", "No section", "unknown date"
#: The columns of an answer and of a source that stay inside.
INTERNAL = ("status", "model", "usage")
INTERNAL_SOURCE = ("chunk_id",)
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "factual_correctness")


def source_label(position: Column, name: Column, fiscal_year: Column, section: Column, page: Column) -> Column:
    """`1. AAPL 2020 · Item 7 · p. 31`; annual figures have the date they were fetched in place of a page."""
    section = F.when(F.coalesce(section, F.lit("")).isin("", "Unknown"), NO_SECTION).otherwise(section)
    fetched = F.rtrim(F.regexp_extract(section, r"fetched on (.*?)\)*$", 1))
    where = F.when((page == 0) & section.startswith(FIGURES), F.concat(F.lit(f"{FIGURES} · fetched on "), F.when(fetched == "", NO_DATE).otherwise(fetched)))
    where = F.coalesce(where, F.concat(section, F.lit(" · p. "), page.cast("string")))
    return F.concat(position.cast("string"), F.lit(". "), name, F.lit(" "), fiscal_year.cast("string"), F.lit(" · "), where)


def shown_answer(answer: Column, labels: Column, latency_ms: Column) -> Column:
    """The answer with the list of its citations and the time it took, as far as there are any."""
    lines = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), x)), "\n")
    cited = F.when(F.size(labels) > 0, F.concat(F.lit("\n\n**Citations:**\n"), lines))
    took = F.concat(F.lit("\n\n_Response time: "), latency_ms.cast("string"), F.lit(" ms_"))
    return F.concat(answer, F.coalesce(cited, F.lit("")), F.coalesce(took, F.lit("")))


def public(answers: DataFrame) -> DataFrame:
    """answers(..., sources array<struct>) without what stays inside."""
    kept = answers.drop(*INTERNAL)
    return kept.withColumn("sources", F.transform("sources", lambda s: s.dropFields(*INTERNAL_SOURCE))) if "sources" in kept.columns else kept


def as_seen(company: Column, fiscal_year: Column, section: Column, page: Column, text: Column) -> Column:
    """A chunk with its source above it, as the generator saw it."""
    head = F.concat(F.lit("Source: "), company, F.lit(", fiscal "), fiscal_year.cast("string"))
    section = F.coalesce(section, F.lit(""))
    rest = F.when(section.startswith(FIGURES), F.concat(F.lit(", "), section)).otherwise(F.concat(F.lit(" 10-K, "), section, F.lit(", page "), page.cast("string")))
    return F.concat(head, rest, F.lit("\n"), text)


def to_score(records: DataFrame) -> DataFrame:
    """Answered records that have contexts."""
    return records.where((F.col("status") == "answered") & (F.size("contexts") > 0))


def run_summary(records: DataFrame, scored: DataFrame) -> DataFrame:
    """records(status, detected, expected, latency_ms, input_tokens, output_tokens), scored(category, metrics) -> one row: questions, scored,
    status (a map of counts), detected_as_labeled, average (of each metric that any row has), by_category (rows of n and
    averages), input_tokens, output_tokens, and the upper middle latency of the answered."""
    present = [m for m in METRICS if m in scored.columns]
    have = scored.agg(*[F.count(m).alias(m) for m in present]).first().asDict() if present else {}
    present = [m for m in present if have[m]]
    mean = lambda m: F.round(F.avg(F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))), 3).alias(m)
    averages = F.struct(*[mean(m) for m in present]) if present else F.lit(None).cast("struct<none:double>")
    by = scored.groupBy("category").agg(F.count("*").alias("n"), averages.alias("average"))
    by = by.agg(F.array_sort(F.collect_list(F.struct("category", "n", "average"))).alias("by_category"))
    status = records.groupBy(F.coalesce("status", F.lit("")).alias("s")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("status"))
    # The middle by rank; all that comes together in one row are counts.
    answered = F.col("status") == "answered"
    middle = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms)")
    n = records.where(answered).agg(F.count("latency_ms").alias("n")).first()["n"]
    upper = records.where(answered).orderBy(F.col("latency_ms").asc_nulls_last()).select("latency_ms").offset(n // 2).limit(1).agg(F.max("latency_ms").alias("median_latency_ms_answered")) if n % 2 == 0 else records.where(answered).agg(middle.alias("median_latency_ms_answered"))
    sums = records.agg(
        F.count("*").alias("questions"), F.count_if(F.col("detected").eqNullSafe(F.col("expected"))).alias("detected_as_labeled"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    total = scored.agg(F.count("*").alias("scored"), averages.alias("average"))
    one = F.lit(1).alias("one")
    out = sums.select("*", one)
    for part in (total, status, by, upper):  # each is one row
        out = out.join(part.select("*", one), "one")
    return out.drop("one")


def write_scores(scored: DataFrame, path: str) -> None:
    """CSV of id, category, the metrics that any row has, and the question."""
    counts = scored.agg(*[F.count(m).alias(m) for m in METRICS if m in scored.columns]).first().asDict()
    scored.select("id", "category", *[m for m in METRICS if counts.get(m)], "question").write.mode("overwrite").option("header", True).csv(path)


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    """snapshots(ticker_10k, status, ...): those that are ok as JSON, a folder for each ticker."""
    snapshots.where("status = 'ok'").withColumn("ticker", F.col("ticker_10k")).repartition("ticker").write.mode("overwrite").partitionBy("ticker").json(path)


def load_snapshot(snapshots: DataFrame, ticker: str) -> DataFrame:
    """The rows of a ticker; none for what isn't written like one."""
    return snapshots.where(F.lit(ticker or "").rlike(r"^[A-Z][A-Z0-9.\-]{0,11}$") & (F.col("ticker_10k") == ticker))


def with_official_company(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """hits(ticker, fiscal_year, company, ...) with the catalog's (ticker, fiscal_year, name) as company where it has one."""
    known = catalog.select("ticker", "fiscal_year", "name").dropDuplicates(["ticker", "fiscal_year"])
    return hits.join(known, ["ticker", "fiscal_year"], "left").withColumn("company", F.coalesce("name", "company")).select(hits.columns)
