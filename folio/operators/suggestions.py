"""Questions that can be asked next: candidates by ordered rules, kept where the data can answer them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values, in order of preference: a topic, what names it in a question, the question that asks for it, and the annual
#: figure that answers it where there is no report.
TOPICS = (
    ("revenue", ("revenue", "net sales", "sales"), "What was the total revenue of {name} in fiscal {year}?", "Total Revenue"),
    ("risks", ("risk",), "What were the main risk factors for {name} in fiscal {year}?", None),
    ("net income", ("net income", "profit", "earnings"), "What was the net income of {name} in fiscal {year}?", "Net Income"),
    ("business", ("business", "segment", "overview", "products"), "How did {name} describe its business in fiscal {year}?", None),
    ("cash flow", ("cash flow",), "What was the operating cash flow of {name} in fiscal {year}?", "Operating Cash Flow"),
)
MOST = 3
KEY = ["ticker", "fiscal_year"]


def topic(question: Column) -> Column:
    """The place, from 1, of the first topic that the question has a word of; null if it has none."""
    text = F.lower(question)
    found = F.lit(None).cast("int")
    for i, (_, words, _, _) in reversed(list(enumerate(TOPICS, 1))):
        has = text.contains(words[0])
        for w in words[1:]:
            has = has | text.contains(w)
        found = F.when(has, F.lit(i)).otherwise(found)
    return found


def _per_topic(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at - 1)


def candidates(questions: DataFrame, reports: DataFrame, figures: DataFrame) -> DataFrame:
    """questions(qid, ticker, fiscal_year, topic) with reports or figures of their company and year -> (qid, ticker, grp, pref,
    fiscal_year, topic): all other topics of the year (grp 1), the same topic of the year before (2), and, for the year of a
    report, the company's latest year that has figures only (3): the same topic if its figure is there, or else the first."""
    later = figures.select(*KEY).distinct().join(reports, KEY, "left_anti").groupBy("ticker").agg(F.max("fiscal_year").alias("later"))
    there = figures.select("ticker", F.col("fiscal_year").alias("later"), "figure", F.lit(True).alias("there")).distinct()
    known = questions.join(reports.withColumn("report", F.lit(True)), KEY, "left").join(later, "ticker", "left")
    known = known.withColumn("figure", _per_topic([t[3] for t in TOPICS], F.col("topic"))).join(there, ["ticker", "later", "figure"], "left")
    row = lambda grp, pref, year, topic_: F.struct(F.lit(grp).alias("grp"), pref.alias("pref"), year.cast("int").alias("fiscal_year"), topic_.cast("int").alias("topic"))
    others = F.transform(F.sequence(F.lit(1), F.lit(len(TOPICS))), lambda t: row(1, t, F.col("fiscal_year"), t))
    others = F.filter(others, lambda c: ~c["topic"].eqNullSafe(F.col("topic")))
    before = F.when(F.col("topic").isNotNull(), row(2, F.lit(0), F.col("fiscal_year") - 1, F.col("topic")))
    after = F.when(F.col("report") & F.col("later").isNotNull(), row(3, F.lit(0), F.col("later"), F.when(F.col("there"), F.col("topic")).otherwise(1)))
    return known.select("qid", "ticker", F.explode(F.concat(others, F.array_compact(F.array(before, after)))).alias("c")).select("qid", "ticker", "c.*")


def suggest(questions: DataFrame, asked: DataFrame, names: DataFrame, reports: DataFrame, figures: DataFrame, most: int = MOST) -> DataFrame:
    """questions(qid, question, ticker, fiscal_year), asked(qid, question, ticker, fiscal_year) -> (qid, place, text): up to
    `most` questions about the same company, from 1.

    names(ticker, name); reports(ticker, fiscal_year) answer every topic, figures(ticker, fiscal_year, figure) that of their
    figure. First comes one of each rule of candidates(), the first that can be answered and wasn't asked, then further topics
    of the year. What was asked is a company, year and topic, in whatever words; the question itself counts too. A question
    without company and year, or of a year that nothing is known of, gets none; one without a topic gets those of its year."""
    reports, figures = reports.select(*KEY).distinct(), figures.select(*KEY, "figure").distinct()
    resolved = lambda df: df.where("ticker is not null and fiscal_year is not null").select("qid", *KEY, topic(F.col("question")).alias("topic"))
    own = resolved(questions)
    own = own.join(reports.union(figures.select(*KEY)).distinct(), KEY, "left_semi")
    done = own.select("qid", *KEY, "topic").union(resolved(asked).select("qid", *KEY, "topic")).where("topic is not null").distinct()
    found = candidates(own, reports, figures).withColumn("figure", _per_topic([t[3] for t in TOPICS], F.col("topic")))
    found = found.join(done, ["qid", *KEY, "topic"], "left_anti")
    found = found.join(reports.withColumn("report", F.lit(True)), KEY, "left").join(figures.withColumn("there", F.lit(True)), [*KEY, "figure"], "left")
    found = found.where("report or there").select("qid", "ticker", "fiscal_year", "topic", "grp", "pref")
    turn = F.row_number().over(Window.partitionBy("qid", "grp").orderBy("pref"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.least("turn", F.lit(2)), "grp", "pref"))
    found = found.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= most)
    text = _per_topic([t[2] for t in TOPICS], F.col("topic"))
    text = F.replace(F.replace(text, F.lit("{year}"), F.col("fiscal_year").cast("string")), F.lit("{name}"), F.col("name"))
    return found.join(names.select("ticker", "name").dropDuplicates(["ticker"]), "ticker").select("qid", "place", text.alias("text"))
