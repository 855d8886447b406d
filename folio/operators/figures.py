"""Annual figures: statements turned long, fiscal-year rules, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount, fiscal_year

RULES = ("end_year", "most_months")


def number(value: Column) -> Column:
    """A double; null for what isn't a number and for NaN."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def unpivot(statement: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """A wide statement to (ids, figure, value), without nulls and NaNs."""
    return statement.unpivot(ids, columns, "figure", "value").withColumn("value", number(F.col("value"))).where("value is not null")


def rule_for(filings: DataFrame, key: str, end: str, year: str) -> DataFrame:
    """(key, rule): the first rule that gives the filing's year for all dated filings; null if none does; end_year where no
    filing is dated (assumed)."""
    dated = F.col(end).isNotNull()
    fits = [F.bool_and(F.when(dated, fiscal_year(F.col(end), r) == F.col(year))) for r in RULES]
    rule = F.when(F.count_if(dated) == 0, "end_year")
    for r, ok in zip(RULES, fits, strict=True):
        rule = rule.when(F.coalesce(ok, F.lit(False)), r)
    return filings.groupBy(key).agg(rule.alias("rule"), (F.count_if(dated) == 0).alias("assumed"))


def snapshot_values(snapshots: DataFrame) -> DataFrame:
    """figures map<figure, map<year as text, value>> -> (ticker, figure, fiscal_year, value), nulls and NaNs left out."""
    by_figure = snapshots.select("ticker", F.explode("figures").alias("figure", "by_year"))
    long = by_figure.select("ticker", "figure", F.explode("by_year").alias("year", "value"))
    return long.select("ticker", "figure", F.col("year").try_cast("int").alias("fiscal_year"), F.nanvl("value", F.lit(None).cast("double")).alias("value")).where("value is not null and fiscal_year is not null")


def snapshot_chunks(values: DataFrame, order: list[str]) -> DataFrame:
    """values(ticker, company, currency, figure, fiscal_year, value) -> one text row for each company and year in the form of a
    hit: page 0, score 1, figures in the given order and then by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col("figure")), F.lit(0)), F.lit(len(order) + 1))
    line = F.concat(F.col("figure"), F.lit(": "), amount(F.col("value"), F.col("currency")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "figure", line.alias("line")))), lambda x: x["line"])
    out = values.groupBy("ticker", "company", "fiscal_year").agg(F.array_join(lines, "\n").alias("text"))
    return out.select(
        F.concat(F.lit("yahoo-"), "ticker", F.lit("-"), "fiscal_year").alias("chunk_id"), "text", F.lit(1.0).alias("score"),
        F.lit("Annual figures").alias("section"), F.lit(0).alias("page"), "company", "fiscal_year",
    )


def latest_by(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def years_text(years: Column) -> Column:
    """`2019 to 2021` for a run of years, else a list."""
    whole = years == F.sequence(F.array_min(years), F.array_max(years))
    texts = F.array_join(F.transform(years, lambda y: y.cast("string")), ", ")
    return F.when((F.size(years) > 2) & whole, F.concat(F.array_min(years).cast("string"), F.lit(" to "), F.array_max(years).cast("string"))).otherwise(texts)
