"""Companies of an index with the rule of their fiscal years, and what annual figures there are of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fiscal_year
from .figures import RULES, number

#: The figures looked for in each statement.
KEY_FIGURES = {
    "income_stmt": ("Total Revenue", "Gross Profit", "Operating Income", "Net Income"),
    "balance_sheet": ("Total Assets", "Total Debt", "Stockholders Equity"),
    "cashflow": ("Operating Cash Flow", "Free Cash Flow"),
}
ALL_FIGURES = tuple(x for names in KEY_FIGURES.values() for x in names)
#: Years behind this one are those that the reports don't have.
LAST_REPORT_YEAR = 2021


def companies(filings: DataFrame, first_chunks: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """filings(doc_id, ticker, fiscal_year, fiscal_year_end), first_chunks(doc_id, company, company_name), overrides(ticker,
    ticker_yahoo, fiscal_year_rule, note) -> (rows, problems), both of one aggregate over the filings.

    rows(ticker_10k, ticker_yahoo, company, note, fiscal_year_rule, company_name): one for each company with a rule: the
    override's if it is known and gives the fiscal year of every dated filing, or else the first of RULES that does; end_year
    where no filing is dated. Names come from the filing of the smallest doc_id. problems(ticker, problem): why a company is
    left out, or that its rule is assumed; a company can be in both. Overrides of other companies aren't used."""
    dated = F.col("fiscal_year_end").isNotNull()
    fits = [F.bool_and(F.when(dated, fiscal_year(F.col("fiscal_year_end"), r) == F.col("fiscal_year"))).alias(f"fits_{r}") for r in RULES]
    ended = F.concat(F.col("fiscal_year").cast("string"), F.lit(" ended "), F.col("fiscal_year_end").cast("string"))
    ends = F.array_sort(F.collect_list(F.when(dated, F.struct("fiscal_year", "fiscal_year_end", ended.alias("text")))))
    each = filings.groupBy("ticker").agg(*fits, F.count_if(dated).alias("n_dated"), F.array_join(F.transform(ends, lambda x: x["text"]), ", ").alias("ends"), F.min("doc_id").alias("doc_id"))
    clean = lambda name: F.nullif(F.trim(name), F.lit("")).alias(name)
    extra = overrides.select(F.upper(F.trim("ticker")).alias("ticker"), clean("ticker_yahoo"), clean("fiscal_year_rule"), clean("note")).dropDuplicates(["ticker"])
    each = each.join(extra, "ticker", "left").join(first_chunks.select("doc_id", "company", "company_name").dropDuplicates(["doc_id"]), "doc_id", "left")
    given = F.col("fiscal_year_rule")
    fit = lambda r: F.coalesce(F.col(f"fits_{r}"), F.lit(True))
    chosen, given_fits = F.lit(None).cast("string"), F.lit(False)
    for r in reversed(RULES):
        chosen, given_fits = F.when(fit(r), r).otherwise(chosen), F.when(given == r, fit(r)).otherwise(given_fits)
    unknown, wrong, none = given.isNotNull() & ~given.isin(*RULES), given.isNotNull() & ~given_fits, given.isNull() & chosen.isNull()
    why = (
        F.when(unknown, F.concat(F.lit("unknown fiscal_year_rule '"), given, F.lit("'; left out")))
        .when(wrong, F.concat(F.lit("rule "), given, F.lit(" does not match its 10-Ks; left out")))
        .when(F.col("n_dated") == 0, F.concat(F.lit("no 10-K with a fiscal year end date; "), F.coalesce(given, F.lit(RULES[0])), F.lit(" assumed")))
        .when(none, F.concat(F.lit("no rule gives the fiscal years of its 10-Ks ("), F.col("ends"), F.lit("); left out")))
    )
    told = each.withColumns({"problem": why, "rule": F.coalesce(given, chosen), "out": unknown | wrong | none})
    empty = lambda name: F.coalesce(name, F.lit("")).alias(name)
    rows = told.where("not out").select(
        F.col("ticker").alias("ticker_10k"), F.coalesce("ticker_yahoo", "ticker").alias("ticker_yahoo"), empty("company"), empty("note"), F.col("rule").alias("fiscal_year_rule"), empty("company_name")
    )
    return rows, told.where("problem is not null").select("ticker", "problem")


def statement_values(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """statements(ticker, kind, figure, period_end, value), rows of companies() -> (ticker, kind, figure, fiscal_year, period_end,
    value): key figures of a statement that are numbers, by the company's fiscal year."""
    wanted = F.lit(False)
    for kind, names in KEY_FIGURES.items():
        wanted = wanted | ((F.col("kind") == kind) & F.col("figure").isin(*names))
    known = statements.where(wanted).withColumn("value", number(F.col("value"))).where("value is not null and period_end is not null")
    rules = rows.select(F.col("ticker_10k").alias("ticker"), "fiscal_year_rule")
    year = F.when(F.col("fiscal_year_rule") == RULES[1], fiscal_year(F.col("period_end"), RULES[1])).otherwise(fiscal_year(F.col("period_end"), RULES[0]))
    return known.join(rules, "ticker").select("ticker", "kind", "figure", year.alias("fiscal_year"), "period_end", "value")


def _texts(years: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(years), lambda y: y.cast("string")), " ")


def coverage(rows: DataFrame, values: DataFrame, info: DataFrame) -> DataFrame:
    """rows of companies(), statement_values(), info(ticker, name_on_yahoo, currency, error) -> a row for each company, found or
    not: status (ok, no_data or error), the years of each statement, latest_fiscal_year, years_after_2021, missing_figures."""
    of = lambda kind: F.array_distinct(F.array_agg(F.when(F.col("kind") == kind, F.col("fiscal_year")))).alias(kind)
    have = values.groupBy("ticker").agg(*[of(k) for k in KEY_FIGURES], F.collect_set("fiscal_year").alias("years"), F.collect_set("figure").alias("have"))
    all_ = rows.join(have.withColumnRenamed("ticker", "ticker_10k"), "ticker_10k", "left").join(info.dropDuplicates(["ticker"]).withColumnRenamed("ticker", "ticker_10k"), "ticker_10k", "left")
    failed = F.coalesce("error", F.lit("")) != ""
    status = F.when(failed, "error").when(F.col("years").isNull(), "no_data").otherwise("ok")
    no_years = F.array().cast("array<int>")
    missing = F.array_except(F.array(*[F.lit(x) for x in ALL_FIGURES]), F.coalesce("have", F.array().cast("array<string>")))
    empty = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return all_.select(
        "ticker_10k", "ticker_yahoo", "company", status.alias("status"), empty("name_on_yahoo"), empty("currency"),
        *[_texts(F.coalesce(kind, no_years)).alias(f"{name}_years") for kind, name in zip(KEY_FIGURES, ("income", "balance", "cashflow"), strict=True)],
        F.array_max("years").alias("latest_fiscal_year"), _texts(F.filter(F.coalesce("years", no_years), lambda y: y > LAST_REPORT_YEAR)).alias("years_after_2021"),
        F.when(status == "ok", F.array_join(missing, "; ")).otherwise("").alias("missing_figures"), "note", empty("error"),
    )
