"""Suggested questions and company coverage."""

import datetime

import pytest

from folio.operators import coverage, suggestions

ASK = "qid int, question string, ticker string, fiscal_year int"
REPORTS = [("AAPL", y) for y in (2019, 2020, 2021)]
REVENUE = [("AAPL", y, "Total Revenue") for y in (2023, 2024)]


def suggested(spark, question, year, asked=(), figures=(), ticker="AAPL"):
    frame = lambda rows, ddl: spark.createDataFrame(list(rows), ddl)
    out = suggestions.suggest(
        frame([(1, question, ticker, year)], ASK), frame([(1, q, "AAPL", y) for q, y in asked], ASK), frame([("AAPL", "Apple Inc.")], "ticker string, name string"),
        frame(REPORTS, "ticker string, fiscal_year int"), frame(figures, "ticker string, fiscal_year int, figure string"),
    )
    return [r.text for r in out.orderBy("place").collect()]


REV, RISK, NET, BUS = (t[2].replace("{name}", "Apple Inc.").replace("{year}", "%d") for t in suggestions.TOPICS[:4])


@pytest.mark.parametrize(
    ("question", "year", "asked", "figures", "want"),
    [
        ("What was Apple's total revenue?", 2021, (), REVENUE, [RISK % 2021, REV % 2020, REV % 2024]),
        ("main RISK factors", 2020, (), (), [REV % 2020, RISK % 2019, NET % 2020]),
        ("main risk factors", 2019, (), (), [REV % 2019, NET % 2019, BUS % 2019]),
        ("total revenue", 2024, (), REVENUE, [REV % 2023]),
        ("Who audited Apple", 2021, (), REVENUE, [REV % 2021, REV % 2024, RISK % 2021]),
        ("total revenue", 2024, (), [*REVENUE, ("AAPL", 2024, "Net Income")], [NET % 2024, REV % 2023]),
        ("main risk factors", 2021, [("Apple's sales", 2021), ("who?", 2021)], REVENUE, [NET % 2021, RISK % 2020, REV % 2024]),
        ("main risk factors", 2021, [("sales", 2024), ("risk", 2020)], REVENUE, [REV % 2021, NET % 2021, BUS % 2021]),
        ("revenue", 2015, (), REVENUE, []), ("revenue", None, (), REVENUE, []),
    ],
)
def test_suggestions(spark, question, year, asked, figures, want):
    assert suggested(spark, question, year, asked, figures) == want


def test_no_suggestions_for_others(spark):
    assert suggested(spark, "revenue", 2021, ticker=None) == [] and suggested(spark, "revenue", 2021, ticker="TSLA") == []


def day(text):
    return datetime.date.fromisoformat(text) if text else None


FILINGS = [
    ("AAPL_2019_10K", 2019, "2019-09-28"), ("AAPL_2020_10K", 2020, "2020-09-26"), ("DLTR_2019_10K", 2019, "2020-02-01"), ("DLTR_2020_10K", 2020, "2021-01-30"), ("FB_2021_10K", 2021, "2021-12-31"),
    ("ATVI_2020_10K", 2020, None), ("ODD_2019_10K", 2019, "2019-12-31"), ("ODD_2020_10K", 2021, "2020-12-31"),
]


def companies(spark, *overrides):
    filings = spark.createDataFrame([(d, d.split("_")[0], y, day(e)) for d, y, e in FILINGS], "doc_id string, ticker string, fiscal_year int, fiscal_year_end date")
    first = spark.createDataFrame([("AAPL_2019_10K", "apple-inc", "Apple Inc."), ("AAPL_2020_10K", "later", "Later")], "doc_id string, company string, company_name string")
    return coverage.companies(filings, first, spark.createDataFrame(list(overrides), "ticker string, ticker_yahoo string, fiscal_year_rule string, note string"))


def test_companies_and_problems(spark):
    rows, problems = companies(spark, ("fb", "META", "", "Ticker changed"), ("ATVI", None, "most_months", None), ("ZZZ", "Z", None, None))
    assert sorted(tuple(r) for r in rows.collect()) == [
        ("AAPL", "AAPL", "apple-inc", "", "end_year", "Apple Inc."), ("ATVI", "ATVI", "", "", "most_months", ""), ("DLTR", "DLTR", "", "", "most_months", ""), ("FB", "META", "", "Ticker changed", "end_year", ""),
    ]
    assert sorted(tuple(r) for r in problems.collect()) == [
        ("ATVI", "no 10-K with a fiscal year end date; most_months assumed"), ("ODD", "no rule gives the fiscal years of its 10-Ks (2019 ended 2019-12-31, 2021 ended 2020-12-31); left out"),
    ]
    rows, problems = companies(spark, ("AAPL", None, "lunar", None), ("DLTR", None, "end_year", None))
    assert sorted(r.ticker_10k for r in rows.collect()) == ["ATVI", "FB"]
    told = {r.ticker: r.problem for r in problems.collect()}
    assert told["AAPL"] == "unknown fiscal_year_rule 'lunar'; left out" and told["DLTR"] == "rule end_year does not match its 10-Ks; left out" and told["ATVI"].endswith("end_year assumed")


def test_coverage(spark):
    rows, _ = companies(spark)
    statements = [
        ("AAPL", "income_stmt", "Total Revenue", "2023-09-30", "5"), ("AAPL", "income_stmt", "Net Income", "2021-09-30", "1"), ("AAPL", "income_stmt", "Tax", "2020-09-30", "1"), ("AAPL", "balance_sheet", "Total Revenue", "2019-09-30", "1"),
        ("AAPL", "cashflow", "Free Cash Flow", "2022-09-30", "nan"), ("AAPL", "cashflow", "Free Cash Flow", "2022-09-30", None), ("DLTR", "balance_sheet", "Total Debt", "2023-01-31", "2"),
    ]
    statements = spark.createDataFrame([(t, k, f, day(e), v) for t, k, f, e, v in statements], "ticker string, kind string, figure string, period_end date, value string")
    info = spark.createDataFrame([("AAPL", "Apple", "USD", None), ("FB", None, None, "Timeout: x")], "ticker string, name_on_yahoo string, currency string, error string")
    found = {r.ticker_10k: r for r in coverage.coverage(rows, coverage.statement_values(statements, rows), info).collect()}
    a, d = found["AAPL"], found["DLTR"]
    assert (a.status, a.income_years, a.balance_years, a.cashflow_years, a.latest_fiscal_year, a.years_after_2021, a.name_on_yahoo) == ("ok", "2021 2023", "", "", 2023, "2023", "Apple")
    assert a.missing_figures == "Gross Profit; Operating Income; Total Assets; Total Debt; Stockholders Equity; Operating Cash Flow; Free Cash Flow"
    assert (d.status, d.balance_years, d.years_after_2021) == ("ok", "2022", "2022")
    assert (found["FB"].status, found["FB"].error, found["FB"].missing_figures, found["FB"].latest_fiscal_year) == ("error", "Timeout: x", "", None) and found["ATVI"].status == "no_data"
