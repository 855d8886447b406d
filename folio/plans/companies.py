"""Questions to ask next, and what is known of each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coverage, suggestions
from . import query, table

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
ASKED = ("What were its net sales?", "Which RISKS are there?", "Was there a profit?", "Who audited it?", "And the cash flow?")
FIGURES = ("Total Revenue", "Net Income", "Operating Cash Flow", "Total Assets", "Total Debt")
TOPIC_ROWS = ", ".join(f"({i}, '{t[2]}', {repr(t[3]) if t[3] else 'NULL'})" for i, t in enumerate(suggestions.TOPICS, 1))
#: The topics of ASKED: of net sales, risks, profit, none, cash flow.
TOPIC_OF = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 5 END"


def by_priority(values: tuple[str, ...]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in zip(PRIORITIES, values, strict=True) for x in pair]), F.col("o_orderpriority"))


@query(f"""WITH t(topic, form, figure) AS (VALUES {TOPIC_ROWS}), o AS (SELECT *, 'C' || o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
r AS (SELECT DISTINCT ticker, y FROM o WHERE o_orderstatus = 'F'),
f AS (SELECT DISTINCT ticker, y, CASE o_orderpriority WHEN '1-URGENT' THEN 'Total Revenue' WHEN '2-HIGH' THEN 'Net Income' WHEN '3-MEDIUM' THEN 'Operating Cash Flow' WHEN '4-NOT SPECIFIED' THEN 'Total Assets' ELSE 'Total Debt' END AS figure FROM o WHERE o_orderstatus = 'O'),
q AS (SELECT o_orderkey AS qid, ticker, y, {TOPIC_OF} AS topic FROM o WHERE EXISTS (SELECT 1 FROM r WHERE r.ticker = o.ticker AND r.y = o.y) OR EXISTS (SELECT 1 FROM f WHERE f.ticker = o.ticker AND f.y = o.y)),
done AS (SELECT qid, ticker, y, topic FROM q WHERE topic IS NOT NULL UNION SELECT o_orderkey, ticker, y - 1, 3 FROM o UNION SELECT o_orderkey, ticker, y, 4 FROM o WHERE o_totalprice > 150000),
late AS (SELECT f.ticker, max(f.y) AS later FROM f LEFT JOIN r ON r.ticker = f.ticker AND r.y = f.y WHERE r.ticker IS NULL GROUP BY f.ticker),
c AS (SELECT qid, ticker, 1 AS grp, t.topic AS pref, y, t.topic FROM q, t WHERE q.topic IS DISTINCT FROM t.topic UNION ALL SELECT qid, ticker, 2, 0, y - 1, topic FROM q WHERE topic IS NOT NULL
  UNION ALL SELECT qid, q.ticker, 3, 0, later, CASE WHEN EXISTS (SELECT 1 FROM f JOIN t ON t.figure = f.figure WHERE f.ticker = q.ticker AND f.y = later AND t.topic = q.topic) THEN q.topic ELSE 1 END
  FROM q JOIN late ON late.ticker = q.ticker JOIN r ON r.ticker = q.ticker AND r.y = q.y),
u AS (SELECT c.* , t.form FROM c JOIN t ON t.topic = c.topic LEFT JOIN r ON r.ticker = c.ticker AND r.y = c.y LEFT JOIN f ON f.ticker = c.ticker AND f.y = c.y AND f.figure = t.figure
  LEFT JOIN done d ON d.qid = c.qid AND d.ticker = c.ticker AND d.y = c.y AND d.topic = c.topic WHERE (r.ticker IS NOT NULL OR f.ticker IS NOT NULL) AND d.qid IS NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, grp ORDER BY pref) AS turn FROM u),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY least(turn, 2), grp, pref) AS place FROM n)
SELECT qid, CAST(place AS INTEGER) AS place, replace(replace(form, '{{year}}', CAST(y AS VARCHAR)), '{{name}}', c_name) AS text FROM p JOIN customer ON 'C' || c_custkey = ticker WHERE place <= 3""")
def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order asks about its customer and year; filled orders are reports, open ones figures by their priority."""
    orders = table(spark, sf_dir, "orders").withColumn("ticker", F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).withColumn("fiscal_year", F.year("o_orderdate"))
    keys = ["ticker", "fiscal_year"]
    questions = orders.select(F.col("o_orderkey").alias("qid"), by_priority(ASKED).alias("question"), *keys)
    profit = orders.select(F.col("o_orderkey").alias("qid"), F.lit("net profit").alias("question"), "ticker", F.col("fiscal_year") - 1)
    overview = orders.where("o_totalprice > 150000").select("o_orderkey", F.lit("an Overview"), *keys)
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("name"))
    figures = orders.where("o_orderstatus = 'O'").select(*keys, by_priority(FIGURES).alias("figure"))
    asked = profit.union(overview).toDF("qid", "question", *keys)
    return suggestions.suggest(questions, asked, names, orders.where("o_orderstatus = 'F'").select(*keys), figures)


LATER = "INTERVAL 26 YEAR"


@query(f"""WITH l AS (SELECT l_suppkey AS k, 'S' || l_suppkey AS ticker, CAST(l_shipdate + {LATER} AS DATE) AS shipped, CAST(l_shipdate + {LATER} AS DATE) + 40 AS received, l_linenumber AS n FROM lineitem),
e AS (SELECT k, ticker, year(shipped) AS sy, max(shipped) AS ended FROM l GROUP BY ALL),
g AS (SELECT *, CASE WHEN k % 3 = 0 THEN year(ended - 182) ELSE year(ended) END + CASE WHEN k % 7 = 0 AND sy = 2021 THEN 1 ELSE 0 END AS fy FROM e),
c AS (SELECT k, ticker, bool_and(year(ended) = fy) AS a, bool_and(year(ended - 182) = fy) AS b FROM g GROUP BY ALL),
rows_ AS (SELECT c.*, CASE WHEN a THEN 'end_year' ELSE 'most_months' END AS rule FROM c WHERE a OR b),
s AS (SELECT DISTINCT ticker, k, CASE n WHEN 1 THEN 'Total Revenue' WHEN 2 THEN 'Net Income' WHEN 3 THEN 'Total Assets' WHEN 4 THEN 'Free Cash Flow' ELSE 'Total Revenue' END AS figure,
  CASE WHEN n <= 2 THEN 'income_stmt' WHEN n = 4 THEN 'cashflow' ELSE 'balance_sheet' END AS kind, received FROM l),
v AS (SELECT s.ticker, kind, figure, CASE WHEN rule = 'end_year' THEN year(received) ELSE year(received - 182) END AS fy FROM s JOIN rows_ USING (ticker) WHERE (kind, figure) IN (('income_stmt', 'Total Revenue'), ('income_stmt', 'Net Income'), ('balance_sheet', 'Total Assets'), ('cashflow', 'Free Cash Flow'))),
h AS (SELECT ticker, array_to_string(list_sort(list(DISTINCT fy) FILTER (WHERE kind = 'income_stmt')), ' ') AS income_years, array_to_string(list_sort(list(DISTINCT fy) FILTER (WHERE kind = 'balance_sheet')), ' ') AS balance_years,
  array_to_string(list_sort(list(DISTINCT fy) FILTER (WHERE kind = 'cashflow')), ' ') AS cashflow_years, max(fy) AS latest, array_to_string(list_sort(list(DISTINCT fy) FILTER (WHERE fy > 2021)), ' ') AS after, list(DISTINCT figure) AS have FROM v GROUP BY ticker)
SELECT r.ticker AS ticker_10k, r.ticker AS ticker_yahoo, s_name AS company, CASE WHEN latest IS NULL THEN 'no_data' ELSE 'ok' END AS status, s_name AS name_on_yahoo, 'USD' AS currency, coalesce(income_years, '') AS income_years,
  coalesce(balance_years, '') AS balance_years, coalesce(cashflow_years, '') AS cashflow_years, CAST(latest AS INTEGER) AS latest_fiscal_year, coalesce(after, '') AS years_after_2021,
  CASE WHEN latest IS NULL THEN '' ELSE array_to_string(list_filter(['Total Revenue', 'Gross Profit', 'Operating Income', 'Net Income', 'Total Assets', 'Total Debt', 'Stockholders Equity', 'Operating Cash Flow', 'Free Cash Flow'], lambda x: NOT list_contains(have, x)), '; ') END AS missing_figures,
  '' AS note, '' AS error FROM rows_ r LEFT JOIN h USING (ticker) LEFT JOIN supplier ON s_suppkey = k""")
def company_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies: a year's last shipment ends it, a third names years by most months, some contradict themselves."""
    later = lambda c: F.add_months(F.col(c).cast("date"), 12 * 26)
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), later("l_shipdate").alias("shipped"), F.date_add(later("l_shipdate"), 40).alias("received"), F.col("l_linenumber").alias("n"))
    ended = items.groupBy("k", "ticker", F.year("shipped").alias("sy")).agg(F.max("shipped").alias("fiscal_year_end"))
    own = F.when(F.col("k") % 3 == 0, F.year(F.date_sub("fiscal_year_end", 182))).otherwise(F.year("fiscal_year_end"))
    year = own + F.when((F.col("k") % 7 == 0) & (F.col("sy") == 2021), 1).otherwise(0)
    filings = ended.select(F.concat("ticker", F.lit("_10K")).alias("doc_id"), "ticker", year.alias("fiscal_year"), "fiscal_year_end")
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), "s_name")
    first = suppliers.select(F.concat("ticker", F.lit("_10K")).alias("doc_id"), F.col("s_name").alias("company"), F.col("s_name").alias("company_name"))
    rows, _ = coverage.companies(filings, first, spark.createDataFrame([], "ticker string, ticker_yahoo string, fiscal_year_rule string, note string"))
    n = F.col("n")
    figure = F.when(n == 2, "Net Income").when(n == 3, "Total Assets").when(n == 4, "Free Cash Flow").otherwise("Total Revenue")
    kind = F.when(n <= 2, "income_stmt").when(n == 4, "cashflow").otherwise("balance_sheet")
    statements = items.select("ticker", kind.alias("kind"), figure.alias("figure"), F.col("received").alias("period_end"), F.lit(1.0).alias("value"))
    info = suppliers.select("ticker", F.col("s_name").alias("name_on_yahoo"), F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("error"))
    return coverage.coverage(rows, coverage.statement_values(statements, rows), info)
