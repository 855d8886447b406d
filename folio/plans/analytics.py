"""Profiles, selections and annual figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import amount, fiscal_year
from ..operators import figures, names, profile
from . import query, table


@query(r"""SELECT lang, source, count(*) AS n_docs, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, min(length(coalesce(text, ''))) AS min_chars, max(length(coalesce(text, ''))) AS max_chars,
CAST(floor(avg(length(coalesce(text, '')))) AS BIGINT) AS mean_chars, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\S+'))) AS BIGINT) AS words,
CAST(sum(round_even(length(coalesce(text, '')) / 1000.0, 0)) AS BIGINT) AS est_chunks, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS blank FROM documents GROUP BY lang, source""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT CASE WHEN year(o_orderdate) < 1994 THEN '<=1993' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").groupBy(F.when(year < 1994, "<=1993").otherwise(year.cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev(o_totalprice), 6) AS std, min(o_totalprice) AS low,
round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.75), 6) AS p75, max(o_totalprice) AS high FROM orders""")
def describe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe(table(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source")
def pivot_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def size_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("SELECT o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 3")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.complete(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""WITH y AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders), g AS (SELECT o_custkey, min(y) AS first, max(y) AS last, list(y) AS have FROM y GROUP BY o_custkey)
SELECT o_custkey, first, last, array_to_string(list_filter([1993, 1994, 1995], lambda x: NOT list_contains(have, x)), ',') AS missing FROM g""")
def missing_target_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    return profile.missing_values(orders, "o_custkey", "y", [1993, 1994, 1995]).withColumns({c: F.col(c).cast("long") for c in ("first", "last")})


@query("""SELECT c_nationkey, arg_min(c_name, (-c_acctbal, c_name)) AS c_name, max(c_acctbal) AS c_acctbal FROM customer GROUP BY c_nationkey ORDER BY c_acctbal DESC, c_nationkey LIMIT 10""")
def argmax_rank_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rank_by_best(table(spark, sf_dir, "customer"), "c_nationkey", "c_name", "c_acctbal", 10)


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, o_orderpriority AS item, o_totalprice FROM orders WHERE year(o_orderdate) IN (1996, 1997, 1998)),
p(item, priority) AS (VALUES ('5-LOW', 0), ('2-HIGH', 1), ('1-URGENT', 2)),
g AS (SELECT o_custkey, count(DISTINCT y) AS n, min(priority) AS priority, min(CASE WHEN priority IS NOT NULL THEN o.item END) AS item, sum(CAST(o_totalprice AS DECIMAL(15, 2))) AS o_totalprice FROM o LEFT JOIN p ON p.item = o.item GROUP BY o_custkey)
SELECT CAST(row_number() OVER (ORDER BY priority, o_custkey) AS INTEGER) AS rank, o_custkey, item, CAST(round(o_totalprice, 1) AS DOUBLE) AS o_totalprice FROM g WHERE n = 3 AND priority IS NOT NULL ORDER BY priority, o_custkey LIMIT 35""")
def division_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders in all of three years, those of a preferred order priority first (the reference's top 35)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("item"), F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice"))
    priorities = spark.createDataFrame([("5-low", 0), ("2-high", 1), ("1-urgent", 2)], "item string, priority int")
    out = profile.complete_by_priority(orders, "o_custkey", "y", [1996, 1997, 1998], "item", priorities, 35, "o_totalprice")
    return out.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


HEADINGS = """CASE l_linenumber % 3 WHEN 0 THEN 'ITEM ' WHEN 1 THEN 'Item ' ELSE 'item ' END || l_linenumber || CASE WHEN l_returnflag = 'A' THEN 'A.' WHEN l_returnflag = 'N' THEN ' — x' ELSE ': Y' END"""


@query(f"""WITH h AS (SELECT l_suppkey AS doc_id, {HEADINGS} AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i FROM lineitem),
f AS (SELECT doc_id, i, CASE WHEN line LIKE 'ITEM %' THEN 'MAYUSCULAS' WHEN line LIKE 'Item %' THEN 'Capitalizado' ELSE 'minusculas' END || ' + ' || chr(39) || regexp_extract(line, '[.:—]') || chr(39) AS form FROM h WHERE i < 200),
c AS (SELECT doc_id, form, count(*) AS n, min(i) AS first FROM f GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INTEGER) AS place, form, n FROM c QUALIFY place <= 5""")
def heading_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's items as a document of headings; the first 200 and the five commonest forms are the feature's own limits."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey", F.expr(HEADINGS).alias("line")).alias("l"))
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    return profile.item_formats(docs)


@query("SELECT l_orderkey, l_partkey, l_linenumber, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem) WHERE n > 1")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.repeated_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"])


@query("""SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(substr(text, 1, 50000)), '[a-z]+')), ['the', 'and', 'of', 'to', 'in', 'for', 'that', 'with', 'our', 'we'])) AS score FROM documents""")
def language_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", profile.english_score(F.col("text")).alias("score"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://(?:www\.)?([^/.]+)\.', 1) AS company, regexp_extract(url, '^https?://[^/]*\.([a-z]+)/', 1) AS exchange,
upper(regexp_extract(url, '^https?://[^/]*/([a-z]{2})/', 1)) AS ticker, TRY_CAST(regexp_extract(url, '/(\d+)(?:[./?#]|$)', 1) AS BIGINT) AS number,
round(octet_length(encode(html)) / 1048576.0, 3) AS size_mb FROM pages WHERE regexp_matches(url, '^https?://[^/]+/[a-z]{2}/\d+')""")
def html_inventory_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^https?://[^/]+/[a-z]{2}/\d+"))
    part = lambda p: F.regexp_extract("url", p, 1)
    return pages.select(
        "page_id", part(r"^https?://(?:www\.)?([^/.]+)\.").alias("company"), part(r"^https?://[^/]*\.([a-z]+)/").alias("exchange"),
        F.upper(part(r"^https?://[^/]*/([a-z]{2})/")).alias("ticker"), part(r"/(\d+)(?:[./?#]|$)").try_cast("long").alias("number"),
        F.round(F.octet_length("html") / 1048576, 3).alias("size_mb"),
    )


@query("""SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment NOT IN (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 9990)
AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500) GROUP BY n_name""")
def candidates_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    used = customers.where("c_acctbal > 9990").select("c_mktsegment").distinct()
    taken = table(spark, sf_dir, "supplier").where("s_acctbal > 9500").select(F.col("s_nationkey").alias("c_nationkey"))
    left = customers.join(used, "c_mktsegment", "left_anti").join(taken, "c_nationkey", "left_anti")
    return left.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, year(o_orderdate) AS fiscal_year FROM orders")
def fiscal_year_end_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fiscal_year(F.col("o_orderdate").cast("date"), "end_year").cast("long").alias("fiscal_year"))


@query("SELECT o_orderkey, year(CAST(o_orderdate AS DATE) - 182) AS fiscal_year FROM orders")
def fiscal_year_most_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", fiscal_year(F.col("o_orderdate").cast("date"), "most_months").cast("long").alias("fiscal_year"))


@query("""WITH f AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS e, CASE WHEN o_custkey % 3 = 0 THEN year(o_orderdate) ELSE year(CAST(o_orderdate AS DATE) - 182) END AS y FROM orders)
SELECT o_custkey, CASE WHEN bool_and(year(e) = y) THEN 'end_year' WHEN bool_and(year(e - 182) = y) THEN 'most_months' END AS rule, false AS assumed FROM f GROUP BY o_custkey""")
def rule_choice_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("o_orderdate").cast("date")
    rows = table(spark, sf_dir, "orders").select("o_custkey", end.alias("e"), F.when(F.col("o_custkey") % 3 == 0, F.year(end)).otherwise(F.year(F.date_sub(end, 182))).alias("y"))
    return figures.rule_for(rows, "o_custkey", "e", "y")


@query("""SELECT p_partkey, 'p_retailprice' AS figure, p_retailprice AS value FROM part WHERE p_retailprice IS NOT NULL UNION ALL SELECT p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part WHERE p_size IS NOT NULL""")
def figures_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size"))
    return figures.unpivot(part, ["p_partkey"], ["p_retailprice", "size"])


@query("""SELECT CAST(o_custkey AS VARCHAR) AS ticker, o_orderpriority AS figure, year(o_orderdate) AS fiscal_year, max(o_totalprice) AS value FROM orders GROUP BY ALL""")
def figures_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    yearly = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("ticker"), F.col("o_orderpriority").alias("figure"), F.year("o_orderdate").cast("string").alias("y")).agg(F.max("o_totalprice").alias("v"))
    by_figure = yearly.groupBy("ticker", "figure").agg(F.map_from_entries(F.collect_list(F.struct("y", "v"))).alias("m"))
    written = by_figure.groupBy("ticker").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("figure", "m")))).alias("json"))
    read = written.select("ticker", F.from_json("json", "map<string,map<string,double>>").alias("figures"))
    return figures.snapshot_values(read).withColumn("fiscal_year", F.col("fiscal_year").cast("long"))


AMOUNT = """format('{:,}', CAST(round_even(v, 0) AS BIGINT)) || ' USD' || CASE WHEN v >= 1e9 THEN ' (about ' || format('{:,.1f}', v / 1e9) || ' billion)'
  WHEN v >= 1e6 THEN ' (about ' || format('{:,.1f}', v / 1e6) || ' million)' ELSE '' END"""


@query(f"SELECT o_orderkey, {AMOUNT} AS amount FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END) AS v FROM orders)")
def amount_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as they are, by the hundred and by the hundred thousand, so that all three forms occur."""
    times = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 100).otherwise(100000)
    return table(spark, sf_dir, "orders").select("o_orderkey", amount(F.col("o_totalprice").cast("double") * times, F.lit("USD")).alias("amount"))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey")
def latest_name_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.latest_by(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH y AS (SELECT o_custkey, list_sort(list(DISTINCT year(o_orderdate))) AS ys FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN len(ys) > 2 AND ys[-1] - ys[1] = len(ys) - 1 THEN ys[1] || ' to ' || ys[-1] ELSE array_to_string(ys, ', ') END AS years FROM y""")
def missing_years_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.year("o_orderdate"))).alias("ys"))
    return years.select("o_custkey", figures.years_text(F.col("ys")).alias("years"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Supplier ' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || ' Corp.' WHEN s_suppkey % 3 = 1 THEN 'Maker ' || chr(CAST(65 + s_suppkey % 26 AS INTEGER)) || ' Holdings' END AS name,
CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN true ELSE false END AS named FROM supplier""")
def official_company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the suppliers has its name over the caption, a third in the cover's block, in capitals that the text spells
    otherwise; the rest has none. Every fifth has no slug to look for."""
    rows = table(spark, sf_dir, "supplier")
    kind, letter = F.col("s_suppkey") % 3, F.char(65 + F.col("s_suppkey") % 26)
    over = F.concat(F.lit("FORM 10-K\n1 Other Inc\nSUPPLIER "), letter, F.lit(" CORP. | 12-345\n\n(Exact name of registrant as specified in its charter)"))
    block = F.concat(F.lit("FORM 10-K | MAKER "), letter, F.lit(" HOLDINGS\nof 1999"))
    rows = rows.withColumns({"cover": F.when(kind == 0, over).when(kind == 1, block).otherwise("no name here"), "text": F.concat(F.lit("Supplier "), letter, F.lit(" Corp. and Maker "), letter, F.lit(" Holdings sell."))})
    slug = F.when(F.col("s_suppkey") % 5 == 0, "unknown").otherwise("maker-inc")
    rows = names.with_official_name(rows, F.col("cover"), F.col("text"), F.lit("absent"), "name")
    return rows.select("s_suppkey", "name", names.names_company(F.col("cover"), F.lit("QQQ"), slug).alias("named"))


@query("""SELECT o_orderkey AS doc_id, coalesce(chunks, 0) AS chunks, coalesce(text_chunks, 0) AS text_chunks, coalesce(table_chunks, 0) AS table_chunks, coalesce(avg_words, 0) AS avg_words,
coalesce(max_words, 0) AS max_words, coalesce(unknown_section_share, 0) AS unknown_section_share, coalesce(sections, 0) AS sections FROM orders LEFT JOIN (
SELECT l_orderkey, count(*) AS chunks, count(*) FILTER (WHERE l_linestatus = 'F') AS text_chunks, count(*) FILTER (WHERE l_linestatus = 'O') AS table_chunks, CAST(round_even(avg(l_quantity), 0) AS BIGINT) AS avg_words,
CAST(max(l_quantity) AS BIGINT) AS max_words, round_even(avg(CAST(l_returnflag = 'N' AS DOUBLE)), 2) AS unknown_section_share, count(DISTINCT l_returnflag) AS sections
FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "F", "text").otherwise("table")
    section = F.when(F.col("l_returnflag") == "N", "Unknown").otherwise(F.col("l_returnflag"))
    chunks = table(spark, sf_dir, "lineitem").where("l_partkey % 3 = 0").select(
        F.col("l_orderkey").alias("doc_id"), kind.alias("content_type"), section.alias("section"), F.repeat(F.lit("word "), F.col("l_quantity").cast("int")).alias("text")
    )
    return profile.document_stats(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")), chunks)


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 1 AND c_nationkey % 2 = 0 AND c_acctbal <> 0""")
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "EQUITY")
    exchange = F.when(F.col("c_nationkey") % 3 == 1, "NGM").otherwise("NYQ")
    country = F.when(F.col("c_nationkey") % 2 == 0, "United States").otherwise("Peru")
    return table(spark, sf_dir, "customer").where(profile.eligible(F.lit(None).cast("string"), kind, exchange, country, F.col("c_acctbal"))).select("c_custkey")
