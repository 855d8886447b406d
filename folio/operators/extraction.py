"""A filing's lines to the document that is indexed: checked, cut to the report, cleaned and named, or rejected with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fiscal_year_end
from . import names, sections

#: Characters a page has on average unless it is a scan, and the share of garbled pages that is too much.
LEAST_CHARS, MOST_GARBLED = 100, 0.2
#: Why a document is left out; of several reasons the first counts.
SCANNED, GARBLED, OTHER_COMPANY, NO_REPORT = "scanned", "unreadable text", "wrong company", "out of scope"


def garbled_pages(pages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """pages(doc_id, page, text), vocabulary(word) -> (doc_id, bad, judged): pages with few known words, of those with words
    enough to judge; documents without such pages are left out."""
    shares = sections.known_word_share(pages, vocabulary)
    return shares.groupBy("doc_id").agg(F.count_if("unreadable").alias("bad"), F.count("share").alias("judged")).where("judged > 0")


def extract(lines: DataFrame, meta: DataFrame, vocabulary: DataFrame, scope: str = "10k") -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines(doc_id, page, line_no, line), meta(doc_id, ticker, company, ...), vocabulary(word) -> (documents, lines, rejected).

    documents: meta with n_pages, doc_type, first and last (the report's pages, or null), company_name and fiscal_year_end.
    lines: those of accepted documents, of the report's pages (or all, if scope is `all`), without page numbers and repeated
    edges. rejected(doc_id, reason): scanned, unreadable text (of the report's pages), wrong company (its cover names another),
    or out of scope (no report inside, unless scope is `all`). Documents that meta has not are left out.

    The checks are columns of one row a document; pages are put together once, and only accepted documents' lines are cleaned."""
    lines = lines.join(meta.select("doc_id").distinct(), "doc_id", "left_semi")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    pages = lines.groupBy("doc_id", "page").agg(text.alias("text"), F.sum(F.length("line")).alias("chars"))
    ranges = sections.report_range(pages)
    judged = pages.join(ranges.select("doc_id", "first", "last"), "doc_id").where(F.col("first").isNull() | F.col("page").between(F.col("first"), F.col("last")))
    in_order = lambda name, keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("page", "text")))), lambda x: x["text"]), "\n").alias(name)
    start = F.coalesce("first", F.lit(1))
    placed = pages.join(ranges, "doc_id")
    whole = placed.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.sum("chars").alias("chars"), F.first("doc_type").alias("doc_type"), F.first("first").alias("first"), F.first("last").alias("last"),
        F.max(F.when(F.col("page") == F.col("first"), F.col("text"))).alias("first_page"), in_order("cover", F.col("page").between(start, start + 1)),
        in_order("body", F.col("page") >= start if scope == "all" else F.col("page").between(F.col("first"), F.col("last"))),
    )
    told = whole.join(garbled_pages(judged, vocabulary), "doc_id", "left").join(meta, "doc_id")
    reason = (
        F.when(F.col("chars") / F.col("n_pages") < LEAST_CHARS, SCANNED)
        .when(F.col("bad") / F.col("judged") > MOST_GARBLED, GARBLED)
        .when(names.wrong_company(F.coalesce(sections.is_cover(F.col("first_page")), F.lit(False)), F.col("first_page"), F.col("ticker"), F.col("company")), OTHER_COMPANY)
        .when(F.col("first").isNull() & F.lit(scope != "all"), NO_REPORT)
    )
    told = told.withColumn("reason", reason)
    good = names.with_official_name(told.where("reason is null"), F.col("cover"), F.col("body"), F.col("company"))
    documents = good.select(*meta.columns, "n_pages", "doc_type", "first", "last", "company_name", fiscal_year_end(F.col("first_page")).alias("fiscal_year_end"))
    kept = lines.join(told.where("reason is null").select("doc_id", "first", "last"), "doc_id")
    kept = kept if scope == "all" else kept.where(F.col("page").between(F.col("first"), F.col("last")))
    return documents, sections.clean_lines(kept.select("doc_id", "page", "line_no", "line")), told.where("reason is not null").select("doc_id", "reason")
