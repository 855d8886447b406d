"""Text as columns: words, cleaning, names, dates and amounts. All of these stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop words of the public Lucene analyzer.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()

WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column, stop_words: bool = True) -> Column:
    """Lower-cased runs of letters and digits, without stop words. Null: none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS)) if stop_words else found


def collapse(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def flatten_cells(text: Column) -> Column:
    return collapse(F.replace(text, F.lit(" | "), F.lit(" ")))


def join_hyphenated(text: Column) -> Column:
    """A word broken at a hyphen and a line end is joined, and keeps its hyphen."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1-$2")


def normalise_white_space(text: Column) -> Column:
    """No-break blanks to blanks, zero-width characters dropped, runs of blanks and of over two newlines shortened."""
    text = F.regexp_replace(F.translate(text, " ", " "), "[​‌‍﻿]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " ?\n ?", "\n")
    return F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def is_page_number(line: Column) -> Column:
    return F.trim(line).rlike(r"(?i)^((page\s+)?\d{1,3}|[ivxlc]{1,6})$")


def slug_name(slug: Column) -> Column:
    """new-york-co -> New York Co"""
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def estimated_tokens(text: Column, chars_per_token: int = 4) -> Column:
    return F.ceil(F.length(text) / chars_per_token).cast("long")


def year_candidates(question: Column) -> Column:
    """Distinct years 1900 to 2199 that stand alone among digits, in order."""
    found = F.regexp_extract_all(question, F.lit(r"(?<!\d)((?:19|20|21)\d{2})(?!\d)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def listed(values: Column, last: str = "or") -> Column:
    """a / a or b / a, b, or c"""
    texts = F.transform(values, lambda v: v.cast("string"))
    n = F.size(texts)
    most = F.array_join(F.slice(texts, 1, F.greatest(n - 1, F.lit(0))), ", ")
    final = F.try_element_at(texts, F.when(n > 0, n))
    return F.when(n <= 1, F.coalesce(final, F.lit(""))).when(n == 2, F.concat(most, F.lit(f" {last} "), final)).otherwise(F.concat(most, F.lit(f", {last} "), final))


def amount(value: Column, currency: Column) -> Column:
    """1,234,567,890 USD (about 1.2 billion)"""
    size = F.abs(value)
    about = F.when(size >= 1e9, F.concat(F.lit(" (about "), F.format_number(value / 1e9, 1), F.lit(" billion)"))).when(
        size >= 1e6, F.concat(F.lit(" (about "), F.format_number(value / 1e6, 1), F.lit(" million)"))
    )
    return F.concat(F.format_number(value, 0), F.lit(" "), currency, F.coalesce(about, F.lit("")))


def fiscal_year(end: Column, rule: str) -> Column:
    """end_year: the year it ends in. most_months: the year that holds most of it."""
    if rule not in ("end_year", "most_months"):
        raise ValueError(f"unknown fiscal year rule: {rule}")
    return F.year(end if rule == "end_year" else F.date_sub(end, 182))


def fiscal_year_end(cover: Column) -> Column:
    """The date behind `for the fiscal year ended` on a cover; null if there is none or it isn't a date."""
    pattern = r"(?i)for\s+the\s+(?:fiscal\s+)?year\s+ended:?\s+([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{1,2})\s*,?\s+(\d{4})"
    part = lambda i: F.regexp_extract(flatten_cells(cover), pattern, i)
    text = F.concat_ws(" ", F.initcap(part(1)), part(2), part(3))
    return F.when(part(3) != "", F.try_to_date(text, "MMM d yyyy"))


def year_check(file_year: Column, end: Column) -> Column:
    """ok; check: it ends in January or February of the next year; mismatch; not found."""
    return (
        F.when(end.isNull(), "not found").when(F.year(end) == file_year, "ok")
        .when((F.year(end) == file_year + 1) & (F.month(end) <= 2), "check").otherwise("mismatch")
    )


def excerpt(wanted: Column, text: Column, chars: int = 200) -> Column:
    """The wanted words if the text has them verbatim, else the text's beginning."""
    strip = lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))
    return F.when((strip(wanted) != "") & text.contains(strip(wanted)), strip(wanted)).otherwise(strip(F.substring(text, 1, chars)))


def escape_document_tags(text: Column) -> Column:
    """Tags named document inside a text can't end the document they are in."""
    return F.regexp_replace(text, r"(?i)<(\s*/?\s*document\b)", "&lt;$1")


def sentence_units(text: Column) -> Column:
    """Lines, cut behind sentence ends before capitals."""
    lines = F.split(text, "\n")
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=\p{Lu})"))), lambda x: F.trim(x) != "")
