"""Corpus profiling and the selection of companies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Frequent words that mark English text.
ENGLISH_MARKERS = ("the", "and", "of", "to", "in", "for", "that", "with", "our", "we")
#: The form items that are counted, and the exchange codes of one exchange.
KEY_ITEMS = ("1", "1A", "3", "5", "7", "7A", "8")
EXCHANGES = ("NMS", "NGM", "NCM")


def profile(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents, characters, words, estimated chunks and blank texts by key."""
    chars = F.coalesce(F.length(text), F.lit(0))
    words = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return docs.groupBy(*keys).agg(
        F.count("*").alias("n_docs"), F.sum(chars).alias("chars"), F.min(chars).cast("long").alias("min_chars"), F.max(chars).cast("long").alias("max_chars"),
        F.floor(F.avg(chars)).alias("mean_chars"), F.sum(words).alias("words"), F.sum(F.bround(chars / 1000)).cast("long").alias("est_chunks"),
        F.count_if(F.trim(F.coalesce(text, F.lit(""))) == "").alias("blank"),
    )


#: Stretches of equal width between the least and the largest value.
STRETCHES = 4096


def percentiles(df: DataFrame, column: str, wanted: list[float]) -> DataFrame:
    """One row with p25 and so on, exact and linearly interpolated; null without values. Distinct values are counted by Spark and
    dealt by stretches of the range; only those stretches that hold a wanted place are put in order, each by itself, so no
    task has all values."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ends = df.select(F.col(column).cast("double").alias("v")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("all"))
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    dealt = values.join(F.broadcast(ends)).withColumn("at", F.when(F.col("high") > F.col("low"), F.floor(share * STRETCHES)).otherwise(F.lit(0).cast("long")))
    place = {p: F.lit(p) * (F.col("all") - 1) for p in wanted}
    sides = [side(place[p]).cast("long") for p in wanted for side in (F.floor, F.ceil)]
    holds = lambda first, n: reduce(Column.__or__, [(s >= first) & (s < first + n) for s in sides])
    sizes = dealt.groupBy("at", "all").agg(F.sum("n").alias("size"))
    before = F.sum("size").over(Window.orderBy("at")) - F.col("size")  # of STRETCHES + 1 rows
    chosen = sizes.withColumn("before", before).where(holds(F.col("before"), F.col("size"))).select("at", "before")
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("v"))
    placed = dealt.join(F.broadcast(chosen), "at").withColumn("first", F.col("before") + upto - F.col("n"))
    value = lambda s: F.max(F.when((s >= F.col("first")) & (s < F.col("first") + F.col("n")), F.col("v")))
    found = placed.agg(F.max("all").alias("all"), *[value(s).alias(f"s{i}") for i, s in enumerate(sides)])

    def between(i: int, p: float) -> Column:
        low, high = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}")
        over = place[p] - F.floor(place[p])
        return F.when(low == high, low).otherwise((1 - over) * low + over * high).alias(f"p{round(p * 100)}")

    return found.select(*[between(i, p) for i, p in enumerate(wanted)])


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, extremes and linearly interpolated quartiles."""
    x = F.col(column)
    rest = df.agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev(x), 6).alias("std"), F.min(x).cast("double").alias("low"), F.max(x).cast("double").alias("high"))
    both = rest.join(F.broadcast(percentiles(df, column, [0.25, 0.5, 0.75])))  # one row each
    return both.select("n", "mean", "std", "low", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "high")


def english_score(text: Column, chars: int = 50_000) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.substring(text, 1, chars)), F.lit("[a-z]+"), F.lit(0)))
    return F.size(F.array_intersect(found, F.array(*[F.lit(w) for w in ENGLISH_MARKERS]))).cast("long")


def complete(rows: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Relational division: the keys that have every wanted value."""
    return rows.where(F.col(value).isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def missing_values(rows: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """(key, first, last, missing): the wanted values that a key lacks, as text in order."""
    have = rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("have"), F.min(value).alias("first"), F.max(value).alias("last"))
    lacks = F.array_except(F.array(*[F.lit(w) for w in sorted(wanted)]), "have")
    return have.select(key, "first", "last", F.array_join(F.transform(lacks, lambda x: x.cast("string")), ",").alias("missing"))


def rank_by_best(rows: DataFrame, group: str, item: str, value: str, n: int) -> DataFrame:
    """Each group's item of the largest value (of equal ones the first item), then the n groups of the largest values."""
    first = F.min(F.struct((-F.col(value)).alias("v"), F.col(item)))
    best = rows.where(F.col(value).isNotNull()).groupBy(group).agg(first.alias("b"), F.max(value).alias(value))
    return best.select(group, F.col(f"b.{item}").alias(item), value).orderBy(F.desc(value), group).limit(n)


def complete_by_priority(rows: DataFrame, key: str, value: str, wanted: list, item: str, priorities: DataFrame, n: int, size: str) -> DataFrame:
    """rows(key, value, item, size), priorities(item, priority) -> (rank, key, item, size): the keys that have every wanted value
    and an item that has a priority, by their smallest priority and then by name, the first n. item: the first in order of a
    key's items that have a priority; size: the sum over its wanted rows, to one place. Items are compared in capitals."""
    own = rows.where(F.col(value).isin(wanted)).select(key, value, F.upper(item).alias("item"), size)
    ranked = own.join(priorities.select(F.upper("item").alias("item"), "priority").groupBy("item").agg(F.min("priority").alias("priority")), "item", "left")
    whole = ranked.groupBy(key).agg(
        F.count_distinct(value).alias("values"), F.min("priority").alias("priority"), F.min(F.when(F.col("priority").isNotNull(), F.col("item"))).alias("item"), F.round(F.sum(size), 1).alias(size)
    ).where((F.col("values") == len(set(wanted))) & F.col("priority").isNotNull())
    first = whole.orderBy("priority", key).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("priority", key))).select("rank", key, "item", size)  # of n rows


#: How a heading is written, as the report names it; headings that are looked at, and forms that are kept.
CASES = ("MAYUSCULAS", "Capitalizado", "minusculas")
FIRST_HEADINGS, MOST_FORMS = 200, 5


def item_formats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, place, form, n): how a document writes its first item headings, the most frequent forms
    first, of equally frequent ones the one met first. A form is the case of the heading and the sign behind it."""
    pattern = F.lit(r"(?i)\b(item\s+\d+[A-Z]?)\s*([.:\-—])")
    text = F.coalesce("text", F.lit(""))
    heads, signs = (F.slice(F.regexp_extract_all(text, pattern, F.lit(i)), 1, FIRST_HEADINGS) for i in (1, 2))
    case = lambda h: F.when(h == F.upper(h), CASES[0]).when(F.substring(h, 1, 1).rlike(r"\p{Lu}"), CASES[1]).otherwise(CASES[2])
    # Both in one array: inside the transform the text would be searched again for every heading.
    pairs = F.arrays_zip(heads.alias("head"), signs.alias("sign"))
    forms = F.transform(pairs, lambda x: F.concat(case(x["head"]), F.lit(" + '"), x["sign"], F.lit("'")))
    each = docs.select("doc_id", F.posexplode(forms).alias("at", "form"))
    counted = each.groupBy("doc_id", "form").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counted.withColumn("place", place).where(F.col("place") <= MOST_FORMS).select("doc_id", "place", "form", "n")


#: Fixed value: characters of a document's beginning that should name its company, year and form.
HEAD_CHARS = 20_000


def consistency(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ticker, fiscal_year) -> (doc_id, has_ticker, has_year, has_form): whether the document's beginning says
    what its name does. The window is the feature's own."""
    head = F.substring(F.coalesce("text", F.lit("")), 1, HEAD_CHARS)
    quoted = F.concat(F.lit("(?i)\\b"), F.regexp_replace("ticker", r"([^A-Za-z0-9])", r"\\$1"), F.lit("\\b"))
    year = F.concat(F.lit("\\b"), F.col("fiscal_year").cast("string"), F.lit("\\b"))
    return docs.select("doc_id", F.regexp_like(head, quoted).alias("has_ticker"), F.regexp_like(head, year).alias("has_year"), head.rlike(r"(?i)\b(form\s+10-?k|annual\s+report)\b").alias("has_form"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once, with the number of such rows."""
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1")


def candidates_not_used(candidates: DataFrame, used: DataFrame, company: str, ticker: str) -> DataFrame:
    """Companies that earlier batches have neither by name nor by any of their tickers."""
    by_ticker = candidates.join(used.select(ticker), ticker, "left_semi").select(company).distinct()
    return candidates.join(used.select(company), company, "left_anti").join(by_ticker, company, "left_anti")


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each left row with its only right row. Raises where a side repeats a key or a left row has no partner."""
    for name, side in (("left", left), ("right", right)):
        if side.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"the {name} side repeats a key of {keys}")
    if left.join(right, keys, "left_anti").limit(1).count():
        raise ValueError(f"a row has no partner by {keys}")
    return left.join(right, keys, "left")


def eligible(error: Column, quote_type: Column, exchange: Column, country: Column, market_cap: Column) -> Column:
    """A share of a US company on the exchange today that has a market value; a null is no."""
    return F.coalesce(
        (F.coalesce(error, F.lit("")) == "") & (quote_type == "EQUITY") & exchange.isin(*EXCHANGES) & (country == "United States") & (market_cap != 0), F.lit(False)
    )


#: Fixed value: signs of which one stands behind an item that is named.
ITEM_SIGNS = r"[.:\s\-—]"


def item_counts(text: Column) -> Column:
    """How often each key item is named before a separator, as a map of those that are: {Item 1A: 3}."""
    counts = [F.regexp_count(text, F.lit(rf"(?i)\bitem\s+{n}\b{ITEM_SIGNS}")).cast("long") for n in KEY_ITEMS]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(f"Item {n}") for n in KEY_ITEMS]), F.array(*counts)), lambda _, n: n > 0)


def document_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """docs(doc_id, ...), chunks(doc_id, content_type, section, text) -> docs with the counts of their chunks; documents
    without chunks have zeros."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    stats = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("content_type") == "text").alias("text_chunks"), F.count_if(F.col("content_type") == "table").alias("table_chunks"),
        F.bround(F.avg(words)).cast("long").alias("avg_words"), F.max(words).cast("long").alias("max_words"),
        F.bround(F.avg((F.col("section") == "Unknown").cast("double")), 2).alias("unknown_section_share"), F.count_distinct("section").alias("sections"),
    )
    return docs.join(stats, "doc_id", "left").na.fill(0, ["chunks", "text_chunks", "table_chunks", "avg_words", "max_words", "unknown_section_share", "sections"])
