"""How five document filters interact, in every order (operator 12).

Words are exploded and counted relationally; the other conditions are columns. A row is in one of 32 classes by what it
fails, so 32 conditional counts for each source, taken in one aggregation, say all about all 120 orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_rows_only, save

NOT_WORD = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"
CLASSES = 1 << len(FILTERS)


def word_counts(rows: DataFrame) -> DataFrame:
    """(k1, k2, text) -> (k1, k2, n_words, n_distinct) for each key. The text moves once, to the task of its key, and both
    aggregations then happen where it is: no word is shuffled. A row also gives one null word, which tells how many rows
    a key has, as rows of one key have one text."""
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), NOT_WORD, -1)
    each = rows.repartition("k1", "k2").select("k1", "k2", F.explode(F.concat(F.array(F.lit(None).cast("string")), words)).alias("word"))
    pairs = each.where("word is null or word != ''").groupBy("k1", "k2", "word").agg(F.count("*").alias("n"))
    n_rows = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    return pairs.groupBy("k1", "k2").agg(
        F.coalesce((F.sum(F.when(F.col("word").isNotNull(), F.col("n"))) / n_rows).cast("long"), F.lit(0)).alias("n_words"), F.count("word").alias("n_distinct")
    )


def failures(docs: DataFrame, min_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5, symbols: str = "#$%&*|") -> DataFrame:
    """documents(doc_id, text, source) -> (doc_id, part, class), a row for each row of docs. class has bit i set where the
    i-th of FILTERS fails."""
    docs = read_rows_only(docs, doc_id="doc_id", text="text", source="source")
    text = F.coalesce("text", F.lit(""))
    # The key of a row is a 128-bit hash of its id and text, so that rows of one id, or of none, stay apart.
    docs = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), "doc_id", text).alias("k2"))
    counts = word_counts(docs.select("k1", "k2", "text"))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    columns = docs.select(
        "doc_id", "part", "k1", "k2", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"),
        (100 * capitals.cast("long") > capital_percent * F.length("text").cast("long")).alias("c"),
        (F.length("text") > F.length(F.translate("text", symbols, ""))).alias("d"),
    )
    columns = save(columns, "filter-columns")
    repeated = columns.where("doc_id is not null").groupBy("t1", "t2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("high > low").drop("high")
    repeated = save(repeated, "repeated-texts")  # few rows; as a table it leaves the join free to split a hot text
    columns = columns.join(repeated, ["t1", "t2"], "left").join(counts, ["k1", "k2"], "left")
    words, distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    fails = [words < min_words, 100 * distinct < distinct_percent * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("low"), F.lit(False))]
    return columns.select("doc_id", "part", sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0)).alias("class"))


def _steps() -> Column:
    """An array of (filter_order, step, own, before): own is the bit of the step's filter, before those of the filters
    left of it, for all orders and steps."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            rows.append(f"named_struct('filter_order', '{''.join(order)}', 'step', {step}, 'own', {own}, 'before', {before})")
            before |= own
    return F.expr(f"array({', '.join(rows)})")


def _sum_where(counts: str, condition: str) -> Column:
    """The sum of the counts of the classes m that fulfil the condition."""
    return F.expr(f"aggregate(sequence(0, {CLASSES - 1}), 0L, (total, m) -> total + IF({condition}, {counts}[m], 0L))")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents(doc_id, text, source), labels(doc_id, quality, toxic) -> (part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each source, each of the 120 orders of the five
    filters and each step.

    A document fails A with under 50 words, B with 100 * distinct words < 65 * words, C with 100 * capitals (A-Z) > 5 * code
    points, D with any of `#$%&*|`, E if a smaller doc_id has the same text, anywhere in the table. Words are maximal runs
    of anything but `[\\x20\\x09-\\x0D]`, with their case. Within the part: kept counts the documents after the step,
    removed those that go at it, redundant those that fail its filter but went before, unique_fails those that fail
    nothing else; good_lost and toxic_lost those removed here that labels have with quality 1 and toxic 1; shapley sums
    removed over the step at which the filter stands in each of the orders.

    Null texts are empty, and a null source is the part ''. Every row counts as a document: rows that repeat an id and its
    text are judged alike (neither is smaller), and rows without doc_id never fail E nor make others fail it, and have no
    labels. A document with several labels has each that any of them gives. No documents give no rows. Other columns are
    not read, so their names can't clash. Texts are read whole, and moved once.
    """
    docs = failures(docs)
    labels = read_rows_only(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    none = F.lit(False)
    labelled = docs.where("doc_id is not null").join(labels, "doc_id", "left").select("part", "class", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"))
    labelled = labelled.union(docs.where("doc_id is null").select("part", "class", none, none))
    holds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = labelled.groupBy("part").agg(*[F.count(F.when(cond & (F.col("class") == m), 1)).alias(f"{name}{m}") for name, cond in holds.items() for m in range(CLASSES)])
    counts = counts.select("part", *[F.array(*[f"{name}{m}" for m in range(CLASSES)]).alias(name) for name in holds])
    steps = counts.select("part", *holds, F.explode(_steps()).alias("s")).select("part", *holds, "s.*")
    here = "(m & before) = 0 AND (m & own) != 0"
    # Of the 120 orders, the filter comes before all others that a document of class m fails in 120 / (filters it fails).
    first = "aggregate(sequence(0, 31), 0L, (total, m) -> total + IF((m & own) != 0, n[m] * (120 div bit_count(m)), 0L))"
    return steps.select(
        "part", "filter_order", "step", _sum_where("n", "(m & (before | own)) = 0").alias("kept"), _sum_where("n", here).alias("removed"),
        _sum_where("n", "(m & before) != 0 AND (m & own) != 0").alias("redundant"), F.get("n", F.col("own")).alias("unique_fails"),
        _sum_where("good", here).alias("good_lost"), _sum_where("toxic", here).alias("toxic_lost"), F.expr(first).alias("shapley"),
    )
