"""From a question to a company and year, from hits to a context, from a model's reply to cited sources."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import REPLY
from ..functions.text import escape_document_tags, estimated_tokens, excerpt, year_candidates

#: What str.strip takes for ASCII.
WHITE = " \t\n\x0b\x0c\r"
#: Letters with one accent in Latin scripts and the letters under them.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and len(unicodedata.normalize("NFD", c)) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)
#: Endings that the short form of a company's name leaves out, again and again.
LEGAL_ENDINGS = (
    "public limited company", "incorporated", "corporation", "holdings", "international", "company", "limited", "group", "corp", "inc", "ltd", "plc", "llc", "s a", "n v", "co", "lp",
    "sa", "nv", "ag", "se",
)
LEGAL = rf"( ({'|'.join(LEGAL_ENDINGS)}))+$"
#: Short names that also name the exchange, and words around such a name where it means that.
GENERIC = ("nasdaq",)
EXCHANGE_AFTER = (
    "companies", "company", "firms", "firm", "issuers", "listed", "listing", "listings", "stock", "stocks", "market", "markets", "exchange", "composite", "index", "100", "global", "rules",
)
EXCHANGE_BEFORE = ("a", "an", "on", "other", "traded", "listed")
#: What is said in place of an answer.
INSUFFICIENT = (
    "I don't know. The retrieved 10-K sections don't contain enough information to answer that question. "
    "Try rephrasing it, or ask about a specific company's risks, business or figures stated in its 10-K."
)
OUT_OF_SCOPE = (
    "Sorry, I can't help with that. I can answer questions about a single company's 10-K, such as its risk "
    "factors, business model, competition, or figures stated in the filing. I can't compare companies, "
    "calculate growth or give investment advice."
)
MARKER = r"\[\d{1,2}(?:\s*,\s*\d{1,2})*\]"


def normalised(text: Column) -> Column:
    """Lower case without accents, letters and digits only, single blanks, a blank at each end, so that phrases are matched
    whole."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(plain, r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def short_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(normalised(name)), "^the ", ""), LEGAL, "")


def aliases(names: DataFrame, folders: DataFrame | None = None, nicknames: DataFrame | None = None) -> DataFrame:
    """names(ticker, name), folders(ticker, folder), nicknames(ticker, alias) -> (ticker, alias, in_context): the names and their
    short forms, folders and nicknames, normalised, without empty ones. Short names that also name an exchange count in context
    only. Nicknames of tickers that have no name or folder are left out."""
    short = short_name(F.col("name"))
    every = names.select("ticker", F.trim(normalised(F.col("name"))).alias("alias"), F.lit(False).alias("in_context"))
    every = every.union(names.select("ticker", short, short.isin(*GENERIC)))
    if folders is not None:
        every = every.union(folders.select("ticker", F.trim(normalised(F.col("folder"))), F.lit(False)))
    if nicknames is not None:
        known = nicknames.select(F.upper(F.trim("ticker")).alias("ticker"), F.trim(normalised(F.col("alias"))).alias("alias"), F.lit(False).alias("in_context"))
        every = every.union(known.join(every.select("ticker"), "ticker", "left_semi"))
    return every.where("alias is not null and alias != ''").groupBy("ticker", "alias").agg(F.min("in_context").alias("in_context"))


def possible_tickers(question: Column) -> Column:
    """Runs of letters and digits, and up to three of them with stops or hyphens between: a stop at the end is the sentence's."""
    part, cut = "[A-Za-z0-9]+", r"[.\-]"
    joined = [part + (cut + part) * n for n in range(3)]
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(question, F.lit(rf"(?<![A-Za-z0-9])(?=({x})(?![A-Za-z0-9]))"), F.lit(1)) for x in joined])))


def resolve(questions: DataFrame, known: DataFrame) -> DataFrame:
    """questions(qid, question), known(ticker, alias, in_context) -> (qid, tickers, ticker, years, fiscal_year, ambiguous_company,
    ambiguous_year). A question names a company by an alias as a whole phrase or by its ticker in capitals. An alias in_context
    doesn't count where the words beside it say that the exchange is meant. A value is given only where there is exactly one
    candidate. Phrases of as many words as the longest alias has are joined with the aliases by equality."""
    max_words = known.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 1
    w = F.split(F.trim(normalised(F.col("question"))), " ")
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max_words)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    spans = questions.select("qid", w.alias("w")).select("qid", "w", F.explode(places).alias("p"))
    word = lambda at: F.coalesce(F.get("w", at), F.lit(""))
    first = F.col("p.i") - 1
    before, two_before, after = F.when(first > 0, word(first - 1)).otherwise(""), F.when(first > 1, word(first - 2)).otherwise(""), word(first + F.col("p.n"))
    exchange = after.isin(*EXCHANGE_AFTER) | before.isin(*EXCHANGE_BEFORE) | ((before == "the") & two_before.isin(*EXCHANGE_BEFORE))
    phrases = spans.select("qid", F.array_join(F.slice("w", F.col("p.i"), F.col("p.n")), " ").alias("alias"), exchange.alias("exchange")).distinct()
    known = known if "in_context" in known.columns else known.withColumn("in_context", F.lit(False))
    signs = questions.select("qid", F.explode(possible_tickers(F.col("question"))).alias("ticker"))
    named = phrases.join(known, "alias").where("not (in_context and exchange)").select("qid", "ticker")
    named = named.union(signs.join(known.select("ticker").distinct(), "ticker", "left_semi").select("qid", "ticker"))
    found = named.groupBy("qid").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    out = questions.join(found, "qid", "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>"))).withColumn("years", year_candidates(F.col("question")))
    return out.select(
        "qid", "tickers", F.when(F.size("tickers") == 1, F.get("tickers", 0)).alias("ticker"), "years", F.when(F.size("years") == 1, F.get("years", 0)).alias("fiscal_year"),
        (F.size("tickers") > 1).alias("ambiguous_company"), (F.size("years") > 1).alias("ambiguous_year"),
    )


def clarification(match: DataFrame) -> DataFrame:
    """(qid, message): what is missing or ambiguous in words; null where nothing is."""
    company = F.when(F.col("ambiguous_company"), "Which company do you mean?").when(F.col("ticker").isNull(), "Please name a company.")
    year = F.when(F.col("ambiguous_year"), "Which fiscal year do you mean?").when(F.col("fiscal_year").isNull(), "Please name a fiscal year.")
    return match.select("qid", F.nullif(F.concat_ws(" ", company, year), F.lit("")).alias("message"))


def route(resolved: DataFrame, catalog: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(qid, route): search where the catalog has the company and year, else snapshot where there are figures, else clarify."""
    keys = ["ticker", "fiscal_year"]
    marked = resolved.join(catalog.select(*keys, F.lit(1).alias("c")).distinct(), keys, "left").join(snapshots.select(*keys, F.lit(1).alias("s")).distinct(), keys, "left")
    return marked.select("qid", F.when(F.col("c") == 1, "search").when(F.col("s") == 1, "snapshot").otherwise("clarify").alias("route"))


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def rendered(place: Column, text: Column, **attributes: Column) -> Column:
    """A document as the generator sees it: a tag with its place and attributes (null: None) around the text, in which no
    document tag can end it."""
    inside = [F.concat(F.lit(f' {name}="'), escape_html(F.coalesce(value.cast("string"), F.lit("None"))), F.lit('"')) for name, value in attributes.items()]
    return F.concat(F.lit('<document id="'), place, F.lit('"'), *inside, F.lit(">\n"), escape_document_tags(text), F.lit("\n</document>"))


def context(hits: DataFrame, budget: int = 12_000) -> DataFrame:
    """hits(qid, rank, text, company, fiscal_year, section, page): those of each question's first ranks whose rendered forms'
    estimated tokens add up to no more than the budget, with their place D1, D2, ..., rendered, and spent, the sum so far. The
    first that doesn't fit ends the context."""
    order = Window.partitionBy("qid").orderBy("rank")
    placed = hits.withColumn("place", F.concat(F.lit("D"), F.row_number().over(order)))
    form = rendered(F.col("place"), F.col("text"), company=F.col("company"), fiscal_year=F.col("fiscal_year"), section=F.col("section"), page=F.col("page"))
    spent = F.sum(F.greatest(estimated_tokens(F.col("rendered")), F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("rendered", form).withColumn("spent", spent).where(F.col("spent") <= budget)


def renumber(answer: Column, new: Column) -> Column:
    """Markers like [1, 2] by a map of old to new numbers (null: dropped), each number in brackets of its own, in order and once.
    A group with a number that the map doesn't have is no marker and stays. Blanks before a dropped marker go with it."""
    def one(marker: Column) -> Column:
        old = F.transform(F.regexp_extract_all(marker, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
        final = F.array_sort(F.array_distinct(F.array_compact(F.transform(old, lambda x: F.try_element_at(new, x)))))
        text = F.when(F.size(final) > 0, F.array_join(F.transform(final, lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))), "")).otherwise("\0")
        return F.when(F.forall(old, lambda x: F.map_contains_key(new, x)), text).otherwise(marker)

    markers = F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(0)), one)
    pieces = F.transform(F.split(answer, MARKER, -1), lambda x, i: F.concat(x, F.coalesce(F.get(markers, i), F.lit(""))))
    once = F.regexp_replace(F.array_join(pieces, ""), r"(\[\d+\])(?:\1)+", "$1")
    return F.btrim(F.regexp_replace(once, r"[ \t]*\x00", ""), F.lit(WHITE))


def parse_replies(replies: DataFrame, contexts: DataFrame) -> DataFrame:
    """replies(qid, reply as JSON), contexts(qid, place, chunk_id, text) -> (qid, status, answer, position, chunk_id, excerpt), a
    row for each source of an answered reply, and one of null position for any other.

    Sources of unknown places go; of those with the same chunk and excerpt the first stays; the answer's markers follow their
    new positions. An answered reply without sources or words becomes insufficient_context, and its words, which may be
    invented, give way to the fixed ones; so do empty words of the other statuses. What isn't JSON of this form is malformed."""
    parsed = replies.select("qid", F.from_json("reply", REPLY, {"mode": "PERMISSIVE"}).alias("r")).select("qid", "r.*")
    whole = F.col("status").isin("answered", "insufficient_context", "out_of_scope") & F.col("answer").isNotNull() & F.col("sources").isNotNull()
    whole = whole & F.forall("sources", lambda x: x["doc_id"].isNotNull() & x["excerpt"].isNotNull())
    parsed = parsed.select("qid", F.when(F.coalesce(whole, F.lit(False)), F.col("status")).otherwise("malformed").alias("status"), F.btrim("answer", F.lit(WHITE)).alias("answer"), "sources")
    each = parsed.where("status = 'answered'").select("qid", F.posexplode("sources").alias("at", "s")).select("qid", "at", F.btrim("s.doc_id", F.lit(WHITE)).alias("place"), F.col("s.excerpt").alias("wanted"))
    found = each.join(contexts, ["qid", "place"], "left").withColumn("excerpt", F.when(F.col("chunk_id").isNotNull(), excerpt(F.col("wanted"), F.col("text"))))
    known = found.where("chunk_id is not null").groupBy("qid", "chunk_id", "excerpt").agg(F.min("at").alias("first"))
    known = known.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("first")))
    keyed = found.join(known.select("qid", "chunk_id", "excerpt", "position"), ["qid", "chunk_id", "excerpt"], "left")
    new = keyed.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct((F.col("at") + 1).alias("k"), F.col("position").alias("v")))).alias("new"))
    out = parsed.select("qid", "status", "answer").join(new, "qid", "left").join(known.select("qid", "position", "chunk_id", "excerpt"), "qid", "left")
    empty = (F.col("status") == "answered") & (F.col("position").isNull() | (F.col("answer") == ""))
    status = F.when(empty, "insufficient_context").otherwise(F.col("status"))
    words = F.when(empty, F.lit(INSUFFICIENT)).when(F.col("status") == "answered", renumber(F.col("answer"), F.col("new"))).when(
        F.col("answer") == "", F.when(F.col("status") == "out_of_scope", F.lit(OUT_OF_SCOPE)).when(F.col("status") == "insufficient_context", F.lit(INSUFFICIENT))
    ).when(F.col("status") != "malformed", F.col("answer"))
    kept = lambda name: F.when(~F.coalesce(empty, F.lit(False)), F.col(name)).alias(name)
    return out.select("qid", status.alias("status"), words.alias("answer"), kept("position"), kept("chunk_id"), kept("excerpt")).distinct()


def suggestions(candidates: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """candidates(qid, grp, pref, key, text), asked(qid, key): of each group the first candidate not asked yet, then further ones,
    k in all: (qid, place, text)."""
    left = candidates.join(asked.select("qid", "key").distinct(), ["qid", "key"], "left_anti").dropDuplicates(["qid", "key"])
    turn = F.row_number().over(Window.partitionBy("qid", "grp").orderBy("pref", "key"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.least("turn", F.lit(2)), "grp", "pref", "key"))
    return left.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= k).select("qid", "place", "text")
