"""Tokens of words under a vocabulary of word pieces.

A text's tokens are those of its words together. A vocabulary is a model of fixed size whatever the corpus, so tasks get it whole
and count each distinct word once, where the texts are read. One of more than MAX_PIECES pieces stays a table: what is longest at
each place of a word is then found by a join with it, and the words' counts are joined with their occurrences.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

#: Characters of a word beyond which it is one unknown token, and the mark of a piece inside a word.
MAX_CHARS, INSIDE = 100, "##"
#: A sign is a token of its own, as is an ideograph; the rest of a word is runs of anything else.
SIGN = r"[\p{P}$+<=>^`|~]"
IDEOGRAPH = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
RUN = rf"{SIGN}|{IDEOGRAPH}|(?:(?!{SIGN}|{IDEOGRAPH}).)+"
#: Letters of Latin scripts with one accent or more, and the letters under them.
ACCENTED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1 and c == c.lower())
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


#: Pieces of a vocabulary that is sent to tasks, and words whose counts a worker remembers.
MAX_PIECES, REMEMBERED = 500_000, 500_000
DROPPED, MARKS = regex.compile(r"[\p{Cc}\p{Cf}\uFFFD]"), regex.compile(r"\p{Mn}+")
RUNS = regex.compile(regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{m[1]:0>8}", RUN), regex.DOTALL)
PLAIN_OF = str.maketrans(ACCENTED, PLAIN)


def basic_tokens(word: Column) -> Column:
    """The runs and signs of a word without white space: in small letters, without accents and control characters."""
    clean = F.regexp_replace(F.lower(word), r"[\p{Cc}\p{Cf}\x{FFFD}]", "")
    plain = F.regexp_replace(F.translate(clean, ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.regexp_extract_all(plain, F.lit(f"(?s){RUN}"), F.lit(0))


def run_tokens(runs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """runs(run) distinct, vocabulary(token) -> (run, n): the pieces of each run by greedy longest match from the left. A run
    that has a place no piece begins at, or is too long, is one unknown token.

    Every substring that can be a piece meets the vocabulary in one join, of which the longest of each place stays; a fold
    over the places then walks from piece to piece."""
    tokens = vocabulary.select("token").where("token is not null and token != ''").distinct()
    pieces = tokens.select(
        F.when(F.col("token").startswith(INSIDE) & (F.length("token") > len(INSIDE)), F.substring("token", len(INSIDE) + 1, 1 << 30)).otherwise(F.col("token")).alias("piece"),
        (F.col("token").startswith(INSIDE) & (F.length("token") > len(INSIDE))).alias("inside"),
    )
    longest = F.lit(pieces.agg(F.max(F.length("piece"))).first()[0] or 0)
    size = F.length("run")
    short = runs.where(size <= MAX_CHARS)
    starts = short.select("run", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    most = F.least(longest, size - F.col("at") + 1)
    spans = starts.where(most > 0).select("run", "at", F.explode(F.sequence(F.lit(1), most)).alias("chars"))
    spans = spans.select("run", "at", "chars", F.col("run").substr(F.col("at"), F.col("chars")).alias("piece"), (F.col("at") > 1).alias("inside"))
    best = spans.join(pieces, ["piece", "inside"]).groupBy("run", "at").agg(F.max("chars").alias("chars"))
    steps = best.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("at", "chars"))).alias("steps"))
    state = F.struct(F.lit(1).alias("next"), F.lit(0).alias("n"))

    def walk(s: Column, at: Column) -> Column:
        step = F.try_element_at("steps", at)
        here = s["next"] == at
        return F.struct(F.when(here, at + F.coalesce(step, F.lit(MAX_CHARS + 1))).otherwise(s["next"]).alias("next"), (s["n"] + here.cast("int")).alias("n"))

    walked = steps.withColumn("end", F.aggregate(F.sequence(F.lit(1), size), state, walk))
    counted = walked.select("run", F.when(F.col("end.next") == size + 1, F.col("end.n")).otherwise(1).alias("n"))
    return runs.join(counted, "run", "left").select("run", F.coalesce("n", F.lit(1)).alias("n"))


def word_tokens(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words(word) -> (word, n): a row for each distinct word and its number of tokens."""
    distinct = words.select("word").where("word is not null").distinct()
    runs = distinct.select("word", F.explode(basic_tokens(F.col("word"))).alias("run"))
    counted = runs.join(run_tokens(runs.select("run").distinct(), vocabulary), "run").groupBy("word").agg(F.sum("n").alias("n"))
    return distinct.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def words_of(text: Column) -> Column:
    """What white space of any kind divides."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


class Pieces:
    """A vocabulary in a task: the tokens of words, by the rules of basic_tokens() and run_tokens()."""

    def __init__(self, tokens: Iterable[str]):
        tokens = {t for t in tokens if t}
        self.inside = {t[len(INSIDE) :] for t in tokens if t.startswith(INSIDE) and len(t) > len(INSIDE)}
        self.heads = {t for t in tokens if not (t.startswith(INSIDE) and len(t) > len(INSIDE))}
        self.longest = max(map(len, self.inside | self.heads), default=0)
        self.known: dict[str, int] = {}

    def of_run(self, run: str) -> int:
        at, n, size, pieces = 0, 0, len(run), self.heads
        while at < size <= MAX_CHARS:
            for end in range(min(size, at + self.longest), at, -1):
                if run[at:end] in pieces:
                    break
            else:
                return 1
            at, n, pieces = end, n + 1, self.inside
        return n or 1

    def of_word(self, word: str) -> int:
        if (n := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            plain = word.lower()
            if plain.isascii() and plain.isalnum():  # no signs, marks or accents
                n = self.of_run(plain)
            else:
                n = sum(map(self.of_run, RUNS.findall(MARKS.sub("", DROPPED.sub("", plain).translate(PLAIN_OF)))))
            self.known[word] = n
        return n

    def of_texts(self, texts: list[str]) -> list[int]:
        return [sum(map(self.of_word, t.split())) for t in texts]


def shipped(vocabulary: DataFrame) -> Broadcast | None:
    """The vocabulary(token) for tasks, or None if it has too many pieces."""
    found = vocabulary.select("token").where("token is not null and token != ''").distinct().limit(MAX_PIECES + 1).collect()
    return vocabulary.sparkSession.sparkContext.broadcast(Pieces(r.token for r in found)) if len(found) <= MAX_PIECES else None


def token_counts(texts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """texts(key, text) -> (key, n_tokens), a row for each key. Null and empty texts have no tokens."""
    pieces = shipped(vocabulary)
    if pieces is None:
        return joined_counts(texts, vocabulary, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(pc.fill_null(batch["text"], ""), " ")
            coded = words.flatten().dictionary_encode()
            sizes = np.array([*map(pieces.value.of_word, coded.dictionary.to_pylist()), 0], np.int64)
            upto = np.append(0, np.cumsum(sizes[coded.indices.to_numpy()]))
            ends = np.cumsum(pc.list_value_length(words).to_numpy())
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(np.diff(upto[np.append(0, ends)]))], [key, "n"])

    texts = texts.select(key, F.regexp_replace("text", r"(?U)\s+", " ").alias("text"))
    return texts.mapInArrow(run, StructType([texts.schema[key], *StructType().add("n", LongType())])).groupBy(key).agg(F.sum("n").alias("n_tokens"))


def joined_counts(texts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """token_counts() of a vocabulary of any size. Word occurrences are joined with the distinct words' counts, which Spark
    broadcasts where they are few and otherwise deals by word once; sums by key are combined before they move."""
    each = texts.select(key, F.explode_outer(words_of(F.col("text"))).alias("word"))
    counts = word_tokens(each.select("word"), vocabulary)
    return each.join(counts, "word", "left").groupBy(key).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n_tokens"))
