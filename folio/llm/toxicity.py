"""Toxicity by cumulative-link ordinal regression over sparse features: words and their stems (operator 9).

P(grade > k | x) = sigmoid(w . x - theta_k): one weight for each word, shared by all ordered thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, read_rows_only, save
from .words import ALNUM, BYTE_CODES, U64, Slice, slices

GRADES = ("clean", "toxic", "severe")
STEMS = (4, 5, 6)
#: The least evidence of a feature, in nats: by Chernoff's bound a word that tells nothing gets there with a probability
#: of exp(-TELLING), about one in eight thousand; the penalty keeps those few small.
TELLING = 9
FOLDS = 5


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def feature_values(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """One for being there, and more with the word's share of the text."""
    return 1 + np.log1p(1000 * counts / np.maximum(n_words, 1))


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted word hashes with their weights, the thresholds between the grades, and the bar for p_toxic."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    bar: float

    def probabilities(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return sigmoid(eta[:, None] - self.thresholds[None, :])


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_columns: int, n_grades: int, penalty: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the largest penalised likelihood, by Adam over all rows at once."""
    params = np.concatenate([np.zeros(n_columns), [0.5], np.zeros(n_grades - 2)])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    at = np.arange(len(grades))
    for step in range(1, steps + 1):
        weights, cuts = params[:n_columns], params[n_columns:]
        thresholds = np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
        eta = np.bincount(rows, values * weights[columns], len(grades))
        below = sigmoid(thresholds[None, :] - eta[:, None])
        cdf = np.concatenate([np.zeros((len(grades), 1)), below, np.ones((len(grades), 1))], axis=1)
        slope = cdf * (1 - cdf)
        p = np.maximum(cdf[at, grades + 1] - cdf[at, grades], 1e-9)
        d_eta = (slope[at, grades + 1] - slope[at, grades]) / p / len(grades)
        upper, lower = slope[at, grades + 1] / p / len(grades), slope[at, grades] / p / len(grades)
        d_theta = np.array([lower[grades == k + 1].sum() - upper[grades == k].sum() for k in range(n_grades - 1)])
        d_cuts = np.concatenate([[d_theta.sum()], np.cumsum(d_theta[::-1])[::-1][1:] * np.exp(cuts[1:])])
        grad = np.concatenate([np.bincount(columns, values * d_eta[rows], n_columns) + penalty * weights / max(1, n_columns) ** 0.5, d_cuts])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params = params - 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    cuts = params[n_columns:]
    return params[:n_columns], np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])


def features(part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of each word, and then of longer words' first 4, 5 and 6 bytes: in languages that build words from
    stems, a stem tells more than its many words."""

    def owner(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(part.first, places, "right") - 1

    yield part.word_hashes().view(np.int64), owner(np.arange(len(part.starts)))
    for size in STEMS:
        longer = np.flatnonzero(part.ends - part.starts > size)
        hashes = part.span_hashes(part.starts[longer], part.starts[longer] + size, BYTE_CODES) ^ U64(size)
        yield hashes.view(np.int64), owner(longer)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic) once for each text and each of its words."""
    for batch in batches:
        toxic = batch["toxic"].to_numpy()
        for part in slices(batch["text"], ALNUM):
            for hashes, text in features(part):
                order = np.lexsort((text, hashes))
                hashes, text = hashes[order], text[order]
                once = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))[: len(hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[once]), pa.array(toxic[part.lo + text[once]])], ["word", "toxic"])


def _found(part: Slice, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in words, count) of the given words in the texts."""
    pairs = [np.zeros(0, np.int64)]
    if len(words):
        for hashes, text in features(part):
            at = np.searchsorted(words, hashes)
            at[at == len(words)] = 0
            hit = words[at] == hashes
            pairs.append(text[hit] * len(words) + at[hit])
    pairs, counts = np.unique(np.concatenate(pairs), return_counts=True)
    text, word = np.divmod(pairs, max(1, len(words)))
    return text, word, counts


def _sparse(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch["text"], ALNUM):
            text, word, counts = _found(part, words)
            ends = pa.array(np.searchsorted(text, np.arange(part.n + 1)).astype(np.int32))
            own = batch.slice(part.lo, part.n)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (word, counts)]
            yield pa.RecordBatch.from_arrays([own["grade"], own["fold"], pa.array(np.diff(part.first)), *lists], ["grade", "fold", "n_words", "words", "counts"])


def evidence(in_toxic: np.ndarray, in_all: np.ndarray, share: float) -> np.ndarray:
    """How much the share of toxic rows among a word's rows differs from all rows', as its Chernoff exponent."""
    x = in_toxic / np.maximum(in_all, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(x > 0, x * np.log(x / share), 0) + np.where(x < 1, (1 - x) * np.log((1 - x) / (1 - share)), 0)
    return in_all * parts


def _fit_part(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_words: int, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all words (0: not chosen) and thresholds, from the given rows."""
    toxic = grades > 0
    weights, n_grades = np.zeros(n_words), len(GRADES)
    if not toxic.any() or toxic.all():
        return weights, np.full(n_grades - 1, 40.0 if not toxic.any() else -40.0)
    told = evidence(np.bincount(columns, toxic[rows], n_words), np.bincount(columns, minlength=n_words), toxic.mean())
    chosen = np.flatnonzero(told >= TELLING)
    if not len(chosen):
        # A small sample can't give that much: half of what a word in all its toxic rows would have is enough there.
        most = evidence(np.array([toxic.sum()]), np.array([toxic.sum()]), toxic.mean())[0]
        chosen = np.flatnonzero(told >= most / 2)
    chosen = np.sort(chosen[np.argsort(-told[chosen], kind="stable")][:max_words])
    place = np.full(n_words, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[columns] >= 0
    own, thresholds = fit_ordinal(rows[used], place[columns[used]], values[used], grades, len(chosen), n_grades)
    weights[chosen] = own
    return weights, thresholds


def _fitted(sample: pd.DataFrame, n_words: int, max_words: int, clean_weight: float) -> pd.DataFrame:
    """The sample's rows -> (name, at, value): each word's weight, the thresholds, and the bar: of those between the
    held-out probabilities of cross-validation the one with the best F-measure,
    clean rows counting as many as they are in all labels; it is drawn halfway (in log-odds) to the clean rows' side of the gap it stands in."""
    sample = sample.sort_values(["fold", "grade"]).reset_index(drop=True)
    grades, fold = sample.grade.to_numpy(), sample.fold.to_numpy()
    sizes = sample.words.map(len).to_numpy(dtype=np.int64) if len(sample) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(sample)), sizes)
    columns = np.concatenate([np.zeros(0, np.int64), *sample.words]).astype(np.int64)
    counts = np.concatenate([np.zeros(0), *sample.counts])
    values = feature_values(counts, sample.n_words.to_numpy()[rows])
    held = np.zeros(len(sample))
    for k in range(FOLDS):
        out = fold == k
        place = np.cumsum(~out) - 1
        used = ~out[rows]
        weights, thresholds = _fit_part(place[rows[used]], columns[used], values[used], grades[~out], n_words, max_words)
        eta = np.bincount(rows, values * weights[columns], len(sample))
        held[out] = sigmoid(eta - thresholds[0])[out]
    order = np.argsort(-held, kind="stable")
    caught, wrong = np.cumsum(grades[order] > 0), np.cumsum((grades[order] == 0) * clean_weight)
    score = 2 * caught / np.maximum(caught + wrong + (grades > 0).sum(), 1)
    bar = 0.5
    if len(order) and (grades > 0).any():
        at = int(score.argmax())
        high, low = held[order[at]], held[order[at + 1]] if at + 1 < len(order) else 0.0
        bar = float(np.clip(sigmoid((np.log(high / (1 - high + 1e-12) + 1e-12) + np.log(low / (1 - low + 1e-12) + 1e-12)) / 2), 0.01, 0.99))
    weights, thresholds = _fit_part(rows, columns, values, grades, n_words, max_words)
    chosen = np.flatnonzero(weights)
    return pd.DataFrame({
        "name": ["word"] * len(chosen) + ["threshold"] * len(thresholds) + ["bar"], "at": [*chosen, *range(len(thresholds)), 0], "value": [*weights[chosen], *thresholds, bar],
    })


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, max_words: int = 3000) -> OrdinalModel:
    """A model of documents(doc_id, text) with labels(doc_id, toxic 0 or 1, and perhaps quality 0 or 1).

    The grades are clean, toxic, and severe: toxic and of low quality (without `quality`, none is severe). The model is
    fitted on a bounded sample: of the toxic and of the other labelled rows, the rows_per_class with the smallest hashes
    of their doc_id. Words are counted by Spark; the 8 * max_words that tell most of a difference come to the driver, and
    only those are looked up in the sample's texts, so what one task fits is bounded however long the texts are. No toxic
    labels, or none that words tell apart, give a model that finds everything clean.
    """
    quality = "quality" if "quality" in labels.columns else "toxic"
    labels = read_rows_only(labels, doc_id="doc_id", toxic="toxic", quality=quality).where("doc_id is not null and toxic in (0, 1)")
    severe = (F.col("toxic") == 1) & (F.col("quality") == 0)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.col("toxic") + severe.cast("int")).alias("grade"))
    first = [labels.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for t in (0, 1)]
    # At most 2 * rows_per_class rows of three numbers: small enough to send to every task.
    taken = save(first[0].union(first[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")), "sample")
    sample = save(read_rows_only(docs, doc_id="doc_id", text="text").join(F.broadcast(taken), "doc_id"), "sample-texts")
    sizes = {r["toxic"]: r["count"] for r in taken.groupBy("toxic").count().collect()}
    in_all = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    words = np.zeros(0, np.int64)
    if 0 < share < 1:
        x = F.col("in_toxic") / F.col("in_all")
        told = F.col("in_all") * (F.when(x > 0, x * F.log(x / share)).otherwise(0) + F.when(x < 1, (1 - x) * F.log((1 - x) / (1 - share))).otherwise(0))
        counted = sample.select("toxic", "text").mapInArrow(_present, "word long, toxic int").groupBy("word").agg(F.sum("toxic").alias("in_toxic"), F.count("*").alias("in_all"))
        best = counted.withColumn("told", told).where("in_all > 1").orderBy(F.desc("told"), "word").limit(8 * max_words)
        words = np.sort(np.array([r["word"] for r in best.select("word").collect()], np.int64))
    rows = sample.select("text", F.col("grade").cast("int"), "fold").mapInArrow(lambda b: _sparse(b, words), "grade int, fold int, n_words long, words array<long>, counts array<long>")
    clean_weight = max(1.0, in_all.get(0, 0) / max(1, sizes.get(0, 0)) / max(1.0, in_all.get(1, 0) / max(1, sizes.get(1, 0))))
    found = rows.groupBy().applyInPandas(lambda x: _fitted(x, len(words), max_words, clean_weight), "name string, at long, value double").toPandas()
    forget(taken, sample)
    own, cuts = found[found.name == "word"].sort_values("at"), found[found.name == "threshold"].sort_values("at").value.to_numpy()
    bars = found[found.name == "bar"].value
    return OrdinalModel(words[own["at"].to_numpy(np.int64)], own.value.to_numpy(float), cuts if len(cuts) else np.full(len(GRADES) - 1, 40.0), float(bars.iloc[0]) if len(bars) else 0.5)


def _scored(batches: Iterator[pa.RecordBatch], model: OrdinalModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch["text"], ALNUM):
            text, word, counts = _found(part, model.words)
            values = feature_values(counts, np.diff(part.first)[text]) * (model.weights[word] if len(model.words) else 0.0)
            above = model.probabilities(np.bincount(text, values, part.n))
            grade = (above >= 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(part.lo, part.n), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32))],
                ["doc_id", "severity", "p_toxic", "grade"],
            )


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic, kept) by a model, as toxicity() gives them."""
    docs = read_rows_only(docs, doc_id="doc_id", text="text")
    out = docs.mapInArrow(lambda batches: _scored(batches, model), "doc_id long, severity double, p_toxic double, grade int")
    return out.withColumn("toxic", F.col("p_toxic") >= model.bar).withColumn("kept", F.col("p_toxic") < model.bar)


def toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, max_words: int = 3000) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, toxic, quality) -> (doc_id, severity, p_toxic, grade, toxic, kept), a row for
    each row of docs.

    severity is the expected grade, from 0 (clean) to 2 (severe); grade the largest k with P(grade >= k) of a half or
    more; p_toxic is P(grade >= 1), toxic says that it reaches the model's bar, which cross-validation set, and kept the
    opposite. Null and empty texts have no features; whole texts are scored, however long, in their own tasks and without
    a shuffle; repeated rows are scored alike; a row without doc_id is scored too; labels without a document or with other
    values are left out; an empty table gives no rows. Other columns are not read, so their names can't clash.
    """
    return score(docs, train(docs, labels, rows_per_class, max_words))
