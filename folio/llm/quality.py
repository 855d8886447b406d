"""Quality rules with robust multivariate outliers (operator 7): a minimum-covariance-determinant estimate for each
language and source, and rejection by Mahalanobis distance.

The estimate is the deterministic form: several robust starts (medians and quartile ranges; the same with the correlations
of squashed values; with those of directions), then concentration steps over all rows of a group (keep the share
`coverage` with the smallest distances, estimate again), each of which lowers the determinant, until none changes; the
start with the least determinant counts. Quantiles, means and covariances are Spark aggregates, so a group of any size is
summed before it is shuffled; only a group's few numbers reach Python, for the inverse. The estimates, a few rows a group,
are broadcast after a check of their number, so that a group's rows stay where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, read_rows_only, save
from .words import NOT_SPACE, RAW_CODES, U64, constants, mix, slices

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The least standard deviation that a feature is taken to have, so that one that hardly varies doesn't reject what is
#: only a little different.
FEATURES = {"word_length": 0.2, "symbols": 0.05, "dup_lines": 0.11, "repeats": 0.11}


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of true flags between each two ends."""
    out = np.zeros(len(ends) - 1, np.int64)
    filled = np.flatnonzero(ends[1:] > ends[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(flags, ends[filled], dtype=np.int64)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = constants(3, 5) | U64(1)
    for batch in batches:
        for part in slices(batch["text"]):
            data, offsets, first = part.data, part.offsets, part.first
            chars = _per_text(NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets)
            symbols = _per_text(SYMBOL[data], offsets)
            # Lines: from a text's start or behind a newline, to the next newline or the text's end.
            breaks = np.flatnonzero(data == 10)
            starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
            ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
            line_text = np.sort(np.concatenate([np.arange(part.n), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
            words_to = np.searchsorted(part.starts, np.stack([starts, ends]))
            with_word = words_to[1] > words_to[0]
            lines, line_text = part.span_hashes(starts[with_word], ends[with_word], RAW_CODES), line_text[with_word]
            line_first = np.searchsorted(line_text, np.arange(part.n + 1))
            words = part.word_hashes(RAW_CODES)
            three = np.zeros(max(0, len(words) - 2), U64)
            for k in range(3):
                three += words[k : k + len(three)] * factors[k]
            three = mix(three)
            dup, repeat = np.zeros(part.n, np.int64), np.zeros(part.n, np.int64)
            for i in range(part.n):
                own = lines[line_first[i] : line_first[i + 1]]
                if len(own) > 1:
                    dup[i] = len(own) - len(np.unique(own))
                a, b = first[i], first[i + 1]
                if b - a > 3:
                    own = three[a : b - 2]
                    order = np.argsort(own)
                    same = own[order[1:]] == own[order[:-1]]
                    if same.any():
                        hit = np.zeros(b - a, bool)
                        at = np.concatenate([order[1:][same], order[:-1][same]])
                        for k in range(3):
                            hit[at + k] = True
                        repeat[i] = hit.sum()
            own = batch.slice(part.lo, part.n)
            counts = [pa.array(x) for x in (np.diff(first), chars, symbols, dup, repeat)]
            yield pa.RecordBatch.from_arrays([own["doc_id"], own["lang"], own["source"], *counts, pa.array(np.diff(line_first))], ["doc_id", "lang", "source", *COUNTS, "n_lines"])


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)


def _features() -> list[Column]:
    """Square roots of shares, for steadier variances, and the mean length of a word."""
    words = F.greatest("n_words", F.lit(1))
    return [
        (F.col("word_chars") / words).alias("word_length"), F.sqrt(F.col("n_symbols") / words).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"), F.sqrt(F.col("n_repeat_words") / words).alias("repeats"),
    ]


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation, with the normal quantile found by bisection."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        z = (lo + hi) / 2
        lo, hi = (z, hi) if 0.5 * math.erfc(-z / math.sqrt(2)) < p else (lo, z)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


NAMES = list(FEATURES)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
KEY = ["grp", "start"]
MEANS, COVS = [f"m{i}" for i in range(len(NAMES))], [f"c{i}{j}" for i, j in PAIRS]
ESTIMATE = ", ".join(["grp string", "lang string", "start int", "n long", *[f"m{i} double" for i in range(len(NAMES))], *[f"p{i}{j} double" for i, j in PAIRS], "log_det double"])
STARTS = 3


def _inverted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A group's means and covariances -> its means and precision matrix, no variance under the features' least."""
    least = np.square(list(FEATURES.values()))
    for frame in frames:
        out = frame[["grp", "lang", "start", "n", *MEANS]].copy()
        cov = np.zeros((len(frame), len(NAMES), len(NAMES)))
        for i, j in PAIRS:
            cov[:, i, j] = cov[:, j, i] = frame[f"c{i}{j}"].fillna(0)
        cov[:, range(len(NAMES)), range(len(NAMES))] = np.maximum(cov[:, range(len(NAMES)), range(len(NAMES))], least) + least / 4
        precision = np.linalg.inv(cov)
        for i, j in PAIRS:
            out[f"p{i}{j}"] = precision[:, i, j]
        out["log_det"] = np.linalg.slogdet(cov)[1]
        yield out


def _distance() -> Column:
    off = [(F.col(NAMES[i]) - F.col(f"m{i}")) for i in range(len(NAMES))]
    return sum((off[i] * off[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def few(df: DataFrame, is_few: bool) -> DataFrame:
    """A table of few enough rows to be broadcast, marked so; a larger one as it is, for a join by shuffle."""
    return F.broadcast(df) if is_few else df


def _starts(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The robust starts of each group: medians as means; as covariances squared quartile ranges, alone or with the
    correlations of tanh of standardised values, or of the directions from the median. And whether there are at most
    `most` groups."""
    quartiles = rows.groupBy("grp").agg(F.first("lang").alias("lang"), F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in NAMES])
    least = list(FEATURES.values())
    centre = save(quartiles.select("grp", "lang", "n", *[F.col(x)[1].alias(f"m{i}") for i, x in enumerate(NAMES)], *[F.greatest((F.col(x)[2] - F.col(x)[0]) / 1.349, F.lit(least[i])).alias(f"d{i}") for i, x in enumerate(NAMES)]), "medians")
    is_few = centre.count() <= most
    z = rows.join(few(centre.drop("lang", "n"), is_few), "grp").select("grp", *[((F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, x in enumerate(NAMES)])
    size = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(NAMES))), F.lit(1e-12)))
    forms = {1: [F.tanh(f"z{i}") for i in range(len(NAMES))], 2: [F.col(f"z{i}") / size for i in range(len(NAMES))]}
    shaped = z.groupBy("grp").agg(*[F.covar_pop(form[i], form[j]).alias(f"r{k}{i}{j}") for k, form in forms.items() for i, j in PAIRS])
    both = centre.join(shaped, "grp")

    def correlation(k: int, i: int, j: int) -> Column:
        if k == 0 or i == j:
            return F.lit(float(i == j))
        return 0.95 * F.coalesce(F.try_divide(F.col(f"r{k}{i}{j}"), F.sqrt(F.col(f"r{k}{i}{i}") * F.col(f"r{k}{j}{j}"))), F.lit(0.0))

    starts = [
        both.select("grp", "lang", F.lit(k).alias("start"), "n", *MEANS, *[(correlation(k, i, j) * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in PAIRS])
        for k in range(STARTS)
    ]
    return starts[0].union(starts[1]).union(starts[2]), is_few


def _shrunk(found: DataFrame, weight: int) -> DataFrame:
    """found(grp, lang, start, n, means, covariances within groups) drawn towards their language's, as if `weight` further
    rows were the language's: a group of many rows hardly moves, one of few leans on the language, one without is it."""
    of_lang = Window.partitionBy("lang", "start")
    total = F.sum("n").over(of_lang)
    pooled = {c: F.sum(F.col("n") * F.coalesce(c, F.lit(0.0))).over(of_lang) / total for c in MEANS + COVS}
    own = {c: (F.col("n") * F.coalesce(c, F.lit(0.0)) + weight * F.col(f"lang_{c}")) / (F.col("n") + weight) for c in MEANS + COVS}
    return found.withColumns({f"lang_{c}": x for c, x in pooled.items()}).withColumns(own).select("grp", "lang", "start", "n", *MEANS, *COVS)


def _cuts(rows: DataFrame, estimate: DataFrame, coverage: float) -> DataFrame:
    return rows.join(estimate, KEY).select(*KEY, _distance().alias("d2")).groupBy(*KEY).agg(F.percentile_approx("d2", coverage, 2000).alias("cut"))


def robust_estimates(rows: DataFrame, coverage: float, weight: int, max_steps: int = 6, tolerance: float = 0.05, most: int = 20_000) -> tuple[DataFrame, bool]:
    """rows(grp, lang, features) -> (grp, means, precision matrix, cut), cut being the coverage quantile of the distances,
    and whether these are few enough (at most `most` groups) to be broadcast.

    All starts take two steps, then each group's start of the least determinant goes on until no determinant moves by more
    than the tolerance; what comes to the driver is that answer."""
    starts, is_few = _starts(rows, most)
    estimate = save(_shrunk(starts, weight).mapInPandas(_inverted, ESTIMATE), "estimates")
    tried, old = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(STARTS)]))), []
    for step in range(max_steps):
        if step == 2:
            best = save(estimate.groupBy("grp").agg(F.min_by("start", F.struct("log_det", "start")).alias("start")).join(estimate, KEY), "least")
            old.append(estimate)
            estimate, tried = best, rows.join(few(best.select(*KEY), is_few), "grp")
        known = few(estimate.drop("lang", "n"), is_few)
        cut = known.join(_cuts(tried, known, coverage), KEY)
        inner = tried.join(few(cut, is_few), KEY).where(_distance() <= F.col("cut"))
        again = inner.groupBy(*KEY).agg(
            F.first("lang").alias("lang"), F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(NAMES)], *[F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}{j}") for i, j in PAIRS]
        )
        after = save(_shrunk(again, weight).mapInPandas(_inverted, ESTIMATE), "estimates")
        before = few(estimate.select(*KEY, F.col("log_det").alias("before")), is_few)
        settled = step >= 2 and after.join(before, KEY).where(F.abs(F.col("log_det") - F.col("before")) > tolerance).isEmpty()
        old.append(estimate)
        estimate = after
        if settled:
            break
    known = few(estimate.drop("lang", "n"), is_few)
    out = save(known.join(_cuts(tried, known, coverage), KEY).drop("start", "log_det"), "estimates")
    forget(estimate, *old)
    return out, is_few


def quality_rules(docs: DataFrame, coverage: float = 0.75, weight: int = 50, level: float = 1 - 1e-9) -> DataFrame:
    """documents(doc_id, text, lang, source) -> (doc_id, five counts, base_failed, distance, kept), a row for each row.

    Words are runs of anything but ASCII white space. word_chars: code points in words; n_symbols: characters of
    #*$%&|<>; n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in 3-word windows found
    twice or more. A text of under 50 words, or with more than half its words repeated, fails the base rules. Of the
    others, those whose squared robust distance is beyond the chi-square quantile `level` are rejected; distance is in
    units of that quantile, null for texts that fail the base rules.

    Each language and source (null: one of its own) has its own estimate, drawn towards its language's covariance within
    sources by the weight of `weight` rows, whatever its size. Null and empty texts have no words and fail the base rules;
    whole texts are counted, however long; repeated rows are judged alike; an empty table gives no rows. Columns of docs
    with the names of the counts are not read, so they can't clash.
    """
    docs = read_rows_only(docs, doc_id="doc_id", text="text", lang="lang", source="source")
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"])
    stats = save(docs.mapInArrow(_counted, schema).withColumn("base_failed", base_failed()).select("*", *_features()), "statistics")
    lang = F.coalesce("lang", F.lit("\x02"))
    rows = stats.where("not base_failed").withColumns({"lang": lang, "grp": F.concat_ws("\x01", lang, F.coalesce("source", F.lit("\x02")))})
    estimates, is_few = robust_estimates(rows.select("grp", "lang", *NAMES), coverage, weight)
    factor = F.greatest(F.col("cut") / chi2_quantile(coverage, len(NAMES)), F.lit(1.0))
    judged = rows.join(few(estimates, is_few), "grp").withColumn("distance", _distance() / factor / chi2_quantile(level, len(NAMES)))
    columns = ["doc_id", *COUNTS, "base_failed"]
    failed = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.select(*columns, "distance", (F.col("distance") <= 1).alias("kept")).union(failed)
