"""Language identification by rank-order profiles (operator 6): a text's most frequent n-grams of one to three
characters, compared with each language's profile by the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_rows_only

UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


#: Texts are counted in pieces of so many characters.
PIECE = 1 << 18


def counted_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of one to three characters, where every run of other characters than letters, and
    each end of the text, is one blank. Blanks count only at the ends of an n-gram. Empty if there is no letter. A piece of
    the text is counted at a time, with the last characters of the one before."""
    text = text.lower()
    found, tail, any_letter = [], np.ones(1, np.int64), False  # 1 is the blank, a letter its code point and 2
    for at in range(0, max(1, len(text)), PIECE):
        points = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        is_letter = letters()[points]
        any_letter |= bool(is_letter.any())
        last = at + PIECE >= len(text)
        c = np.concatenate([tail, np.where(is_letter, points + 2, 1), np.ones(int(last), np.int64)])
        c = c[np.concatenate([[True], (c[1:] != 1) | (c[:-1] != 1)])]
        seen = len(tail)  # n-grams that end inside the tail were counted with the piece before
        one, two, three = c[seen:], (c[:-1] << 21 | c[1:])[seen - 1 :], (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[max(0, seen - 2) :]
        found.append(np.unique(np.concatenate([one[one != 1], two, three[c[1:-1][max(0, seen - 2) :] != 1]]), return_counts=True))
        tail = c[-2:]
    if not any_letter:
        return found[0][0][:0], found[0][1][:0]
    if len(found) == 1:
        return found[0]
    codes, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent codes, the smaller code first where counts are equal."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:size]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(np.stack(counted_ngrams(text or "")))
        for lang, found in by_lang.items():
            both = np.concatenate(found, axis=1)
            codes, at = np.unique(both[0], return_inverse=True)
            counts = np.bincount(at, both[1], len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])


def profiles(labelled: DataFrame, size: int = 300, docs_per_lang: int = 5000) -> dict[str, list[int]]:
    """labelled(doc_id, text, lang) -> each language's most frequent n-grams in order.

    Fitted on a bounded sample: of a language with more than docs_per_lang rows, those whose hash of doc_id falls under
    the share that gives about that many. Nothing goes to the driver but a row a language and its `size` n-grams.
    """
    labelled = labelled.where("lang is not null and text is not null")
    rows = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not rows:
        return {}
    limit = F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, int(min(1.0, docs_per_lang / n) * (1 << 32)))])
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) <= F.try_element_at(limit, F.col("lang")))
    counts = sample.select("text", "lang").mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))  # Spark keeps `size` a task before it shuffles
    best = counts.withColumn("place", place).where(F.col("place") <= size).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("best"))
    return {r["lang"]: [x["code"] for x in r["best"]] for r in sorted(best.collect(), key=lambda r: r["lang"])}


def _predicted(batches: Iterator[pa.RecordBatch], known: dict[str, list[int]], size: int) -> Iterator[pa.RecordBatch]:
    langs = list(known)
    codes = np.unique(np.array([c for own in known.values() for c in own], np.int64))
    place = np.full((len(codes) + 1, len(langs)), size, np.int64)  # the last row is for n-grams of no profile
    for k, own in enumerate(known.values()):
        place[np.searchsorted(codes, own), k] = np.arange(len(own))
    for batch in batches:
        names, scores = [], []
        for text in batch["text"].to_pylist():
            top = ranked(*counted_ngrams(text or ""), size)
            if not len(top) or not langs:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
            there = place[np.where(codes[at] == top, at, len(codes))]
            apart = np.where(there < size, np.abs(there - np.arange(len(top))[:, None]), size).sum(axis=0)
            names.append(langs[int(apart.argmin())])
            scores.append(1 - apart.min() / (size * len(top)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, known: dict[str, list[int]], size: int = 300) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, lang_pred, score), a row for each row of docs.

    lang_pred is the language of the smallest out-of-place distance (of equal ones, the first by name); score is 1 less
    the distance's share of the largest possible. Texts that are null or have no letter are `und` with score 0, as are
    all texts when nothing was learned. Whole texts are read, long ones piece by piece; no shuffle; ids, nulls and repeated
    rows pass as they are; an empty table gives no rows. Other columns are not read, so their names can't clash.
    """
    docs = read_rows_only(docs, doc_id="doc_id", text="text")
    return docs.mapInArrow(lambda batches: _predicted(batches, known, size), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The fold that is kept from learning: crc32 of the id as text, modulo folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))
