import random
import re

import numpy as np
from pyspark.sql import functions as F

from folio.llm.quality import COUNTS, FEATURES, NAMES, PAIRS, quality_rules, robust_estimates

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words int"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, t in enumerate(threes) if threes.count(t) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a\na\n a\n\n\na", "x y z x y z", "é# b|c\x0b<d>"]
    texts += ["".join(rng.choice(["a ", "b ", "é\n", "A ", "##", "\n", " \n"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(found[i][c] for c in COUNTS) == counts(t), repr(t)
        n, _, _, _, repeated = counts(t)
        assert found[i].base_failed == (n < 50 or 100 * repeated > 50 * n)


def test_outliers_go_and_ordinary_texts_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 200))), None if i % 3 else "en", "s" if i % 2 else None, 1) for i in range(900)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s", 1) for i in range(9)]
    found = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i, kept in found.items() if kept != (i < 1000)] == []


def test_repeated_lines_go(spark):
    rng = random.Random(6)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(12))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(6, 14))), "en", f"s{i % 3}", 1) for i in range(300)]
    for i in range(1000, 1006):
        rows.append((i, "\n".join(["a few words"] * 90 + [line() for _ in range(40)]), "en", f"s{i % 3}", 1))
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in range(300) if not found[i][1]] == []
    assert {found[i] for i in range(1000, 1006)} == {(False, False)}


def test_estimates_have_a_least_determinant(spark):
    """Against concentration steps in numpy from many random subsets: no start finds a clearly smaller determinant."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(800, 4)) @ np.array([[0.5, 0.2, 0, 0], [0, 0.4, 0, 0.1], [0, 0, 0.6, 0], [0, 0, 0, 0.5]]) + [5, 1, 2, 1]
    x[:120] += [4, -3, 3, 2]
    data = spark.createDataFrame([("g", "en", *map(float, r)) for r in x], "grp string, lang string, " + ", ".join(f"{n} double" for n in NAMES))
    own = robust_estimates(data, 0.75, 0)[0].collect()[0]
    precision = np.zeros((4, 4))
    for i, j in PAIRS:
        precision[i, j] = precision[j, i] = own[f"p{i}{j}"]
    least = np.square(list(FEATURES.values()))

    def covariance(rows):
        cov = np.cov(rows.T, bias=True)
        cov[range(4), range(4)] = np.maximum(cov[range(4), range(4)], least) + least / 4
        return cov

    best = np.inf
    for _ in range(60):
        rows = x[rng.choice(800, 8, replace=False)]
        for _ in range(40):
            off = x - rows.mean(axis=0)
            d2 = (off @ np.linalg.inv(covariance(rows)) * off).sum(axis=1)
            rows = x[d2 <= np.quantile(d2, 0.75)]
        best = min(best, np.linalg.slogdet(covariance(rows))[1])
    assert -np.linalg.slogdet(precision)[1] <= best + 0.02
    mean = np.array([own[f"m{i}"] for i in range(4)])
    assert np.abs(mean - x[120:].mean(axis=0)).max() < 0.15


def test_small_groups_have_their_own_estimate(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(n)) for _ in range(80))
    rows = [(i, text(5), "en", "large", 1) for i in range(200)] + [(1000 + i, text(12), "en", "small", 1) for i in range(15)] + [(2000, text(12), "en", "large", 1)]
    found = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in found if not found[i]] == [2000]


def test_long_text_and_clashing_columns(spark):
    big = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("some words in a line\n"), 1_000_000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit("x").alias("grp"), F.lit(2).alias("n_symbols"))
    row = quality_rules(big).collect()[0]
    assert (row.n_words, row.n_dup_lines, row.n_symbols, row.kept) == (5_000_000, 999_999, 0, False)


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
