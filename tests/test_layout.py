"""Pages of one and two columns, word pieces and chunk rules, against brute-force versions."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.operators import chunking, layout, sections, wordpiece
from folio.plans import documents

WORDS = "doc_id string, page int, width double, x0 double, y0 double, x1 double, y1 double, word string, row int"


def page_frame(spark, pages):
    return spark.createDataFrame([("d", p, w, float(x0), float(y0), float(x1), float(y1), t, 9) for p, (w, words) in pages.items() for x0, y0, x1, y1, t in words], WORDS)


def lines_of(df):
    out = defaultdict(list)
    for r in sorted(layout.page_lines(df).collect(), key=lambda r: (r.page, r.line_no)):
        assert r.line == " | ".join(r.cells)
        out[r.page].append(r.line)
    return dict(out)


def on_grid(texts, x0, step=20):
    return [(x0 + 30 * i, step * r, x0 + 30 * i + 25, step * r + 5, w) for r, text in enumerate(texts) for i, w in enumerate(text.split())]


LEFT = [f"the company sells item {'abcdefghij'[i]}" for i in range(10)]
RIGHT = ["ITEM 1A risk factors may affect", *[f"risk factors of kind {'abcdefghij'[i]}" for i in range(9)]]


def test_pages_of_columns(spark):
    wide = "the company sells many products in all of its markets"
    table = on_grid(["Revenue of the year"] * 10, 40) + on_grid(["1,200 2,300 3,400 4,500"] * 10, 330)
    title = [(150, 95, 450, 100, "Title")]
    two = on_grid(LEFT, 40) + on_grid(RIGHT, 330)
    found = lines_of(page_frame(spark, {
        1: (612.0, two), 2: (612.0, on_grid([wide] * 20, 40)), 3: (612.0, table),
        4: (612.0, [(x0, y0 + (20 if y0 > 80 else 0), x1, y1 + (20 if y0 > 80 else 0), w) for x0, y0, x1, y1, w in two] + title),
        5: (612.0, [(0, 0, 5, 5, "Cash"), (6, 0, 8, 5, "$"), (9, 0, 60, 5, "....."), (100, 1, 120, 6, "7"), (200, 0, 210, 5, "....")]),
    }))
    assert found[1] == LEFT + RIGHT
    assert found[2] == [wide] * 20
    assert found[3] == ["Revenue of the year | 1,200 2,300 3,400 4,500"] * 10
    assert found[4] == LEFT[:5] + RIGHT[:5] + ["Title"] + LEFT[5:] + RIGHT[5:]
    assert found[5] == ["Cash | 7"]


def test_rows_share_the_first_centre(spark):
    words = [(0, y, 5, y, w) for y, w in ((0, "a"), (3, "b"), (6, "c"), (6, "d"), (11, "e"))] + [(30, 0, 35, 0, "z")]
    assert lines_of(page_frame(spark, {1: (600.0, words)})) == {1: ["a b | z", "c d", "e"]}
    none = spark.createDataFrame([("d", 1, 600.0, None, 0.0, 1.0, 1.0, "x", 0), ("d", None, 600.0, 0.0, 0.0, 1.0, 1.0, "x", 0), ("d", 1, 600.0, 0.0, 0.0, 1.0, 1.0, None, 0)], WORDS)
    assert layout.page_lines(none).count() == 0


def rows_by_height(words):
    rows = []
    for w in sorted(words, key=lambda w: (w[1] + w[3])):
        c = (w[1] + w[3]) / 2
        if rows and c - rows[-1][0] <= 4:
            rows[-1][1].append(w)
        else:
            rows.append((c, [w]))
    return [sorted(r, key=lambda w: (w[0], w[2], w[4])) for _, r in rows]


def brute_gutter(words, width):
    rows, low, high = rows_by_height(words), int(width * 0.35), int(width * 0.65)
    counts = {x: sum(any(w[0] < x + 4 and w[2] > x - 4 for w in r) for r in rows) for x in range(low, high + 1, 2)}
    fewest = min(counts.values())
    if fewest > 0.1 * len(rows):
        return None
    best = [x for x in counts if counts[x] == fewest]
    x = best[len(best) // 2]

    def prose(side):
        if len(side) < 4 or any(b[0] - a[2] > 12 for a, b in zip(side, side[1:], strict=False)):
            return False
        return sum(not any(c.isalpha() for c in w[4]) or any(c.isdigit() for c in w[4]) for w in side) / len(side) < 0.2

    n = min(sum(prose([w for w in r if w[2] <= x]) for r in rows), sum(prose([w for w in r if w[0] >= x]) for r in rows))
    return x if n >= 8 and n >= 0.3 * len(rows) else None


def test_gutters_against_brute_force(spark):
    """Pages whose columns, widths and stray words vary, so that some have a gutter and some just miss it."""
    rng, pages = random.Random(8), {}
    for p in range(60):
        width, middle = rng.choice([500.0, 612.0]), rng.randrange(230, 330)
        words = []
        for r in range(rng.randrange(8, 22)):
            for x, end in ((30, middle - rng.randrange(2, 30)), (middle + rng.randrange(0, 12), 480)):
                at = x + rng.randrange(0, 9)
                while at + 30 < end:
                    words.append((at, 20 * r + rng.randrange(3), at + 30, 20 * r + 5, rng.choice(["word", "other", "Text", "12" if p % 4 == 0 else "x"])))
                    at += 30 + rng.choice([4, 5, 6, 20 if rng.random() < 0.05 else 3])
            if rng.random() < 0.04:
                words.append((middle - 40, 20 * r, middle + 40, 20 * r + 5, "across"))
        pages[p] = (width, words)
    df = page_frame(spark, pages)
    found = {r.page: r.gutter for r in layout.gutters(layout.with_rows(df.drop("row"), layout.PAGE)).collect()}
    want = {p: g for p, (width, words) in pages.items() if (g := brute_gutter(words, width)) is not None}
    assert found == want and 5 < len(want) < 55


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_page_moves_once(spark):
    """Words of a table are dealt by page once, and pages that come whole never."""
    assert shuffles(layout.page_lines(page_frame(spark, {1: (612.0, on_grid(LEFT, 40))}))) == 1
    docs = spark.createDataFrame([(1, "a b"), (2, "Title " + "word " * 500), (3, None), (4, " "), (None, "x")], "doc_id long, text string")
    lines = layout.lines_of_pages(documents.typeset(docs))
    assert shuffles(lines) == 0
    found = {(r.doc_id, r.page, r.line_no): r.line for r in lines.collect()}
    assert found[1, 1, 1] == "a b" and found[2, 1, 1] == "Title" and found[2, 1, 2] == " ".join(["word"] * 4)
    assert {k[:2] for k in found} == {(1, 1), (2, 1), (2, 2)} and sum(v.count("word") for v in found.values()) == 500
    odd = spark.createDataFrame([(1, 1, None, None), (1, 2, 612.0, []), (1, None, 612.0, [(0.0, 0.0, 1.0, 1.0, "y")]), (None, 3, None, [(0.0, 0.0, 1.0, 1.0, "x"), (0.0, float("nan"), 1.0, 1.0, "n"), None])], "doc_id long, page int, width double, words array<struct<x0 double, y0 double, x1 double, y1 double, word string>>")
    assert [tuple(r)[:4] for r in layout.lines_of_pages(odd).collect()] == [(None, 3, 1, "x")]


def brute_tokens(word, vocabulary):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) not in ("Mn", "Cc", "Cf"))
    runs, sign = [], lambda c: unicodedata.category(c).startswith("P") or c in "$+<=>^`|~"
    for c in plain:
        alone = sign(c) or "一" <= c <= "鿿"
        if alone or not runs or runs[-1][1]:
            runs.append([c, alone])
        else:
            runs[-1][0] += c
    total = 0
    for run, _ in runs:
        at, n = 0, 0
        while at < len(run) and len(run) <= 100:
            end = next((e for e in range(len(run), at, -1) if ("##" if at else "") + run[at:e] in vocabulary), None)
            if end is None:
                break
            at, n = end, n + 1
        total += n if at == len(run) and len(run) <= 100 else 1
    return total


VOCABULARY = ["un", "##aff", "##able", "##a", "##b", "##c", "a", "b", "aff", "x", "##xx", "##x", ",", "de", "##ja", "##", "#", "世", "ab", "##cab"]


def test_word_pieces_against_brute_force(spark):
    rng = random.Random(6)
    words = ["unaffable", "UNAFFABLE", "Déjà", "a,b", "世界a", "b" * 101, "a" * 100, "##x", "", "$5", "x​x", "a..b", "(un)aff."]
    words += ["".join(rng.choice("abcxun,é#-") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    vocabulary = spark.createDataFrame([(t,) for t in VOCABULARY], "token string")
    found = {r.word: r.n for r in wordpiece.word_tokens(spark.createDataFrame([(w,) for w in words + words + [None]], "word string"), vocabulary).collect()}
    assert found == {w: brute_tokens(w, set(VOCABULARY)) for w in words}
    texts = [(1, "un aff\tunaffable\nunaffable"), (2, None), (3, " "), (4, " ".join(words))]
    counts = {r.k: r.n_tokens for r in wordpiece.token_counts(spark.createDataFrame(texts, "k int, text string"), vocabulary, "k").collect()}
    assert counts == {k: sum(brute_tokens(w, set(VOCABULARY)) for w in (t or "").split()) for k, t in texts}
    assert {r.n for r in wordpiece.word_tokens(spark.createDataFrame([("abc",)], "word string"), vocabulary.limit(0)).collect()} == {1}


def test_words_do_not_move_to_be_counted(spark, monkeypatch):
    """Tasks count words under a vocabulary that they get whole; a larger one is joined, with the same counts."""
    vocabulary = spark.createDataFrame([(t,) for t in [*VOCABULARY, None, "", "a"]], "token string")
    texts = [(1, "un aff\u2003unaffable\x1cUN"), (2, None), (3, " \n"), (4, "Déjà,x\x85" + "b" * 101 + " 世a (ab)"), (4, "ab"), (5, "")]
    df = spark.createDataFrame(texts, "k int, text string")
    found = wordpiece.token_counts(df, vocabulary, "k")
    assert shuffles(found) == 1  # a number a document
    counts = {(r.k, r.n_tokens) for r in found.collect()}
    assert counts == {(1, sum(brute_tokens(w, set(VOCABULARY)) for w in ("un", "aff", "unaffableun"))), (2, 0), (3, 0), (5, 0), (4, sum(brute_tokens(w, set(VOCABULARY)) for w in ("Déjà,x", "b" * 101, "世a", "(ab)", "ab")))}
    monkeypatch.setattr(wordpiece, "MAX_PIECES", 3)
    assert wordpiece.shipped(vocabulary) is None
    assert {(r.k, r.n_tokens) for r in wordpiece.token_counts(df, vocabulary, "k").collect()} == counts


def doc_lines(spark, *pages):
    return spark.createDataFrame([("d", p, n, x) for p, page in enumerate(pages, 1) for n, x in enumerate(page)], "doc_id string, page long, line_no long, line string")


def test_chunks_by_word_pieces(spark):
    """A letter is a token, so the same text makes more chunks than by words, and none is over the cap."""
    vocabulary = spark.createDataFrame([(p + c,) for c in "abcdefghijklmnopqrstuvwxyz0123456789.|-:()" for p in ("", "##")], "token string")
    doc = doc_lines(spark, [f"Sentence number {i} has some words." for i in range(100)], ["Sales", "Region | 2020 | 2019", *[f"Row {i} | 1 | 2" for i in range(60)]])
    marked = sections.label_lines(doc)
    by_words, by_pieces = chunking.chunk(marked).collect(), chunking.chunk(marked, vocabulary=vocabulary).collect()
    tokens = {w: brute_tokens(w, {r.token for r in vocabulary.collect()}) for r in by_pieces for w in r.text.split()}
    size = lambda r: sum(tokens[w] for w in r.text.split())
    assert len(by_pieces) > 2 * len(by_words) and {r.content_type for r in by_pieces} == {"text", "table"}
    assert max(map(size, by_pieces)) <= chunking.CAP
    assert min(size(r) for r in by_pieces if r.content_type == "text" and r.page == 1) > 100


def test_a_document_moves_once_to_be_cut(spark, monkeypatch):
    """Lines are dealt by document and nothing moves after that; a vocabulary too large for tasks gives the same chunks."""
    vocabulary = spark.createDataFrame([(p + c,) for c in "abcdefghijklmnopqrstuvwxyz0123456789.|-:()" for p in ("", "##")], "token string")
    marked = sections.label_lines(doc_lines(spark, [f"Sentence number {i} has some words." for i in range(60)], ["Sales", "Region | 2020 | 2019", *[f"Row {i} | 1 | 2" for i in range(30)]], ["few"]))
    found = chunking.chunk(marked, vocabulary=vocabulary)
    assert shuffles(found) == 1
    ids = {tuple(r) for r in found.collect()}
    assert len(ids) > 4 and {r[0] for r in ids} == {f"d_p{p}_c{n}" for p in (1, 2) for n in range(1, 1 + sum(r[2] == p for r in ids))}
    monkeypatch.setattr(wordpiece, "MAX_PIECES", 3)
    assert {tuple(r) for r in chunking.chunk(marked, vocabulary=vocabulary).collect()} == ids


def kinds(spark, *pages):
    return [r.kind for r in chunking.segments(sections.label_lines(doc_lines(spark, *pages))).orderBy("page", "line_no").collect()]


def test_table_heads(spark):
    rows = ["North | 1 | 2", "South | 3 | 4"]
    text = "a line of prose that goes on for so long that it has certainly more than twelve words"
    assert kinds(spark, [text, "Net sales:", *rows]) == ["text", "table", "table", "table"]
    assert kinds(spark, ["as a percentage of revenue.", *rows]) == ["text", "table", "table"]
    assert kinds(spark, ["small letters here", *rows]) == ["text", "table", "table"]
    assert kinds(spark, ["Ends with a comma,", *rows]) == ["text", "table", "table"]
    assert kinds(spark, ["(In millions)", "2020 | 2019", *rows]) == ["table"] * 4
    assert kinds(spark, ["Years 2020 and 2019", "2020 | 2019"]) == ["text", "text"]
    assert kinds(spark, ["Title"], rows) == ["text", "table", "table"]  # on the page before
    assert kinds(spark, [*["Title"] * 8, *rows]) == ["text"] * 2 + ["table"] * 8
    # Of six lines between two tables three can head the second; the three that are left join the tables.
    assert kinds(spark, [*rows, "small one", "small two", "small three", "Operating:", "Other:", "More:", *rows]) == ["table"] * 10


def test_tables_as_text_and_markdown(spark):
    assert chunking.markdown([["2020", "2019"], ["Net sales:"], ["Total", "1|2", "3"]]) == "|  | 2020 | 2019 |\n|---|---|---|\n| Net sales: |  |  |\n| Total | 1/2 | 3 |"
    assert chunking.markdown([["September 28,", "September 29,"], ["2019", "2018"], ["Net", "1", "2"]], 2).split("\n")[0] == "|  | September 28, 2019 | September 29, 2018 |"
    assert chunking.table_chunks([(1, "Year ended | 2020 | 2019"), (1, "Year ended | 2018 | 2017")], "Item 7") is None
    made = chunking.chunk(sections.label_lines(doc_lines(spark, ["Year ended June 30, | 2020 | 2019", "Year ended June 30, | 2018 | 2017", "tail of small words"])))
    assert [(r.content_type, r.text) for r in made.collect()] == [("text", "Year ended June 30, 2020 2019 Year ended June 30, 2018 2017"), ] or made.count() == 1
    one = chunking.chunk(sections.label_lines(doc_lines(spark, ["Only | 1 | 2", "words that stand behind it"])))
    assert {r.content_type for r in one.collect()} <= {"text"}


def test_sentences():
    ends = lambda text: [int(x) for x in chunking.sentence_ends(pd.Series(text.split()))]
    assert ends("One two. Three four") == [2, 4]
    assert ends("In 2019. 2020 came. • Bullet here. Émile went.) “Yes. no") == [4, 7, 9, 11]
    assert ends('He said "no." She left! (So it is) ends') == [3, 5, 9]
    assert chunking.introduction([(1, "x. The following information, as of today, summarizes the leases.")]).startswith("The following")
    assert chunking.introduction([(1, "We list the lease terms in the tables below.")]) and chunking.introduction([(1, "Sales were as follows.")])
    assert chunking.introduction([(1, "The following year was good.")]) == ""
    assert chunking.introduction([(1, "See the table below."), *[(1, "and then some words")] * 6]) == ""


COVER = "FORM 10-K\nSecurities and Exchange Commission\nAnnual report pursuant to section 13"
SIGNED = "has duly caused this annual report to be signed"


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        (["letter", "Form 10-K filed with the Securities and Exchange Commission", COVER, "x", SIGNED, "x"], ("10-K_wrapped", 3, 5)),
        ([COVER, "SIGNATURES\nItem 1 Item 2 Item 3 Item 4", "x\n Signature \ny", "Acme | F-1 | 2020\na\nb\nc", "see F-2 for more\na\nb"], ("10-K", 1, 4)),
        ([COVER, "Pursuant to the requirements of the Section 13 or Section 15 ( d )", "a", "b", "c", "F - 12", "d", "e", "f", "g", "F-13"], ("10-K", 1, 6)),
        (["x", "Risk factors " + " ".join(f"Item {i}" for i in range(1, 12)), "y"], ("10-K_wrapped", 2, 3)),
        (["x", "Risk factors cross-reference " + " ".join(f"Item {i}" for i in range(1, 12)), None], ("annual_report", None, None)),
    ],
)
def test_report_ranges(spark, pages, want):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages, 1)], "doc_id string, page int, text string")
    assert [tuple(r)[1:] for r in sections.report_range(df).collect()] == [want]


def test_item_numbers(spark):
    cases = {
        "Item 1A. Risk": "1A", "ITEM 7": "7", "Item 2 | Properties": "2", "  Item 9B Other": "9B", "Item 7Discussion": "7", "Item 7 of this": "", "item 1": "", "Item 1AB": "", "Item 12a: x": "12A",
        "Item 3 – Legal": "3", "Item 3 (x)": "", "Items 1": "", "Item": "", "": "", "Item 123": "", "Item 5 | small": "",
    }
    df = spark.createDataFrame([(x,) for x in cases], "line string")
    assert {r.line: r.n for r in df.select("line", sections.item_number(F.col("line")).alias("n")).collect()} == cases


def test_contents_pages_are_not_headings(spark):
    toc = [f"Item {i}. Something | {i}0" for i in range(1, 6)]
    found = [r.section for r in sections.label_lines(doc_lines(spark, toc, ["Item 1. Business", "x"], toc[:3])).orderBy("page", "line_no").collect()]
    assert found == ["Unknown"] * 5 + ["Item 1", "Item 1", "Item 1", "Item 2", "Item 3"]
    assert np.array_equal(chunking.sentence_ends(pd.Series([], dtype=object)), [])
