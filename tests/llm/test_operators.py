"""Each operator against a brute-force version on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm.components import components
from folio.llm.decontaminate import benchmark_matches, is_contaminated
from folio.llm.langid import identify, profiles
from folio.llm.linededup import LineRuns, drop_repeated_lines, hashed_lines
from folio.llm.neardup import near_duplicates
from folio.llm.queries import piece_model_path
from folio.llm.sentencepieces import encode_and_decode, load_model
from folio.llm.substrings import repeated_passages
from folio.llm.toxicity import toxicity
from folio.llm.urlfilter import DigestArray, filter_urls
from folio.llm.warc import canonical_url, resolve_revisits

SPACE = re.compile("[^\x20\x09-\x0d]+")
#: Further columns with the operators' own names.
DDL = "doc_id long, text string, kept string, sig string, k int, batch int, rep long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, 1, 2, 3) for i, t in rows], DDL)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def near_rows():
    rng = random.Random(1)
    rows = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, "two one")]
    i = 10
    for _ in range(12):
        base = words_of(rng, rng.choice([5, 30, 60, 300, 4000]))
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 18))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            rows.append((i, " ".join(copy)))
            i += 1
    passage = words_of(rng, 40)
    rows += [(i + j, " ".join(words_of(rng, 30) + passage + words_of(rng, 20))) for j in range(40)]
    rng.shuffle(rows)
    return rows + [rows[8], rows[8]]


def shingles(text):
    w = SPACE.findall(low(text))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("block_rows", [128, 3])
def test_near_duplicates(spark, block_rows):
    rows = near_rows()
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    found = near_duplicates(frame(spark, rows), block_rows=block_rows).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)


def test_bucket_of_many_small_components(spark):
    """700 pairs of near copies that all have more than half their words from one passage: they share buckets of over 512
    small components, and links inside them are found as in any other."""
    rng = random.Random(31)
    passage, rows = words_of(rng, 60, 5000), []
    for i in range(700):
        own = words_of(rng, 40, 5000)
        copy = list(own)
        copy[rng.randrange(20, 40)] = "changed"
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + copy))]
    sets = [shingles(t) for _, t in rows]
    held = defaultdict(list)
    for i, own in enumerate(sets):
        for x in own - sets[0]:
            held[x].append(i)
    links = {(min(x), max(x)) for x in held.values() if len(x) == 2}
    assert links == {(2 * i, 2 * i + 1) for i in range(1, 700)}
    assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
    assert 100 * len(sets[0] & sets[2]) < 75 * len(sets[0] | sets[2])
    found = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows)).collect()}
    assert found == {i: i - i % 2 for i in range(1400)}


def test_near_duplicates_of_one_id(spark):
    rng = random.Random(32)
    a, b = words_of(rng, 100), words_of(rng, 100)
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "a b")]
    assert {(r.doc_id, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    rows = [(0, " ".join(b)), (1, " ".join(a)), (1, " ".join(b)), (2, near(a))]
    assert {(r.doc_id, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_line_dedup(spark):
    rng = random.Random(2)
    common = ["A" * 39, "b" * 40, "É" + "c" * 45, "  " + "B" * 40 + "\t", "d" * 50, "e" * 60]
    rows = [(i, "\n".join(rng.choice([*common, "short", "", f"own line {i} " + "z" * 40]) for _ in range(rng.randrange(6)))) for i in range(40)]
    rows += [(None, "b" * 40), (50, None), (51, ""), (52, "\n")]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(strip(line)) >= 40:
                holders[low(strip(line))].add(i)
    found = drop_repeated_lines(frame(spark, rows)).collect()
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.n_lines, r.n_dropped, r.text))
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(holders[low(strip(x))]) < 5 or max(holders[low(strip(x))]) == i]
        assert got[i] == [(len(lines), len(lines) - len(stay), "\n".join(stay))]


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Rows of one id are one document when documents are counted, and keep their own lines."""
    hot = [c * 52 for c in "abcde"]
    rows = [(1, "short"), (1, "\n".join(hot)), (1, "\n".join(hot)), (1, f"{hot[0]}\nend"), *[(i, "\n".join(hot)) for i in range(2, 7)], (7, hot[0]), (7, f"x\n{hot[1]}"), (7, None)]
    found = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_repeated_lines(frame(spark, rows)).collect())
    last = "\n".join(hot[2:])
    assert found == sorted(
        [(1, 1, 0, "short"), (1, 5, 5, ""), (1, 5, 5, ""), (1, 2, 1, "end"), *[(i, 5, 5, "") for i in range(2, 6)], (6, 5, 2, last), (7, 1, 0, hot[0]), (7, 2, 0, f"x\n{hot[1]}"), (7, 1, 0, "")]
    )


def test_line_runs_are_compacted(spark):
    lines = hashed_lines(frame(spark, [(i, "x" * 40 + str(i % 3)) for i in range(27)]), 40)
    whole, runs = LineRuns(spark, 100), LineRuns(spark, 100, fan_in=3, buckets=3)
    whole.add(lines)
    for i in range(9):
        runs.add(lines.where(F.col("doc_id") % 9 == i))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(r.n_docs for r in runs.merged().collect()) == [9, 9, 9] and sorted(runs.merged().collect()) == sorted(whole.merged().collect())
    runs.close()
    whole.close()
    # Keys that are common already add nothing, unless a larger document holds them.
    runs = LineRuns(spark, 2, fan_in=9, buckets=3)
    for ids in ((20, 21, 22, 23, 24, 25), (1, 2, 3), (26,)):
        runs.add(lines.where(F.col("doc_id").isin(*ids)))
    assert [spark.table(runs.name).where(F.col("run") == run).count() for run in runs.runs()] == [3, 0, 1]
    assert sorted(r.last_doc for r in runs.common().collect()) == [24, 25, 26]
    plan = runs.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()


def test_decontamination(spark):
    rng = random.Random(3)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    items = [(i, " ".join(rng.choice("abcdé") for _ in range(rng.choice([2, 5, 13, 14, 30])))) for i in range(12)] + [(12, None), (13, "!!"), (3, "again A b")]
    rows = [(None, "a b"), (None, "again, a b"), (1, None), (2, ""), (3, "..."), (3, "again a b"), (3, "again a b")]
    for i in range(10, 40):
        t = [rng.choice("abcdé") for _ in range(rng.choice([3, 20, 200]))]
        at = rng.randrange(len(t))
        rows.append((i, ", ".join(t[:at] + [rng.choice(items)[1] or "z"] + t[at:]).upper()))
    windows = []
    for name, t in items:
        w = word.findall(low(t))
        size = min(13, len(w))
        windows += [(str(name), w[j : j + size]) for j in range(len(w) - size + 1) if size]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 300):
        found = benchmark_matches(frame(spark, rows), bench, block_chars=block).withColumn("bad", is_contaminated()).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted({m.item_id for m in r.matches}), r.bad) for r in found), key=repr)
        wanted = []
        for i, t in rows:
            w = word.findall(low(t))
            hit, names = set(), set()
            for name, own in windows:
                for j in range(len(w) - len(own) + 1):
                    if w[j : j + len(own)] == own:
                        hit |= set(range(j, j + len(own)))
                        names.add(name)
            wanted.append((i, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
        assert got == sorted(wanted, key=repr)


def test_sentencepiece_is_the_librarys(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    texts = [None, "", " ", "  two  spaces ", "a\nb\n\n c\r\n", "▁mark ▁▁", "日本語 テキスト 🎉", "x\x00y", "word " * 3000, "é" * 500]
    found = {r.doc_id: r for r in encode_and_decode(frame(spark, list(enumerate(texts))), load_model(piece_model_path()), max_chunks=3).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert [int.from_bytes(found[i].ids[j : j + 4], "little") for j in range(0, len(found[i].ids), 4)] == ids
        assert (found[i].n_tokens, found[i].decoded) == (len(ids), sp.decode(ids))


def test_language(spark):
    rng = random.Random(4)
    make = {"aa": lambda: " ".join(rng.choice(["the", "and", "with"]) for _ in range(30)), "bb": lambda: " ".join(rng.choice(["über", "und", "nicht"]) for _ in range(30))}
    rows = [(i, make[lang](), lang) for i, lang in enumerate(["aa", "bb"] * 20)] + [(90, None, "aa"), (91, "123 !", None), (92, "und nicht", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in identify(docs, profiles(docs)).collect()}
    assert all(found[i].lang_pred == lang and 0 <= found[i].score <= 1 for i, _, lang in rows[:40])
    assert [found[i].lang_pred for i in (90, 91, 92)] == ["und", "und", "bb"]
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words_of(rng, 50) + (["badword", "Stemlike" + str(i)] if i % 4 == 0 else []))) for i in range(400)] + [(500, None), (501, ""), (None, "badword")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400)] + [(7, None), (999, 1)], "doc_id long, toxic int")
    found = toxicity(frame(spark, rows), labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.toxic == (r.doc_id is None or r.doc_id < 400 and r.doc_id % 4 == 0) and r.kept != r.toxic and 0 <= r.severity <= 2
    assert {r.toxic for r in toxicity(frame(spark, rows), labels.where("toxic = 0")).collect()} == {False}


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.NET", "http://a.net/x", "http://b.example.net/en/1?q#f", "https://example.net/en", "x://example.com/de/", "http://notexample.com/de/",
            "http://w.org/fr/", "http://w.org/de/", "http://net/", "http://a.net:80/", "http://q.net?x/"]
    want = [None, None, None, None, "net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, "net/", None, None]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string, digest string")
    listed = spark.createDataFrame([("notexample.com/de/", True), ("a.net:80/", True), ("a.net:80/", False), (None, True), ("b.example.net/en/1", True)], "key string, block boolean")
    for size in (16 << 30, 0):
        found = {r.page_id: r for r in filter_urls(pages, listed, max_bytes=size).collect()}
        assert [found[i].rule for i in range(len(urls))] == want
        assert [i for i in found if found[i].verdict == "block"] == [4, 6, 7, 8, 11, 12]
    assert (found[5].host, found[5].path, found[5].verdict, found[4].verdict, found[10].verdict) == ("b.example.net", "/en/1", "allow", "block", "allow")
    assert filter_urls(pages, rules=()).where("verdict = 'allow'").count() == len(urls)
    assert filter_urls(pages.limit(0), listed).count() == 0 and filter_urls(pages.union(pages), listed.limit(0)).count() == 2 * len(urls)


def test_digest_array_settles_collisions():
    array = DigestArray.of([("block", "a/"), ("allow", "b/"), ("block", "c/")])
    texts = array.texts.to_pylist()
    packed = DigestArray.pack(np.zeros(3, np.int64), pa.array(texts, pa.string()), np.array([1, 0, 1]))
    array = DigestArray(np.frombuffer(packed, np.uint8))  # all digests are equal: the stored strings decide
    assert array.find(np.zeros(4, np.int64), pa.array([*texts, "d/"])).tolist() == [0, 1, 2, -1]
    assert array.find(np.ones(1, np.int64), pa.array(["a/"])).tolist() == [-1]


def test_digest_array_of_a_million(spark):
    name = F.concat(F.lit("host"), F.col("id"), F.lit(".com/"), F.xxhash64("id"))
    listed = spark.range(1_200_000).select(name.alias("key"), (F.col("id") % 3 > 0).alias("block"))
    pages = spark.range(0, 2_400_000, 1200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), name).alias("url"))
    found = {r.page_id: r.verdict for r in filter_urls(pages, listed, rules=(), otherwise="allow").collect()}
    assert found == {i: "block" if i < 1_200_000 and i % 3 else "allow" for i in range(0, 2_400_000, 1200)}


def test_revisits(spark):
    tag = lambda e=None, **more: {**({"etag": e} if e else {}), **more}
    rows = [
        (1, "http://A.com", "2020-01-01 00:00:00", "response", tag("x", **{"content-type": "t", "date": "1"})), (2, "https://a.com:443/#f", "2020-01-01 01:00:00", "revisit", tag("W/x", date="2", **{"content-type": "no"})),
        (3, "http://a.com/", "2020-03-01 00:00:00", "revisit", tag("y")), (4, "http://a.com/", "2019-03-01 00:00:00", "revisit", tag("x")), (5, "http://a.com/?b&a", "2020-03-01 00:00:00", "revisit", None),
        (6, None, "2020-03-01 00:00:00", "revisit", None), (7, "http://a.com/", None, "revisit", None), (8, "http://a.com/", "2020-03-02 00:00:00", None, None), (9, "http://a.com/", "2020-03-03 00:00:00", "revisit", tag()),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, ts string, kind string, headers map<string,string>").withColumn("ts", F.col("ts").cast("timestamp"))
    records = records.withColumns({"part": F.lit("x"), "found": F.lit(1), "canonical": F.lit("no")})
    for partitions in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = {r.record_id: r for r in resolve_revisits(records).collect()}
        assert {i: (r.response_id, r.outcome) for i, r in found.items()} == {
            2: (1, "resolved"), 3: (1, "mismatch"), 4: (None, "no response"), 5: (None, "no response"), 6: (None, "no response"), 7: (None, "no response"), 9: (1, "unchecked")
        }
        assert found[2].headers == {"etag": "W/x", "date": "2", "content-type": "t"} and found[3].headers is None
    assert spark.range(1).select(canonical_url(F.lit("http://u@H.com:80/p?z=1&a=2#f"))).first()[0] == "h.com/p?a=2&z=1"


@pytest.mark.parametrize("map_bits", [28, 7])
def test_passages(spark, map_bits):
    """With 7 bits the map is full and holds every key: the result is the same."""
    rng = random.Random(6)
    sentence = lambda n: " ".join(words_of(rng, n, 3000)).capitalize() + "."
    passage = " ".join(sentence(12) for _ in range(5))
    rows = [(i, " ".join(sentence(rng.randrange(4, 20)) for _ in range(8)) + (" " + passage if i % 5 == 0 else "") + "\n" + sentence(9)) for i in range(30)]
    rows += [(40, None), (41, ""), (None, passage)]
    found = repeated_passages(frame(spark, rows), map_bits=map_bits).collect()
    assert sorted({r.doc_id for r in found}) == [0, 5, 10, 15, 20, 25]
    assert all(r.first_doc == 0 and r.removed == (r.doc_id != 0) and r.n_words >= 48 for r in found)


def test_passages_without_sentences(spark):
    rng = random.Random(16)
    rows, planted = [], {}
    for i in range(120):
        passage, a, b = words_of(rng, rng.randrange(51, 61), 5000), rng.randrange(0, 200), rng.randrange(0, 200)
        rows += [(i, " ".join(words_of(rng, a, 5000) + passage + words_of(rng, 90, 5000))), (1000 + i, " ".join(words_of(rng, b, 5000) + passage))]
        planted |= {i: (a, len(passage), i, False), 1000 + i: (b, len(passage), i, True)}
    short = words_of(rng, 24, 5000)  # the shortest passage, and one word less
    rows += [(2000, " ".join(short)), (2001, " ".join(["x", *short, "y"])), (2002, " ".join(words_of(rng, 30, 5000) + short[1:]))]
    planted |= {2000: (0, 24, 2000, False), 2001: (1, 24, 2000, True)}
    # Against all 8-word runs of all documents.
    seen, texts = defaultdict(set), {i: t.split() for i, t in rows}
    for i, w in texts.items():
        for j in range(len(w) - 7):
            seen[tuple(w[j : j + 8])].add(i)
    brute = {}
    for i, w in texts.items():
        at = [j for j in range(len(w) - 7) if len(seen[tuple(w[j : j + 8])]) > 1]
        if at and at[-1] - at[0] + 8 >= 24:
            brute[i] = (at[0], at[-1] - at[0] + 8)
    assert brute == {i: p[:2] for i, p in planted.items()}
    found = repeated_passages(frame(spark, rows), percent=100).collect()
    assert len(found) == len(planted) and {r.doc_id: (r.start_word, r.n_words, r.first_doc, r.removed) for r in found} == planted
    # At 75 % a paragraph may bring some words of its host.
    found = {r.doc_id: r for r in repeated_passages(frame(spark, rows)).collect()}
    assert set(found) == set(planted)
    for i, (start, n, first_doc, removed) in planted.items():
        r = found[i]
        assert r.start_word <= start and r.start_word + r.n_words >= start + n and (r.first_doc, r.removed) == (first_doc, removed)


def test_passages_keep_a_copy(spark):
    rng = random.Random(26)
    sentence = lambda n: " ".join(words_of(rng, n, 5000)).capitalize() + "."
    for text in (lambda: " ".join(sentence(12) for _ in range(4)), lambda: " ".join(words_of(rng, 45, 5000))):
        a, b, c = text(), text(), text()
        rows = [(1, f"{text()} {a}"), (5, f"{a} {b} {c}"), (7, f"{c} {text()}"), (9, f"{text()} {b}"), (11, f"{b} {c}")]
        left = {i: t.split() for i, t in rows}
        for r in repeated_passages(frame(spark, rows)).where("removed").collect():
            left[r.doc_id][r.start_word : r.start_word + r.n_words] = [None] * r.n_words
        copies = [sum(f" {x} " in " " + " ".join(w or "-" for w in words) + " " for words in left.values()) for x in (a, b, c)]
        assert copies == [1, 1, 1]


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(50)] + [(100, j) for j in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    parent = {x: x for link in links[:-2] for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links[:-2]:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in parent if x in found} and {x for a, b in links[:-2] if a != b for x in (a, b)} == set(found)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert near_duplicates(none).count() == drop_repeated_lines(none).count() == repeated_passages(none).count() == 0
    assert benchmark_matches(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert benchmark_matches(frame(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")).collect()[0].n_words == 2
    assert toxicity(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
