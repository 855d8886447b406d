"""Prefix tries, filter audits and token shards against brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folio.llm.filteraudit import filter_audit
from folio.llm.prefixtrie import distinct_conversations, prefix_trie, rebuilt_conversations
from folio.llm.queries import word_model
from folio.llm.tokenfiles import EliasFano, PieceTable, Shard, check_model, token_files, write_token_shards

WORD = re.compile("[^\x20\x09-\x0d]+")
#: Further columns with the operators' own names.
TALK = "conv_id long, turn long, role string, text string, own string, family int, words int, key string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], TALK)


def digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        value = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += value
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], digest(ends[p])) for p, m in members.items())


def found_trie(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed=3):
    rng = random.Random(seed)
    openings = [("system", "be kind and   brief"), ("user", "hello"), ("user", None), (None, "\t a\x0bb ")]
    rows = []
    for c in [*range(0, 130), 405, 419, 2**40 + 3]:
        if c in (20, 57):
            continue
        turns = [openings[min(rng.randrange(9), 3)]]
        for _ in range(rng.choice([0, 1, 2, 3, 5, 30 if c % 31 == 0 else 4])):
            turns.append((rng.choice(["user", "assistant", ""]), f"t{rng.randrange(2)} w w"))
        rows += [(c, None if i == 0 and rng.random() < 0.2 else i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "no id"), (41, 1, "user", "tie a"), (41, 1, "assistant", "tie b"), (42, 9, "user", "same"), (42, 9, "user", "same")]
    # a hot chain: many conversations share 40 turns and then differ, some end inside it
    chain = [("user", f"deep {i}") for i in range(40)]
    for c in range(1000, 1060):
        own = chain[: 40 if c % 5 else rng.randrange(4, 40)] + ([("user", f"end {c // 3}")] if c % 5 else [])
        rows += [(c, i, r, t) for i, (r, t) in enumerate(own)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most_paths", [200, 3])
def test_prefix_trie(spark, most_paths):
    rows = conversations()
    assert found_trie(prefix_trie(talk(spark, rows), most_paths=most_paths, turns_each=50)) == brute_trie(rows)


def test_prefix_trie_of_copies(spark):
    """A third of all conversations are the same one: they are joined by blocks of ids, in numeric order."""
    rows = [(c, i, "user", f"turn {i}") for c in range(0, 6000, 7) for i in range(4)] + [(c, 0, "user", f"own {c}") for c in range(1, 600, 7)]
    assert found_trie(prefix_trie(talk(spark, rows), most_paths=5)) == brute_trie(rows)
    assert distinct_conversations(rebuilt_conversations(talk(spark, rows))).where("n > 1").count() < 20


def test_prefix_trie_of_few(spark):
    assert prefix_trie(talk(spark, [(None, 1, "user", "x")])).count() == 0
    assert prefix_trie(talk(spark, [])).count() == 0
    rows = [(3, 0, None, None)]  # crc32("3") % 4 turns of its own go, and there is no conversation 0
    assert found_trie(prefix_trie(talk(spark, rows))) == brute_trie(rows)
    rows = [(0, 0, "user", "word " * 300_000)]
    assert found_trie(prefix_trie(talk(spark, rows))) == brute_trie(rows)


DOC = "doc_id long, text string, source string, part string, n int, k1 long, word string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOC)


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(low.get(t or "", i), i)
    judged = defaultdict(list)
    for i, text, source in rows:
        t, w = text or "", WORD.findall(text or "")
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t],
        }
        judged[source or ""].append((fails, i in good, i in toxic))
    out = []
    for part, rows_ in judged.items():
        shapley, own = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = list(range(len(rows_)))
            for step, f in enumerate(order, 1):
                gone = [x for x in left if rows_[x][0][f]]
                redundant = sum(r[0][f] for r in rows_) - len(gone)
                left = [x for x in left if not rows_[x][0][f]]
                shapley[f] += len(gone)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows_)
                own.append(["".join(order), step, len(left), len(gone), redundant, alone, sum(rows_[x][1] for x in gone), sum(rows_[x][2] for x in gone), f])
        out += [(part, *x[:-1], shapley[x[-1]]) for x in own]
    return sorted(out)


def audit_rows():
    rng = random.Random(5)
    rows = [(None, "no id", "a"), (None, "no id", "a"), (1, None, None), (2, "", ""), (3, " \n\t ", "b"), (4, "É" * 60, "b"), (4, "another text of one id", "b"), (5, "x", "c"), (5, "x", "c"), (5, "x", "d")]
    for i in range(10, 150):
        words = [rng.choice(["Word", "word", "W", "b,", "é", f"n{rng.randrange(200)}", "a|b" if i % 9 == 0 else "c"]) for _ in range(rng.choice([3, 49, 50, 80, 200]))]
        rows.append((i, rng.choice([" ", "\n", "\x0b  "]).join(words), rng.choice(["a", "b", None, "c"])))
    rows += [(200 + i, rows[20][1], "a") for i in range(60)] + [(900, "long words " * 100_000, "d")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] + [(10, 0, 1), (10, 1, 0), (None, 1, 1)]
    return rows, labels


def test_filter_audit(spark):
    rows, labels = audit_rows()
    found = filter_audit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert found.columns == columns
    assert sorted(tuple(r) for r in found.collect()) == brute_audit(rows, labels)


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(docs(spark, []), none).count() == 0
    assert filter_audit(docs(spark, [(1, "x", "s")]), none).count() == 600


@pytest.mark.parametrize("numbers", [[], [0], [7, 7, 7], [-5, -5, 10**15], list(range(300)) + [10**9 + i for i in range(300)]])
def test_elias_fano(numbers):
    code = EliasFano.of(EliasFano.encode(np.array(numbers, np.int64)))
    assert code.all().tolist() == numbers
    assert [code.select(i) for i in range(len(numbers))] == numbers
    with pytest.raises(IndexError):
        code.select(len(numbers))


def test_elias_fano_is_small():
    numbers = np.cumsum(np.random.default_rng(1).integers(0, 2000, 10_000))
    data = EliasFano.encode(numbers)
    assert len(data) < 10_000 * (2 + np.log2(numbers[-1] / 10_000) + 1) / 8 + 100
    code = EliasFano.of(data)
    assert [code.select(i) for i in range(0, 10_000, 37)] == numbers[::37].tolist()


TRICKY = [
    "", " ", "I'm 'S don''t 'll'", "ΑΣ ΑΣ. İstanbul ıı ŉ ſ ß ẞ", "é ́x", "a<|endoftext|>b <|startoftext|>", "x\x1cy\u0085z w　v", "日本語 한국어 가", "½²³ 12 3a4", "µ ª º × ÷ Ÿ",
    "\x00 \x01a", "👍🏽 ﬁ Ǆ", "w" * 3000, " a b\x0b\x0cc",
]


def test_pieces_equal_the_library():
    model = word_model()
    tokenizer = Tokenizer.from_str(model)
    rng = random.Random(2)
    alphabet = "aAzZ09 .,'\"-\n\téÉßŒİıµªŉΣσ́ <|>日½s"
    texts = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    for most in (1_000_000, 40):
        ids, sizes = PieceTable(model, most).encode(pa.array(texts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_model_that_joins_words():
    with pytest.raises(ValueError):
        check_model(word_model().replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'))


def token_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "cat's", "é", "naïve,", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(80)))) for i in range(-20, 400)]
    rows += [(1000 + i, t) for i, t in enumerate(TRICKY)] + [(None, "no id"), (None, None), (5000, None), (5001, "long text " * 300_000), (7, rows[27][1])]
    rng.shuffle(rows)
    return rows


def test_token_files(spark):
    model, rows = word_model(), token_rows()
    tokenizer = Tokenizer.from_str(model)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, ids string")
    found = token_files(df, model).collect()
    assert len(found) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    place = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == place
        assert (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        place += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files(df.limit(0), model).count() == 0


def test_shards_open_anywhere(spark, tmp_path):
    """Small shards, each document found by select alone."""
    model, rows = word_model(), [(i, f"text {i} " * (i % 7)) for i in range(300)]
    tokenizer = Tokenizer.from_str(model)
    write_token_shards(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "shards"), model, shard_ids=50)
    shards = spark.read.parquet(str(tmp_path / "shards")).orderBy("part", "shard").collect()
    assert sum(s.n_docs for s in shards) == 300 and {s.width for s in shards} == {2}
    for s in shards:
        shard = Shard(s.ids, s.width, s.bounds, s.doc_ids, s.n_null)
        for k in range(len(shard)):
            text = rows[shard.doc_id(k)][1]
            assert shard.document(k).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
