"""Runs that redo only what changed, and the index they write."""

import os

import pytest
from pyspark.sql import functions as F

from folio.operators import incremental, index

SOURCES = "source string, doc_id string, source_hash string, text string"


def sources(spark, *rows):
    return spark.createDataFrame([(s, d, h, f"text of {h}") for s, d, h in rows], SOURCES)


def actions(plan):
    return sorted(((r.doc_id or "", r.source or "", r.action, r.reason) for r in plan.collect()), key=str)


def test_plan(spark):
    found = sources(spark, ("a.pdf", "A", "1"), ("b.pdf", "B", "2"), ("c.pdf", "C", "3"), ("d.pdf", "D", "4"), ("d2.pdf", "D", "5"), ("x.pdf", None, "6"), ("e.pdf", "E", None), ("f.pdf", "F", "7"), ("g.pdf", "G", "7"))
    manifest = spark.createDataFrame(
        [("A", "a.pdf", "1", "v1", "done", None), ("B", "b.pdf", "old", "v1", "done", None), ("C", "c.pdf", "3", "v0", "done", None), ("F", "f.pdf", "7", "v1", "done", None), ("Z", "z.pdf", "9", "v1", "done", None)],
        incremental.MANIFEST,
    )
    want = [
        ("A", "a.pdf", "reuse", None), ("B", "b.pdf", "redo", None), ("C", "c.pdf", "redo", None), ("D", "d.pdf", "redo", None), ("D", "d2.pdf", "reject", "same document as d.pdf"),
        ("", "x.pdf", "reject", "no metadata"), ("E", "e.pdf", "reject", "no content"), ("F", "f.pdf", "duplicate", "same bytes as g.pdf"), ("G", "g.pdf", "duplicate", "same bytes as f.pdf"), ("Z", "", "orphan", None),
    ]
    assert actions(incremental.plan_run(found, manifest, "v1")) == sorted(want, key=str)
    assert ("Z", "", "prune", None) in actions(incremental.plan_run(found, manifest, "v1", prune=True))
    assert ("A", "a.pdf", "redo", None) in actions(incremental.plan_run(found, manifest, "v1", force=True))
    assert not [x for x in actions(incremental.plan_run(found, manifest, "v1", full=False)) if x[0] == "Z"]
    assert {r.action: r.n for r in incremental.summary(incremental.plan_run(found, manifest, "v1")).collect()}["redo"] == 3


def test_runs(spark, tmp_path):
    path, calls = str(tmp_path / "out"), []

    def process(df):
        calls.append(sorted(r.doc_id for r in df.collect()))
        return df.where("text not like '%bad%'").select("doc_id", "text"), df.where("text like '%bad%'").select("doc_id", F.lit("not in scope").alias("reason"))

    def rows():
        return sorted((r.doc_id, r.text) for r in index.read_documents(spark, path).collect())

    def run(*found, **more):
        counts = incremental.run(spark, sources(spark, *found), path, process, "v1", **more)
        called, calls[:] = list(calls), []
        return counts, called

    first = [("a", "A", "1"), ("b", "B", "2"), ("c", "C", "bad"), ("e", "E", "5")]
    assert run(*first) == ({"redo": 4}, [["A", "B", "C", "E"]])
    assert rows() == [("A", "text of 1"), ("B", "text of 2"), ("E", "text of 5")]
    before = index.current_version(spark, path)
    assert run(*first) == ({"reuse": 4}, []) and index.current_version(spark, path) == before
    # B changed, A is gone, D is a copy of E: neither D nor E can stay.
    second = [("b", "B", "3"), ("c", "C", "bad"), ("d", "D", "5"), ("e", "E", "5")]
    counts, called = run(*second)
    assert counts == {"redo": 1, "reuse": 1, "duplicate": 2, "orphan": 1} and called == [["B"]]
    assert rows() == [("A", "text of 1"), ("B", "text of 3")]
    assert {r.doc_id: r.status for r in incremental.read_manifest(spark, path).collect()} == {"A": "done", "B": "done", "C": "rejected", "D": "duplicate", "E": "duplicate"}
    before = index.current_version(spark, path)
    assert run(*second)[1] == [] and index.current_version(spark, path) == before
    assert run(*second, prune=True)[0]["prune"] == 1
    assert rows() == [("B", "text of 3")]
    # A broken run leaves everything as it was.
    before, have = index.current_version(spark, path), rows()

    def broken(df):
        return df.select("doc_id", F.raise_error(F.lit("broken")).cast("string").alias("text")), df.select("doc_id", F.lit("x").alias("reason")).limit(0)

    with pytest.raises(Exception, match="broken"):
        incremental.run(spark, sources(spark, ("b", "B", "4")), path, broken, "v1")
    assert index.current_version(spark, path) == before and rows() == have
    # The last document goes too, and an empty index has its schema still or says that it has nothing.
    assert run(prune=True)[0] == {"prune": 4} and index.current_folders(spark, path) == {}


def test_index_load_and_purge(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = lambda *ids: spark.createDataFrame([(d, f"{d}{n}") for d in ids for n in range(3)], "doc_id string, text string")
    ids = lambda *names: spark.createDataFrame([(d,) for d in names], "doc_id string")
    have = lambda: {r.doc_id for r in index.read_documents(spark, path).select("doc_id").distinct().collect()}
    index.load_documents(spark, docs("a", "b", "c"), path, ids("a", "b", "c"))
    index.load_documents(spark, docs("b"), path)
    assert have() == {"a", "b", "c"}
    index.load_documents(spark, docs("b", "d"), path, ids("b", "c", "d"))
    assert have() == {"b", "c", "d"} and index.read_documents(spark, path).count() == 9
    for _ in range(4):
        index.load_documents(spark, docs("b"), path)
    assert have() == {"b", "c", "d"} and len(os.listdir(f"{path}/versions")) == 3
