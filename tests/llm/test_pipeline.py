"""The pipeline's stages on small tables: each on all that the one before it kept, and run() equal to the stages in turn."""

import hashlib
import random

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm.queries import piece_model_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(spark, path):
    rng = random.Random(9)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    exam = text(30)
    docs = [(i, text(80)) for i in range(60)]
    docs += [(100 + i, text(60) + " badword") for i in range(40)]  # toxic
    docs += [(200 + i, f"{text(70)}\nThis very common line has more than forty characters") for i in range(6)]
    base = text(100).split()
    docs += [(300 + i, " ".join(base[:95] + [f"z{i}"] + base[96:])) for i in range(3)]  # near copies
    docs += [(400, text(40) + " " + exam), (401, None), (402, "")]
    rows = [(i, t, "en", None, len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(100 <= i < 140)) for i, _ in docs], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, exam)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(docs)


def test_stages(spark, tmp_path):
    sf_dir = str(tmp_path)
    texts = make(spark, sf_dir)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "sentencepiece"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        out = f"{sf_dir}/out{k}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        assert k == 4 or docs.columns == COLUMNS
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    every = set(texts)
    assert kept[0] == every - set(range(100, 140)) and kept[1] == kept[0]
    assert kept[2] == kept[1] - {301, 302} and kept[3] == kept[4] == kept[2] - {400}
    lines = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/out1").collect()}
    assert all(lines[i].text == texts[i].split("\n")[0] and lines[i].n_chars == len(lines[i].text) for i in range(200, 205))
    assert lines[205].text == texts[205] and lines[401].text in (None, "")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    for r in docs.collect():
        own = lines[r.doc_id].text or ""
        ids = sp.encode(own, add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.exceptAll(docs).isEmpty() and docs.exceptAll(whole).isEmpty()


def test_rows_without_id_pass(spark):
    docs = spark.createDataFrame([(None, "a", "x"), (1, "b", "x")], "doc_id long, text string, toxic string")
    assert corpus_pipeline.without(docs, docs.where("doc_id = 1")).collect()[0].text == "a"
    assert corpus_pipeline.drop_lines(spark, docs.withColumn("n_chars", F.lit(9)), "").select("toxic").count() == 2
