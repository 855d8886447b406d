"""From raw documents to training tokens, each stage on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and the next
stage reads that. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import delete, new_path, scratch, sha256_hex, table
from folio.llm.decontaminate import benchmark_matches, is_contaminated
from folio.llm.linededup import drop_repeated_lines
from folio.llm.neardup import near_duplicates
from folio.llm.queries import piece_model_path
from folio.llm.sentencepieces import encode_and_decode, load_model
from folio.llm.toxicity import toxicity


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs but those whose doc_id is rejected. Rows without doc_id stay."""
    return docs.join(rejected.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels finds toxic go; null and empty texts are clean, repeated rows share their
    fate, an empty table stays empty. Rows of one doc_id go together if one of them is toxic."""
    return without(docs, toxicity(docs, table(spark, sf_dir, "labels")).where("toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other lines stay, n_chars follows the text; the document stays even if nothing is left of it. Null texts become
    empty, repeated rows get the same text, rows without doc_id stay whole; an empty table stays empty."""
    return drop_repeated_lines(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")]).select(
        *[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays, with all its rows; null, empty and blank texts stay, as
    do rows without doc_id; an empty table stays empty."""
    return without(docs, near_duplicates(docs).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; null and empty texts stay, repeated rows share their fate, rows of one doc_id go together
    if one of them is contaminated, rows without doc_id stay; an empty table or benchmark drops nothing."""
    return without(docs, benchmark_matches(docs, table(spark, sf_dir, "benchmark")).where(is_contaminated()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs; null and empty texts have the begin and end ids only."""
    out = encode_and_decode(docs, load_model(piece_model_path()))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A regression and a tokenizer have no SQL; the stages are tested one by one and against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next begins; what its operator saved on the way goes then, and the rows of
    the stage before it go once they are read."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before, path = path, new_path(spark, name.replace(" ", "-"))
        with scratch():
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
