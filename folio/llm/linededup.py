"""Line deduplication over levelled sorted runs of line hashes (operator 1). DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, new_path, read_rows_only, save

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() is the faster way where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2) of each line whose key has at least min_chars code points. The two 64-bit hashes make
    one of 128 bits, which no two keys of any corpus are expected to share. The text's hash tells rows of one doc_id apart."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "text_hash", "pos", F.btrim("line", F.lit(WHITE)).alias("line")).where(F.length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return lines.select("doc_id", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Runs of (h1, h2, n_docs, last_doc): partitions of one table in `buckets` buckets by the hash, each sorted by it.

    A new batch's keys are merge-anti-joined with the runs: keys that the runs already know as common, and whose largest
    document they know too, tell nothing new and are left out. The others become a run of level 0. Whenever a level holds
    `fan_in` runs they are merged into one run of the next level, so a hash is rewritten once a level, and the number of
    runs grows as the logarithm of the batches. As all runs are bucketed alike, neither join nor merge moves a run's rows:
    only a batch's own counted keys are shuffled. A document's lines must come in one batch. The table is named in the
    session's catalog until close().
    """

    def __init__(self, spark: SparkSession, min_docs: int, fan_in: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fan_in, self.levels, self.n_runs = spark, min_docs, fan_in, [[]], 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"runs_{uuid.uuid4().hex}"
        self.path = new_path(spark, self.name)

    def runs(self) -> list[int]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> int:
        self.n_runs += 1
        rows = rows.withColumn("run", F.lit(self.n_runs))
        (
            rows.write.mode("append").partitionBy("run").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        )
        return self.n_runs

    def merged(self, runs: list[int] | None = None) -> DataFrame:
        """All keys of the runs with their counts, from a grouped scan of the buckets."""
        rows = self.spark.table(self.name).where(F.col("run").isin(self.runs() if runs is None else runs))
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def common(self) -> DataFrame:
        return self.merged().where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "last_doc")

    def add(self, batch: DataFrame) -> None:
        """batch: rows of hashed_lines(). A document counts once for a key however often it has it."""
        held = batch.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        held = held.repartition(self.buckets, "h1", "h2")
        if self.runs():
            known = self.common().withColumnRenamed("last_doc", "known_last").hint("merge")
            same = (held.h1 == known.h1) & (held.h2 == known.h2) & (held.last_doc <= known.known_last)
            held = held.join(known, same, "left_anti")
        self.levels[0].append(self._write(held))
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fan_in:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self.merged(self.levels[level])))
                for run in self.levels[level]:
                    delete(self.spark, f"{self.path}/run={run}")
                self.levels[level] = []
                self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)
        self.levels = [[]]


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, carry: list[str] | None = None) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_lines, n_dropped, text), a row for each row of docs, with the columns of
    docs named in carry.

    A text is split at newlines; null and empty texts have one empty line. A line's key is the line without ASCII white
    space at its ends, with A-Z lower-cased. Keys of min_chars code points or more that at least min_docs documents
    have lose all lines except those in the largest doc_id that holds them. The other lines stay, joined by newlines.
    A text that loses all its lines becomes empty. Rows of one doc_id are one document when documents are counted, each row
    with its own lines; repeated rows get the same result each. Lines of rows without doc_id are neither counted nor dropped. An empty table gives no rows.

    Very long texts and lines are dealt with whole. Columns of docs that are not in carry are not read, so their names
    can't clash.

    The lines' hashes go through LineRuns in `batches` batches of documents, as crawls would arrive, from the largest ids
    to the smallest: a key that is common already then keeps its largest document, and later batches add nothing to it.
    Which lines of the early batches go is known only when all batches have come, so lines are dropped once, at the end,
    by the keys that the runs hold as common.
    """
    carried = {f"carried_{i}": c for i, c in enumerate(carry or [])}
    docs = read_rows_only(docs, doc_id="doc_id", text="text", **carried)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    batch = sum(((F.col("doc_id") <= c).cast("int") for c in cuts or []), F.lit(0))
    lines = save(hashed_lines(docs.select("doc_id", "text"), min_chars).withColumn("batch", batch), "lines", partition_by="batch")
    runs = LineRuns(docs.sparkSession, min_docs)
    try:
        for i in range(batches):
            runs.add(lines.where(F.col("batch") == i))
        common = save(runs.common(), "common")
    finally:
        runs.close()
    same = (lines.h1 == common.h1) & (lines.h2 == common.h2) & (lines.doc_id < common.last_doc)
    stay = lines.join(common, same, "left_anti").groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("stay"))
    split = docs.withColumn("text_hash", F.xxhash64("text")).join(stay, ["doc_id", "text_hash"], "left").withColumn("lines", split_lines(F.col("text")))
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    short = F.filter(places, lambda i: F.length(F.btrim(F.get("lines", i), F.lit(WHITE))) < min_chars)
    kept = F.when(F.col("doc_id").isNull(), places).otherwise(F.array_sort(F.array_union(short, F.coalesce("stay", F.array().cast("array<int>")))))
    return split.withColumn("kept", kept).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("text"),
        *[F.col(own).alias(c) for own, c in carried.items()],
    )
