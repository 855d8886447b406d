"""Readers and writers: object listings, inventories, chunk and document files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import CHUNK

#: The naming convention of the files, folder/exchange_ticker_year with an optional hash.
KEY = r"([^/]+)/(?:.*/)?([A-Z]+)_([A-Z0-9.\-]+)_((?:19|20)\d{2})(_[0-9a-f]{6,})?\.pdf$"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, bytes) of every file under a path, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("bytes"))


def parse_listing(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """objects(key, bytes) -> (inventory rows, keys that don't follow the convention)."""
    part = lambda i: F.regexp_extract("key", KEY, i)
    good = objects.where(F.col("key").rlike(KEY)).select(
        F.col("key").alias("s3_key"), part(1).alias("company"), part(2).alias("exchange"), part(3).alias("ticker"), part(4).cast("int").alias("fiscal_year"),
        F.round(F.col("bytes") / 1048576, 3).alias("size_mb"), (part(5) != "").alias("has_hash_suffix"),
    )
    return good, objects.where(~F.coalesce(F.col("key").rlike(KEY), F.lit(False)))


def one_per_year(inventory: DataFrame) -> DataFrame:
    """One file for each company and year: those without a hash first, then by key."""
    order = Window.partitionBy("company", "fiscal_year").orderBy("has_hash_suffix", "s3_key")
    return inventory.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def missing_files(expected: DataFrame, years: list[int], have: DataFrame) -> DataFrame:
    """(company, fiscal_year) that should be there and are not."""
    grid = expected.select("company", F.explode(F.array(*[F.lit(y) for y in years])).alias("fiscal_year"))
    return grid.join(have.select("company", "fiscal_year"), ["company", "fiscal_year"], "left_anti").orderBy("company", "fiscal_year")


def doc_id(ticker: Column, year: Column) -> Column:
    return F.concat_ws("_", F.upper(ticker), year.cast("string"), F.lit("10K"))


def with_metadata(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """files(file) with the inventory's ticker and year, else those of the file's own name; the rest in reject_reason. Of a file
    that the inventory lists more than once, the last by its column `at` (line number) counts, or else the largest row."""
    order = F.struct("at") if "at" in inventory.columns else F.struct("fiscal_year", "ticker")
    inventory = inventory.groupBy("file").agg(F.max_by(F.struct("ticker", "fiscal_year"), order).alias("r")).select("file", "r.*")
    own = F.regexp_extract("file", r"([A-Z0-9.\-]+)_((?:19|20)\d{2})", 1), F.regexp_extract("file", r"([A-Z0-9.\-]+)_((?:19|20)\d{2})", 2).try_cast("int")
    listed = inventory.select("file", F.col("ticker").alias("t"), F.col("fiscal_year").alias("y"))
    out = files.join(listed, "file", "left").withColumns({"ticker": F.coalesce("t", F.nullif(own[0], F.lit(""))), "fiscal_year": F.coalesce("y", own[1])}).drop("t", "y")
    known = F.col("ticker").isNotNull() & F.col("fiscal_year").isNotNull()
    return out.withColumns({"doc_id": F.when(known, doc_id(F.col("ticker"), F.col("fiscal_year"))), "reject_reason": F.when(~known, "no metadata")})


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks as JSON lines; blank lines are skipped, a broken line is an error."""
    return spark.read.schema(CHUNK).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, ddl: str, field: str = "questions") -> DataFrame:
    """A JSON list of records, or an object that holds the list in a field."""
    whole = spark.read.option("wholetext", True).text(path)
    plain = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")), f"array<struct<{ddl}>>")
    inside = F.from_json(F.when(~F.ltrim("value").startswith("["), F.col("value")), f"struct<`{field}`:array<struct<{ddl}>>>")[field]
    return whole.select(F.explode(F.coalesce(plain, inside)).alias("r")).select("r.*")


def _pages(batches: Iterator[pa.RecordBatch], parse: Callable[[bytes], list[list[str]]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            try:
                rows += [(path, p, n, line, None) for p, page in enumerate(parse(content.as_py()), 1) for n, line in enumerate(page)]
            except Exception as e:  # noqa: BLE001
                rows.append((path, None, None, None, type(e).__name__))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["path", "page", "line_no", "line", "error"])


def read_lines(spark: SparkSession, path: str, parse: Callable[[bytes], list[list[str]]]) -> DataFrame:
    """(path, page, line_no, line, error) of binary documents by an injected parser: bytes to pages of lines. A document that it
    can't read is one row with the error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _pages(batches, parse), "path string, page int, line_no int, line string, error string")


def fingerprint(settings: dict) -> str:
    import hashlib
    import json

    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()


def to_process(sources: DataFrame, done: DataFrame, current: str) -> DataFrame:
    """Sources that have no output of the current fingerprint."""
    return sources.join(done.where(F.col("fingerprint") == current).select("doc_id"), "doc_id", "left_anti")
