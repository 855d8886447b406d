"""Helpers that every operator of this subpackage shares: tables in the shared folder, and reading inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written inside each open scratch() block, the innermost last.
_open_blocks: list[list[tuple[SparkSession, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process gets
    a folder of its own, set once; on a cluster that is an error, as no local folder is shared there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folio-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the scratch() block around the call, if any, deletes it in the end."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open_blocks:
        _open_blocks[-1].append((spark, path))
    return path


def save(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut and a lost executor costs nothing
    that was finished. The path is in the result's `saved_at`, for forget()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    # The result is read from its files from now on, so the shuffle files of this one command can go when it ends.
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that save() wrote, once nothing will read them again."""
    for df in tables:
        delete(df.sparkSession, df.saved_at)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, every table that operators wrote inside the block. An operator's result still reads some of
    its tables, so write the result before the block ends."""
    _open_blocks.append([])
    try:
        yield
    finally:
        for spark, path in _open_blocks.pop():
            delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(text: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def read_rows_only(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that further or clashing columns of the input
    never meet the operator's own."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])
