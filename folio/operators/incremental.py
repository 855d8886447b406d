"""Runs that redo only what changed: a manifest of sources, one join that decides, and outputs that are switched with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index

MANIFEST = "doc_id string, source string, source_hash string, fingerprint string, status string, reason string"
REUSE, REDO, DUPLICATE, REJECT, PRUNE, ORPHAN = "reuse", "redo", "duplicate", "reject", "prune", "orphan"


def plan_run(sources: DataFrame, manifest: DataFrame, fingerprint: str, prune: bool = False, force: bool = False, full: bool = True) -> DataFrame:
    """sources(source, doc_id, source_hash), manifest(MANIFEST) -> (doc_id, source, source_hash, action, reason), a row for each
    source and each document of the manifest that has none.

    reject: a source without doc_id or hash, or whose doc_id a source of a smaller name has. duplicate: sources of the same
    bytes, all of them, as nobody can tell which is meant; the reason names the others' first. reuse: the manifest has the
    document done, or rejected, from the same bytes and by the same fingerprint, and force is off. redo: all other sources.
    prune: documents of the manifest without a source; orphan, if prune is off; neither is told unless the run is full.
    """
    usable = F.col("doc_id").isNotNull() & F.col("source_hash").isNotNull()
    good = sources.where(usable).select("source", "doc_id", "source_hash")
    # Copies are counted by an aggregate that is combined before it moves; only hashes of several sources are joined back.
    copies = good.groupBy("source_hash").agg(F.count("*").alias("n"), F.min("source").alias("first"), F.max("source").alias("last")).where("n > 1")
    good = good.join(copies, "source_hash", "left")
    first = good.where("n is null").groupBy("doc_id").agg(F.min("source").alias("used"))
    good = good.join(first, "doc_id", "left")
    other = F.when(F.col("source") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    bad = F.when(F.col("n") > 1, DUPLICATE).when(F.col("source") != F.col("used"), REJECT)
    why = F.when(F.col("n") > 1, F.concat(F.lit("same bytes as "), other)).when(F.col("source") != F.col("used"), F.concat(F.lit("same document as "), F.col("used")))
    told = good.select("doc_id", "source", "source_hash", bad.alias("action"), why.alias("reason"))
    unusable = sources.where(~usable).select("doc_id", "source", "source_hash", F.lit(REJECT).alias("action"), F.when(F.col("doc_id").isNull(), "no metadata").otherwise("no content").alias("reason"))
    known = manifest.select(F.col("doc_id").alias("known_id"), F.col("source_hash").alias("known_hash"), F.col("fingerprint").alias("known_fingerprint"), F.col("status").alias("known_status"), F.col("reason").alias("known_reason"))
    both = told.where("action is null").join(known, told.doc_id == known.known_id, "full_outer" if full else "left")
    same = (F.col("known_hash") == F.col("source_hash")) & (F.col("known_fingerprint") == fingerprint) & F.col("known_status").isin("done", "rejected") & F.lit(not force)
    action = F.when(F.col("source").isNull(), PRUNE if prune else ORPHAN).when(same, REUSE).otherwise(REDO)
    decided = both.select(F.coalesce("doc_id", "known_id").alias("doc_id"), "source", "source_hash", action.alias("action"), F.when(same, F.col("known_reason")).alias("reason"))
    # A document of the manifest whose sources are duplicates has sources.
    has_source = told.where("action is not null").select("doc_id").distinct()
    gone = decided.where("source is null").join(has_source, "doc_id", "left_anti")
    return decided.where("source is not null").union(gone).union(told.where("action is not null")).union(unusable)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the current version; an empty one before the first run."""
    version = index.current_version(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/{version}/manifest") if version else spark.createDataFrame([], MANIFEST)


def run(spark: SparkSession, sources: DataFrame, path: str, process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], fingerprint: str, prune: bool = False, force: bool = False) -> dict[str, int]:
    """Bring the outputs at path up to date with sources(source, doc_id, source_hash, ...) and return how many sources met each
    action. process: sources to redo -> (rows with doc_id, rejected(doc_id, reason)); it sees nothing else, and is not called
    if there is none. Rows and manifest are put in place together at the end, so a run that breaks leaves the version before
    it whole, and a run that finds nothing to do writes nothing. Outputs of duplicates and rejected documents go."""
    manifest = read_manifest(spark, path)
    plan = plan_run(sources, manifest, fingerprint, prune, force)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    listed = manifest.select("doc_id", "status", "reason")
    noted = plan.where(F.col("action") == DUPLICATE).groupBy("doc_id").agg(F.min("source").alias("source"), F.min("source_hash").alias("source_hash"), F.min("reason").alias("reason"))
    new_notes = noted.join(listed.where("status = 'duplicate'"), ["doc_id", "reason"], "left_anti").count() if counts.get(DUPLICATE) else 0
    if not counts.get(REDO) and not counts.get(PRUNE) and not new_notes:
        return counts
    columns = ["doc_id", "source", "source_hash", "fingerprint", "status", "reason"]
    row = lambda df, status: df.select("doc_id", "source", "source_hash", F.lit(fingerprint).alias("fingerprint"), F.lit(status).alias("status"), "reason")
    redo = plan.where(F.col("action") == REDO).select("doc_id", "source")
    gone = plan.where(F.col("action").isin(PRUNE)).select("doc_id").union(noted.select("doc_id"))
    rows = spark.createDataFrame([], "doc_id string") if not counts.get(REDO) else None
    rejected = spark.createDataFrame([], "doc_id string, reason string")
    if counts.get(REDO):
        rows, rejected = process(sources.join(redo, ["doc_id", "source"], "left_semi"))
    elif index.current_folders(spark, path):
        rows = index.read_documents(spark, path).limit(0)
    rejected = rejected.groupBy("doc_id").agg(F.min("reason").alias("why"))
    made = plan.where(F.col("action") == REDO).join(rejected, "doc_id", "left")
    made = made.select("doc_id", "source", "source_hash", F.lit(fingerprint).alias("fingerprint"), F.when(F.col("why").isNull(), "done").otherwise("rejected").alias("status"), F.col("why").alias("reason"))
    touched = redo.select("doc_id").union(gone)
    old = manifest.join(touched.distinct(), "doc_id", "left_anti").select(columns)
    after = old.union(made).union(row(noted, "duplicate"))
    kept = rows.join(rejected.select("doc_id"), "doc_id", "left_anti")
    index.replace_documents(spark, kept.select(rows.columns), path, touched, extra={"manifest": after})
    return counts


def summary(plan: DataFrame) -> DataFrame:
    """(action, n, first): sources of each action and the first document among them."""
    return plan.groupBy("action").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
