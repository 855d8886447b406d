"""The chunk table as an index: counts, catalog, what is stale, what must be embedded, and safe replacement."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import INDEXED, SchemaMismatchError, schema_problems

#: Captions of the items of the public form of annual reports.
SECTION_TITLES = {
    "Item 1": "Business", "Item 1A": "Risk Factors", "Item 1B": "Unresolved Staff Comments", "Item 2": "Properties", "Item 3": "Legal Proceedings",
    "Item 4": "Mine Safety Disclosures",
    "Item 5": "Market for Registrant's Common Equity, Related Stockholder Matters and Issuer Purchases of Equity Securities",
    "Item 6": "Selected Financial Data", "Item 7": "Management's Discussion and Analysis of Financial Condition and Results of Operations",
    "Item 7A": "Quantitative and Qualitative Disclosures About Market Risk", "Item 8": "Financial Statements and Supplementary Data",
    "Item 9": "Changes in and Disagreements with Accountants on Accounting and Financial Disclosure", "Item 9A": "Controls and Procedures",
    "Item 9B": "Other Information", "Item 9C": "Disclosure Regarding Foreign Jurisdictions that Prevent Inspections",
    "Item 10": "Directors, Executive Officers and Corporate Governance", "Item 11": "Executive Compensation",
    "Item 12": "Security Ownership of Certain Beneficial Owners and Management and Related Stockholder Matters",
    "Item 13": "Certain Relationships and Related Transactions, and Director Independence",
    "Item 14": "Principal Accountant Fees and Services", "Item 15": "Exhibits and Financial Statement Schedules", "Item 16": "Form 10-K Summary",
}


def section_title(section: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for pair in SECTION_TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, section), F.lit(""))


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as the index keeps them; a column of a name that the index makes itself is an error."""
    if clash := {"chunk_type", "section_title", "embedding"} & set(chunks.columns):
        raise ValueError(f"reserved names: {sorted(clash)}")
    return chunks.withColumnRenamed("content_type", "chunk_type").withColumn("section_title", section_title(F.col("section")))


def embedding_text() -> Column:
    """Company (ticker) | Fiscal year | section title, then the chunk; what is unknown is left out."""
    name = F.coalesce("company_name", F.initcap(F.replace("company", F.lit("-"), F.lit(" "))))
    section = F.when(F.col("section") != "Unknown", F.concat_ws(" ", "section", F.nullif("section_title", F.lit(""))))
    return F.concat(F.concat_ws(" | ", F.concat(name, F.lit(" ("), "ticker", F.lit(")")), F.concat(F.lit("Fiscal "), "fiscal_year"), section), F.lit("\n"), "text")


def stats(rows: DataFrame, dims: list[str], id_column: str) -> DataFrame:
    """(field, value, n, n_ids): rows and distinct ids by each dimension and over all, from one scan of grouping sets."""
    out = rows.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(F.count("*").alias("n"), F.count_distinct(id_column).alias("n_ids"), F.grouping_id(*dims).alias("gid"))
    full, field, value = (1 << len(dims)) - 1, F.lit("all"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = full ^ (1 << (len(dims) - 1 - i))
        field, value = F.when(F.col("gid") == gid, d).otherwise(field), F.when(F.col("gid") == gid, F.col(d).cast("string")).otherwise(value)
    return out.select(field.alias("field"), value.alias("value"), "n", "n_ids")


def most_frequent(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The most frequent value of a column for each key; of equally frequent ones the first in order."""
    counted = rows.groupBy(*keys, name).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(name)))
    return counted.withColumn("place", first).where("place = 1").drop("place")


def stale(indexed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys of the index that have no source any more."""
    return indexed.select(key).distinct().join(current.select(key), key, "left_anti")


def orphans(outputs: list[DataFrame], ids: DataFrame, key: str) -> DataFrame:
    """Keys that any of several outputs has and the sources don't, once each."""
    every = outputs[0].select(key)
    for other in outputs[1:]:
        every = every.union(other.select(key))
    return every.distinct().join(ids.select(key), key, "left_anti")


def text_key(model: str, text: Column) -> Column:
    """The cache key of an embedding: a hash of the model's name and the exact text."""
    return F.sha2(F.concat(F.lit(model + "\n"), text).cast("binary"), 256)


def cache_misses(rows: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct texts that no cached vector has, with their key."""
    keyed = rows.where(F.col(text).isNotNull()).select(text_key(model, F.col(text)).alias("key"), F.col(text).alias("text"))
    return keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def embedded(rows: DataFrame, cache: DataFrame, model: str, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, the cache with what was missing). Only texts without a usable vector are embedded."""
    usable = cache.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: ~F.isnan(x)))
    new = cache_misses(rows, usable, model).select("key", embed(F.col("text")).cast("array<float>").alias("embedding"))
    whole = usable.select("key", "embedding").union(new)
    return rows.withColumn("key", text_key(model, F.col("text"))).join(whole, "key", "left").drop("key"), whole


def duplicates(rows: DataFrame, content: str, name: str) -> DataFrame:
    """Every row whose content another row has too: (hash, name, n, first)."""
    keyed = rows.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("hash"), name)
    groups = keyed.groupBy("hash").agg(F.count("*").alias("n"), F.min(name).alias("first")).where("n > 1")
    return keyed.join(groups, "hash")


def replace_documents(spark: SparkSession, new: DataFrame, path: str, replaced: DataFrame | None = None, buckets: int = 64, keep_versions: int = 3, extra: dict[str, DataFrame] | None = None) -> str:
    """Write the index anew with the documents' chunks in place of those of the same doc_id, and return the new version. `replaced`
    (doc_id) names the documents that are replaced, so that one whose new version has no chunks goes; by default those of `new`.
    Rows lie in `buckets` folders by the hash of doc_id. One job reads the touched folders once and writes them; the version
    is a list of folders, put in place by one small file at the end, so a reader sees the old version or the new one.
    `extra` are further tables of the version, switched with it. Files that the last keep_versions versions don't use are
    deleted; a reader that is slower than so many versions must ask for more."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    ids = (new if replaced is None else replaced).select("doc_id").distinct()
    folders = current_folders(spark, path)
    touched = [r["b"] for r in ids.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
    version, rows = uuid.uuid4().hex, new
    if old := [f"{path}/{folders[b]}" for b in touched if b in folders]:
        rows = spark.read.schema(new.schema).parquet(*old).join(ids, "doc_id", "left_anti").select(new.columns).union(new)
    rows.withColumn("b", bucket).repartition("b").write.partitionBy("b").parquet(f"{path}/{version}")
    written = {int(name[2:]) for name in _names(spark, f"{path}/{version}") if name.startswith("b=")}
    for b in touched:
        folders.pop(b, None)
    folders |= {b: f"{version}/b={b}" for b in touched if b in written}
    for name, df in (extra or {}).items():
        df.write.parquet(f"{path}/{version}/{name}")
    listed = spark.createDataFrame([(b, f, buckets) for b, f in sorted(folders.items())] or [(None, None, buckets)], "b int, folder string, buckets int")
    listed.coalesce(1).write.json(f"{path}/versions/{version}")
    before = current_version(spark, path)
    _point_to(spark, path, version)
    _clean_up(spark, path, version, before, keep_versions)
    return version


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []


def _clean_up(spark: SparkSession, path: str, version: str, before: str | None, keep: int) -> None:
    """Each version names the one before it; folders that none of the newest `keep` versions lists go, oldest names too."""
    spark.createDataFrame([(before,)], "before string").coalesce(1).write.json(f"{path}/history/{version}")
    kept, at = [], version
    while at and len(kept) < max(1, keep):
        kept.append(at)
        at = spark.read.schema("before string").json(f"{path}/history/{at}").first()["before"] if at in _names(spark, f"{path}/history") else None
    used = {f for v in kept for f in _folders(spark, path, v).values()} | {v for v in kept}
    fs, _ = _fs(spark, path)
    for name in set(_names(spark, path)) - {"versions", "history", "CURRENT"}:
        inside = [x for x in _names(spark, f"{path}/{name}") if x.startswith("b=")]
        for folder in inside:
            if name not in kept and f"{name}/{folder}" not in used:
                fs.delete(_fs(spark, f"{path}/{name}/{folder}")[1], True)
        if name not in kept and not any(f.startswith(f"{name}/") for f in used):
            fs.delete(_fs(spark, f"{path}/{name}")[1], True)
    for kind in ("versions", "history"):
        for name in set(_names(spark, f"{path}/{kind}")) - set(kept):
            fs.delete(_fs(spark, f"{path}/{kind}/{name}")[1], True)


def load_documents(spark: SparkSession, new: DataFrame, path: str, all_ids: DataFrame | None = None) -> str:
    """Put the chunks of `new` in the index. With all_ids (doc_id), a full load: documents that the index has and all_ids
    hasn't leave it with the same switch."""
    replaced = new.select("doc_id")
    if all_ids is not None and current_version(spark, path):
        replaced = replaced.union(stale(read_documents(spark, path), all_ids, "doc_id"))
    return replace_documents(spark, new, path, replaced)


def _point_to(spark: SparkSession, path: str, version: str) -> None:
    """Put the name of the version into the pointer file: written beside it and moved over it by one call."""
    jvm = spark._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jpath.toUri(), spark._jsc.hadoopConfiguration())
    new, current = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"_{version}", "CURRENT"))
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(new, True)
    out.writeBytes(version)
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, current, options)


def current_version(spark: SparkSession, path: str) -> str | None:
    fs, pointer = _fs(spark, f"{path}/CURRENT")
    return spark.read.text(f"{path}/CURRENT").first()[0] if fs.exists(pointer) else None


def _folders(spark: SparkSession, path: str, version: str) -> dict[int, str]:
    rows = spark.read.schema("b int, folder string").json(f"{path}/versions/{version}").where("folder is not null").collect()
    return {r["b"]: r["folder"] for r in rows}


def current_folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The folder of each bucket in the version that CURRENT names; none if nothing was written yet."""
    version = current_version(spark, path)
    return _folders(spark, path, version) if version else {}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version; an error if there is none."""
    folders = [f"{path}/{x}" for x in current_folders(spark, path).values()]
    if not folders:
        raise FileNotFoundError(f"no index at {path}")
    return spark.read.parquet(*folders)


def open_index(spark: SparkSession, path: str, need_rows: bool = True) -> DataFrame:
    """The table, read only. A wrong schema or (if asked) an empty table is an error, never quietly another table."""
    df = read_documents(spark, path)
    if problems := schema_problems(df.schema, INDEXED):
        raise SchemaMismatchError("; ".join(problems))
    if need_rows and df.isEmpty():
        raise ValueError(f"the index at {path} is empty")
    return df


def health(spark: SparkSession, path: str) -> dict:
    """down: it can't be read; degraded: wrong schema or empty; ok. Never raises."""
    try:
        df = read_documents(spark, path)
    except Exception as e:  # noqa: BLE001
        return {"status": "down", "reasons": [type(e).__name__]}
    reasons = schema_problems(df.schema, INDEXED) or (["empty"] if df.isEmpty() else [])
    return {"status": "degraded" if reasons else "ok", "reasons": reasons}
