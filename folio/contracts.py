"""Row contracts as Spark schemas, and checks that name every difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = (
    "chunk_id string, doc_id string, text string, section string, page int, company string, ticker string, fiscal_year int, "
    "content_type string, doc_type string, company_name string"
)
INDEXED = (
    "chunk_id string, doc_id string, text string, section string, section_title string, page int, company string, ticker string, "
    "fiscal_year int, chunk_type string, doc_type string, company_name string, embedding array<float>"
)
HIT = "chunk_id string, text string, score double, section string, page int, company string, fiscal_year int"
INVENTORY = "s3_key string, company string, exchange string, ticker string, fiscal_year int, size_mb double, has_hash_suffix boolean"
REPLY = "status string, answer string, sources array<struct<doc_id:string,excerpt:string>>"
QUESTION = (
    "id string, question string, ticker string, fiscal_year int, category string, difficulty string, "
    "expected_sections array<string>, relevant_chunk_ids array<string>"
)
SNAPSHOT = "ticker_10k string, currency string, fetched_at string, fiscal_year_end map<string,string>, figures map<string,map<string,double>>"


class SchemaMismatchError(ValueError):
    pass


def schema_problems(actual: StructType, expected: StructType | str) -> list[str]:
    """A line for each expected field (a schema or its DDL) that is missing or has another type; further fields don't
    matter."""
    expected = StructType.fromDDL(expected) if isinstance(expected, str) else expected
    have = {f.name: f.dataType.simpleString() for f in actual}
    problems = []
    for f in expected:
        want = f.dataType.simpleString()
        if f.name not in have:
            problems.append(f"{f.name}: missing, expected {want}")
        elif have[f.name] != want:
            problems.append(f"{f.name}: {have[f.name]}, expected {want}")
    return problems


def check_schema(df: DataFrame, expected: StructType | str) -> DataFrame:
    if problems := schema_problems(df.schema, expected):
        raise SchemaMismatchError("; ".join(problems))
    return df


def schema_diff(spark: SparkSession, actual: StructType, expected: StructType | str) -> DataFrame:
    """The differences as rows (field, problem)."""
    rows = [tuple(p.split(": ", 1)) for p in schema_problems(actual, expected)]
    return spark.createDataFrame(rows, "field string, problem string")


def valid_and_rejected(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """rules: reason -> predicate that a valid row fulfils (null counts as not). Rows that break none, and the others with
    reject_reason, the first rule broken."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = df.withColumn("reject_reason", reason)
    return marked.where("reject_reason is null").drop("reject_reason"), marked.where("reject_reason is not null")
