"""Not-modified revisits of a web archive, resolved by an as-of join (operator 8).

A revisit record says that the page had not changed; its content is that of the latest earlier full response for the same
canonical URL. All captures are dealt to parts by ranges of (URL, time, id), so one URL's captures fill as many parts as
they need. Inside a part a window carries the latest response, with its headers, to the revisits; from earlier parts only
each part's last response of a URL is carried on, in a window over one row a part. No record is joined back by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_rows_only, save

#: Headers of a not-modified answer that replace the stored ones; all others stay as they were stored.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age")


def canonical_url(url: Column) -> Column:
    """Host without default port and path and sorted query, as host/path?query: scheme, user, fragment and the case of
    the host don't count, an empty path is /. Null, or without ://, null."""
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://([^#]*)", 1)
    place = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@|:(80|443)?$", ""))
    path = F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    parts = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    whole = F.concat(place, F.when(path == "", "/").otherwise(path), F.when(parts == "", "").otherwise(F.concat(F.lit("?"), parts)))
    return F.when(url.contains("://"), whole)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers (names in lower case), replaced or joined by the permitted ones of the fresh answer."""
    none = F.create_map().cast("map<string,string>")
    fresh = F.map_filter(F.coalesce(fresh, none), lambda k, _: k.isin(*PERMITTED))
    stored = F.map_filter(F.coalesce(stored, none), lambda k, _: ~F.array_contains(F.map_keys(fresh), k))
    return F.map_concat(stored, fresh)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records(record_id long, url, ts timestamp, kind 'response' or 'revisit', headers map of lower-case names) ->
    for each revisit (record_id, canonical, ts, response_id, outcome, headers).

    The response is the latest before the revisit by (ts, record_id). Its validators are checked: entity tags where both
    have one (weak ones compare by what they name), else Last-Modified where both have it. outcome: `resolved`, with the
    merged headers; `mismatch` where a validator differs; `unchecked` where they share none, taken for unresolved;
    `no response`. All but the first have null headers; only the first and second name the response, as does unchecked.
    Revisits without url, ts or record_id have no response, and take no part in the shuffles. Other kinds and null kinds
    are left out. Repeated rows are answered alike. record_id is expected to be unique among responses; of equal ones at
    the same time any may give the headers. Long urls are compared whole; an empty table gives no rows. Further columns
    are not read, so their names can't clash.
    """
    columns = {c: c for c in ("record_id", "url", "ts", "kind", "headers")}
    rows = read_rows_only(records, **columns).where("kind in ('response', 'revisit')").withColumn("canonical", canonical_url(F.col("url")))
    rows = rows.withColumns({"ts": F.col("ts").cast("timestamp"), "asks": F.col("kind") == "revisit"})
    placed = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    rows = rows.select("canonical", "ts", "record_id", "asks", "headers")
    dealt = rows.where(placed).repartitionByRange("canonical", "ts", "record_id", "asks").withColumn("part", F.spark_partition_id())
    dealt = save(dealt, "captures")  # a part is what it was when it was written, whatever is computed again
    response = F.when(~F.col("asks"), F.struct("record_id", "headers"))
    inside = Window.partitionBy("canonical", "part").orderBy("ts", "record_id", "asks").rowsBetween(Window.unboundedPreceding, -1)
    asked = dealt.withColumn("found", F.last(response, ignorenulls=True).over(inside)).where("asks")
    lasts = dealt.where("not asks").groupBy("canonical", "part").agg(F.max_by(F.struct("record_id", "headers"), F.struct("ts", "record_id")).alias("last"))
    firsts = dealt.groupBy("canonical", "part").agg(F.max("asks").alias("asks")).join(lasts, ["canonical", "part"], "left")
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("asks and carried is not null").select("canonical", "part", "carried")
    joined = asked.join(carried, ["canonical", "part"], "left").withColumn("answer", F.coalesce("found", "carried"))
    columns = ["record_id", "canonical", "ts", "headers"]
    alone = rows.where(F.col("asks") & ~placed).select(*columns, F.lit(None).cast(dict(joined.dtypes)["answer"]).alias("answer"))
    out = joined.select(*columns, "answer").union(alone).select(*columns, F.col("answer.record_id").alias("response_id"), F.col("answer.headers").alias("stored"))

    def tag(headers: str) -> Column:
        return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), "^W/", "")

    def modified(headers: str) -> Column:
        return F.try_element_at(headers, F.lit("last-modified"))

    fresh, old = F.col("headers"), F.col("stored")
    same = F.coalesce(tag("headers") == tag("stored"), modified("headers") == modified("stored"))
    outcome = F.when(F.col("response_id").isNull(), "no response").when(same, "resolved").when(~same, "mismatch").otherwise("unchecked")
    out = out.withColumn("outcome", outcome)
    return out.select("record_id", "canonical", "ts", "response_id", "outcome", F.when(F.col("outcome") == "resolved", merged_headers(old, fresh)).alias("headers"))
