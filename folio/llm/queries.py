"""The queries of this subpackage, over the tables of a folder, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sha256_hex, table
from .decontaminate import benchmark_matches, is_contaminated
from .filteraudit import filter_audit
from .langid import held_out, identify, profiles
from .linededup import drop_repeated_lines
from .neardup import near_duplicates
from .prefixtrie import prefix_trie
from .quality import quality_rules
from .sentencepieces import encode_and_decode, load_model
from .substrings import repeated_passages
from .tokenfiles import token_files
from .toxicity import toxicity
from .urlfilter import filter_urls, thin_pages
from .warc import resolve_revisits


def piece_model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def word_model() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("matches.item_id"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        sha256_hex(F.array_join(items, ",")).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_and_decode(table(spark, sf_dir, "documents"), load_model(piece_model_path()))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = profiles(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return identify(docs, known).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as archive records: page p is captured in full at hour 8p, and asked for again 3 hours
    and 90 days later; every fourth page has another entity tag by then, every fifth no entity tag at all. Of every sixth
    the full capture is missing, so its revisits are answered by another page of the same URL or not at all."""
    def headers(name: str, *more: tuple[str, Column]) -> Column:
        pairs = [("date", F.date_format(name, "yyyy-MM-dd HH:mm:ss")), *more]
        return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))

    at = F.timestamp_seconds(F.col("page_id") * 8 * 3600)
    pages = pages.select("page_id", "url", at.alias("ts"), F.substring(F.sha2("html", 256), 1, 16).alias("tag"))
    full = headers("ts", ("content-type", F.lit("text/html")), ("etag", F.col("tag")))
    first = pages.where("page_id % 6 != 1").select((F.col("page_id") * 3).alias("record_id"), "url", "ts", F.lit("response").alias("kind"), full.alias("headers"))
    again = pages.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    later = (F.col("ts").cast("long") + F.when(F.col("n") == 1, 3 * 3600).otherwise(90 * 86400)).cast("timestamp")
    again = again.withColumn("ts", later)
    changed = F.when((F.col("n") == 2) & (F.col("page_id") % 4 == 0), F.lit("changed")).otherwise(F.concat(F.lit("W/"), F.col("tag")))
    fresh = F.when(F.col("page_id") % 5 == 0, headers("ts")).otherwise(headers("ts", ("etag", changed), ("content-type", F.lit("none"))))
    return first.union(again.select(F.col("page_id") * 3 + F.col("n"), "url", "ts", F.lit("revisit"), fresh))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(table(spark, sf_dir, "pages")))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return out.select("record_id", "canonical", F.coalesce("response_id", F.lit(-1)).alias("response_id"), "outcome", header("date").alias("date"), header("etag").alias("etag"), header("content-type").alias("content_type"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, thin_pages(pages))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), word_model())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP1 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keys AS (SELECT *, translate(trim(line, {WHITE_SQL}), {ABC}) AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last_doc FROM keys WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AS dropped FROM keys k LEFT JOIN common c ON k.key = c.key AND k.doc_id < c.last_doc)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WORDS4 = f"regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {WORDS4} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS4} AS w FROM benchmark),
sizes AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sizes)),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM sizes) WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, i, size FROM dw JOIN bw USING (size, words)),
per_doc AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN hit_words USING (doc_id)
"""

WORDS3 = f"regexp_extract_all(translate(coalesce(text, ''), {ABC}), '[^\\x20\\x09-\\x0D]+')"

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS3} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN low USING (doc_id)
"""


OP8 = """
WITH p AS (SELECT page_id, url, to_timestamp(page_id * 8 * 3600) AT TIME ZONE 'UTC' AS ts, substr(sha256(html), 1, 16) AS tag FROM pages),
rest AS (SELECT *, CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^[^:/?#]*://([^#]*)', 1) END AS r FROM p),
cut AS (SELECT *, lower(regexp_replace(regexp_extract(r, '^([^/?]*)', 1), '^.*@|:(80|443)?$', '')) AS h, regexp_extract(r, '^[^/?]*([^?]*)', 1) AS pa,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '\\?(.*)$', 1), '&'), lambda x: x <> '')), '&') AS q FROM rest),
c AS (SELECT page_id, ts, tag, CASE WHEN r IS NOT NULL THEN h || CASE WHEN pa = '' THEN '/' ELSE pa END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical FROM cut),
resp AS (SELECT page_id * 3 AS record_id, canonical, ts, tag FROM c WHERE page_id % 6 <> 1),
rev AS (SELECT page_id * 3 + n AS record_id, canonical, ts + CASE WHEN n = 1 THEN INTERVAL 3 HOUR ELSE INTERVAL 90 DAY END AS ts,
  CASE WHEN page_id % 5 = 0 THEN NULL WHEN n = 2 AND page_id % 4 = 0 THEN 'changed' ELSE tag END AS tag, n FROM c, (VALUES (1), (2)) v(n)),
best AS (SELECT v.record_id, v.canonical, v.ts, v.tag, max(struct_pack(ts := r.ts, id := r.record_id, tag := r.tag)) AS b
  FROM rev v LEFT JOIN resp r ON r.canonical = v.canonical AND (r.ts < v.ts OR r.ts = v.ts AND r.record_id < v.record_id) GROUP BY ALL),
judged AS (SELECT record_id, canonical, b.id AS response_id, ts, tag, CASE WHEN b.id IS NULL THEN 'no response' WHEN tag IS NULL THEN 'unchecked' WHEN tag = b.tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM best)
SELECT record_id, canonical, coalesce(response_id, -1) AS response_id, outcome, CASE WHEN outcome = 'resolved' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS date,
  CASE WHEN outcome = 'resolved' THEN 'W/' || tag END AS etag, CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type FROM judged
"""

OP10 = """
WITH r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) v(verdict, h, p)),
cut AS (SELECT page_id, html, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), ABC) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict FROM parts JOIN r
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed AS (SELECT DISTINCT host || path AS key FROM parts WHERE host || path <> '' AND len(regexp_extract_all(html, '<p[ >]')) < 2)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (page_id) LEFT JOIN listed ON host || path = key
""".replace("ABC", ABC)

CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, b:
  list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11 = """
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, CRC32 % 4 AS h FROM (SELECT DISTINCT c FROM own) x),
turns AS (SELECT ids.c, 0 AS own_turn, i, r, t FROM ids JOIN own ON own.c = ids.c - ids.c % 20 AND i <= h
  UNION ALL SELECT ids.c, 1, i, r, t FROM ids JOIN own ON own.c = ids.c AND i > h),
paths AS (SELECT c, list(md5(length(r) || ':' || r || t) ORDER BY own_turn, i) AS p, list(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) ORDER BY own_turn, i) AS w FROM turns GROUP BY c),
whole AS (SELECT ids.c, coalesce(p, []) AS p, coalesce(w, []) AS w FROM ids LEFT JOIN paths USING (c)),
steps AS (SELECT c, d, p[1:d] AS prefix, w[d] AS words, len(p) = d AS ends FROM (SELECT c, p, w, unnest(range(0, len(p) + 1)) AS d FROM whole) x),
nodes AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(words), 0) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM steps GROUP BY prefix, d),
kids AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own_values AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (prefix)),
sums AS (SELECT prefix[1:a] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own_values) x GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM own_values n JOIN sums s USING (prefix) LEFT JOIN nodes up ON n.d > 0 AND up.prefix = n.prefix[1:n.d - 1]
""".replace("CRC32", CRC32)

OP12 = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
low AS (SELECT text, min(doc_id) AS low FROM d GROUP BY text),
f AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > low, false) AS e FROM d JOIN low USING (text)),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
orders(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(x) WHERE NOT contains(filter_order, x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS before FROM orders, range(1, 6) r(step) WHERE length(filter_order) = 5),
judged AS (SELECT part, fails, list_filter(map_keys(fails), lambda k: fails[k]) AS failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM docs GROUP BY part, fails),
cells AS (SELECT part, filter_order, step, own, n, good, toxic, list_contains(failed, own) AS fails_own, list_has_any(failed, before) AS gone, len(failed) = 1 AS alone FROM judged, steps),
sums AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails_own), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails_own), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE gone AND fails_own), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails_own AND alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE NOT gone AND fails_own), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails_own), 0) AS toxic_lost FROM cells GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op3_minhash_near_dedup": OP3, "op4_benchmark_decontamination": OP4, "op8_warc_revisits": OP8, "op10_url_filters": OP10, "op11_prefix_trie": OP11, "op12_filter_audit": OP12}
