"""The trie of conversation prefixes (operator 11).

Turns are dealt once, as digests, by families of conversations; equal conversations become one row before anything is
grouped. Tries of pointers are built inside applyInPandas, for buckets of first turns. A first turn that too many
different conversations share is dealt again by its next turn, and so on: the sizes of all deeper prefixes come from one
aggregation, so the number of jobs does not follow the depth. What lies above such a cut, the spine, is summed by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_rows_only, save

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a prefix's key: the digest of the key before it and of one more turn.
KEY = 16
#: Conversations of one text with the same id / ID_BLOCK are joined into one list of ids by one row.
ID_BLOCK = 256
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt_conversations(conversations: DataFrame, family_size: int = 20, most_shared: int = 4) -> DataFrame:
    """(conv_id, turns) of every conversation after its first h turns were replaced by those of conversation
    c - c % family_size; h = crc32(decimal c) % most_shared. A turn is (h1, h2, words): two 64-bit hashes of role and text,
    and the words of the text. Nothing longer than that is shuffled, and once: families stay together."""
    rows = read_rows_only(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(
        (F.col("conv_id") - F.col("conv_id") % family_size).alias("family"), "conv_id",
        F.struct(
            F.col("turn").isNotNull().alias("later"), F.coalesce("turn", F.lit(0)).alias("turn"), role.alias("role"),
            F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.regexp_count(text, F.lit(WORD)).alias("words"),
        ).alias("t"),
    )
    own = turns.repartition("family").groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = own.select("family", "conv_id", F.transform("t", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["words"].alias("words"))).alias("own"))
    # A family is dealt together already: neither the grouping nor the window moves a row again.
    head = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, most_shared - 1))).over(Window.partitionBy("family"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % most_shared).cast("int")
    head = F.slice(F.coalesce(head, F.array().cast(own.schema["own"].dataType)), F.lit(1), shared)
    return own.select("conv_id", F.concat(head, F.slice("own", shared + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and block of ids become one for each distinct conversation: the digests of all its
    prefixes, and the digest of its ids, taken block after block."""
    now, sums, ids, out = None, None, None, []

    def row() -> dict:
        keys, key = [], b""
        for t in sums["turns"]:
            key = hashlib.blake2b(key + t["h1"].to_bytes(8, "little", signed=True) + t["h2"].to_bytes(8, "little", signed=True), digest_size=KEY).digest()
            keys.append(key)
        return {"keys": b"".join(keys), "words": [t["words"] for t in sums["turns"]], "n": sums["n"], "low": sums["low"], "ends": ids.hexdigest()}

    schema = pa.schema([("keys", pa.binary()), ("words", pa.list_(pa.int32())), ("n", pa.int64()), ("low", pa.int64()), ("ends", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            if (r["p1"], r["p2"]) == now:
                sums["n"] += r["n"]
                ids.update(b"," + r["ids"].encode())
                continue
            if now is not None:
                out.append(row())
            now, sums, ids = (r["p1"], r["p2"]), r, hashlib.sha256(r["ids"].encode())
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        out.append(row())
    yield pa.RecordBatch.from_pylist(out, schema)


def distinct_conversations(rebuilt: DataFrame) -> DataFrame:
    """(keys, words, n, low, ends): a row for each distinct sequence of turns. keys: a digest of KEY bytes for each of its
    prefixes, one behind the other; words of each turn; n conversations, low their smallest id, ends the SHA-256 of their
    ids. Equal conversations are joined by blocks of ids first, so a hot one reaches its task as few rows, which pass
    through it one after the other."""
    block = F.floor(F.col("conv_id") / ID_BLOCK).alias("block")
    rows = rebuilt.select("conv_id", "turns", block, F.xxhash64("turns").alias("p1"), F.xxhash64(F.lit(1), "turns").alias("p2"))
    blocks = rows.groupBy("p1", "p2", "block").agg(F.first("turns").alias("turns"), F.count("*").alias("n"), F.min("conv_id").alias("low"), F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    blocks = blocks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "block")
    return blocks.select("p1", "p2", "turns", "n", "low", "ids").mapInArrow(_distinct, "keys binary, words array<int>, n long, low long, ends string")


def _key(depth: Column) -> Column:
    """Of the prefix of so many turns; the root's is empty."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.substring("keys", (depth - 1) * KEY + 1, F.lit(KEY)))


def _above(keys: Column, depth: Column) -> Column:
    """The keys of the prefixes of at most so many turns."""
    return F.substring(keys, F.lit(1), depth * KEY)


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of one bucket, from their tops at depth `cut` downwards. Children are dictionaries from the
    next prefix's key to a place in the lists. A node is made after its parent, so the lists from their end to their
    start are a postorder, without recursion."""
    parent, depth, n, low, words, ends, children, tops = [], [], [], [], [], [], [], {}
    above = []
    for keys, cut, own_words, copies, first, own_ends in zip(rows["keys"], rows["cut"], rows["words"], rows["n"], rows["low"], rows["ends"], strict=True):
        at, siblings = -1, tops
        for d in range(cut, len(own_words) + 1):
            key = keys[(d - 1) * KEY : d * KEY]
            found = siblings.get(key)
            if found is None:
                found = siblings[key] = len(n)
                parent.append(at)
                depth.append(d)
                n.append(0)
                low.append(first)
                words.append(int(own_words[d - 1]))
                ends.append(NO_IDS)
                children.append({})
                above.append(keys[: (d - 1) * KEY] if at < 0 else None)
            n[found] += copies
            low[found] = min(low[found], first)
            at, siblings = found, children[found]
        ends[at] = own_ends
    leaves, saved = [0] * len(n), [0] * len(n)
    for i in range(len(n) - 1, -1, -1):
        leaves[i] += not children[i]
        saved[i] += (n[i] - 1) * words[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    return pd.DataFrame({
        "conv_id": low, "depth": depth, "parent_conv_id": pd.array([low[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": n, "n_children": [len(c) for c in children],
        "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "above": above,
    })


def _buckets(df: DataFrame, turns_each: int) -> int:
    """Buckets for so many turns each; as many as shuffles have partitions at least."""
    turns = df.agg(F.sum(F.size("words"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns // turns_each)


def prefix_trie(conversations: DataFrame, most_paths: int = 200, turns_each: int = 20_000) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> the nodes of the trie of the rebuilt conversations (see
    rebuilt_conversations), a row each: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it.
    n_leaves counts the nodes without children in its subtree, itself included. saved_tokens sums, over its subtree,
    (members - 1) times the words of the node's last text: what a cache of prefixes saves. ends_sha256 digests the ids
    of the members that end there.

    Turns are ordered by turn, null first; ties by role, then by the hash of role and text, so repeated rows are turns of
    their own. Null roles and texts are empty. Rows without conv_id are left out. A conversation that has no turns after
    its first h, and whose family has none, is a member of the root only. An empty table has no nodes. Other columns are
    not read, so their names can't clash. A text is read once and whole; a conversation's digests (20 bytes a turn) are in
    one row, like a long text.

    A prefix that more than most_paths different conversations share is cut: its children are dealt as tries of their own.
    A task's tries hold about turns_each turns, or most_paths conversations. Nothing but three numbers comes to the driver.
    """
    paths = save(distinct_conversations(rebuilt_conversations(conversations)), "conversations")
    length = F.size("words")
    first = F.substring("keys", 1, KEY)
    common = save(paths.where(length > 0).groupBy(first.alias("first")).count().where(F.col("count") > most_paths).select("first"), "common-turns")
    cold = paths.join(common, first == common["first"], "left_anti").withColumn("cut", F.lit(1))
    parts, spine_rows = [cold], [paths.select("*", F.lit(0).alias("depth"))]
    if not common.isEmpty():
        hot = save(paths.join(common, first == common["first"], "left_semi"), "common-conversations")
        steps = hot.select(F.substring("keys", -KEY, KEY).alias("id"), "keys", F.explode(F.sequence(F.lit(1), length)).alias("depth"))
        steps = steps.select("id", "depth", _key(F.col("depth")).alias("key"))
        large = save(steps.groupBy("key").count().where(F.col("count") > most_paths).select("key"), "common-prefixes")
        cuts = steps.join(large, "key").groupBy("id").agg((F.max("depth") + 1).alias("cut"))
        hot = save(hot.join(cuts, F.substring("keys", -KEY, KEY) == cuts["id"]).drop("id"), "cut-conversations")
        parts.append(hot)
        spine_rows.append(hot.select(*paths.columns, F.explode(F.expr("sequence(1, cut - 1)")).alias("depth")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.where(length >= F.col("cut"))
    bucket = F.pmod(F.xxhash64(_key(F.col("cut"))), F.lit(_buckets(paths, turns_each)))
    tries = rows.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(lambda part: _tries(part), NODE + ", above binary")
    tries = save(tries, "tries")

    # The spine: the root, and every prefix that was cut.
    spine = spine_rows[0] if len(spine_rows) == 1 else spine_rows[0].unionByName(spine_rows[1])
    depth = F.col("depth")
    spine = (
        spine.select(_key(depth).alias("key"), "depth", _above(F.col("keys"), depth).alias("upto"), F.get("words", depth - 1).alias("last"), "n", "low", F.when(length == depth, F.col("ends")).alias("ends"))
        .groupBy("key").agg(F.first("depth").cast("long").alias("depth"), F.first("upto").alias("upto"), F.first("last").alias("last"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("ends").alias("ends"))
    )
    spine = save(spine, "spine")
    tops = tries.where("above is not null").select("above", "conv_id", "n_leaves", "saved_tokens")
    parent = lambda upto: F.when(F.octet_length(upto) <= KEY, F.lit(b"")).otherwise(F.substring(upto, -2 * KEY, KEY))
    direct = tops.select(_parent_key("above").alias("key")).union(spine.where("depth > 0").select(parent("upto").alias("key")))
    direct = direct.groupBy("key").agg(F.count("*").alias("n_children"))
    spine = save(spine.join(direct, "key", "left").na.fill(0, ["n_children"]), "spine-children")
    own = spine.select(F.col("upto").alias("above"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.coalesce((F.col("n") - 1) * F.col("last"), F.lit(0)).alias("saved_tokens"))
    added = tops.select("above", "n_leaves", "saved_tokens").union(own)
    added = added.groupBy("above").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    added = added.select(F.col("above").alias("keys"), "n_leaves", "saved_tokens", F.explode(F.sequence(F.lit(0), (F.octet_length("above") / KEY).cast("int"))).alias("depth"))
    added = added.groupBy(_key(F.col("depth")).alias("key")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parents = spine.select(F.col("key").alias("parent_key"), F.col("low").alias("parent_conv_id"))
    spine = spine.join(added, "key").withColumn("parent_key", F.when(F.col("depth") > 0, parent("upto"))).join(parents, "parent_key", "left")
    spine = spine.select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))
    columns = spine.columns
    below = tries.where("above is not null and octet_length(above) > 0").drop("parent_conv_id").withColumn("parent_key", _parent_key("above"))
    root = parents.where(F.octet_length("parent_key") == 0).first()
    return (
        spine.union(tries.where("above is null").select(columns))
        .union(tries.where("octet_length(above) = 0").withColumn("parent_conv_id", F.lit(root.parent_conv_id if root else None).cast("long")).select(columns))
        .union(below.join(parents, "parent_key").select(columns))
    )


def _parent_key(above: str) -> Column:
    return F.when(F.octet_length(above) == 0, F.lit(b"")).otherwise(F.substring(above, -KEY, KEY))
