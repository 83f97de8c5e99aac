"""Trie of conversation prefixes by prefix doubling (operator 11).

Equal turns get equal dense names. Names of two neighbouring blocks of 2^k turns make the name of a block of 2^(k+1); only
blocks that begin at a multiple of their length are named, so the rounds halve. The prefix of d turns is put together
from blocks by the binary digits of d: it is the prefix without the lowest digit and one block after it, and all prefixes
of one lowest digit are named in one round. Both take a number of rounds that grows with the logarithm of the longest
conversation, each a grouping and an equi-join; then rows of equal prefix name are a node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, saved

#: Parts in which names are counted; their sizes are all that meets in one task.
BUCKETS = 4096
#: Turns of one conversation that are summed in one group.
CHUNK = 4096
ROOT = -1
WORDS = r"[^\x20\x09-\x0D]+"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, unit, n_words): turns in order of ``turn``, null first, from position 0; ``unit`` is a digest of role and text.

    Ties of ``turn`` follow role, then the digest, so equal rows are interchangeable. Null roles and texts are empty; rows of null
    conv_id belong to no conversation and are left out. A long conversation is ordered in several tasks: ranges of
    all turns are counted, and a range's first position is what the ranges before it hold.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("unit"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_words"))
    order = ["turn", "role", "unit"]
    ranged = saved(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    starts = sizes.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("start"))
    placed = ranged.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)))
    out = saved(placed.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("at") - 1).alias("pos"), "unit", "n_words"), "turns")
    discard(ranged)
    return out


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, length) of conversations that have turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def branched(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt as branches of others, as (turns, lengths).

    Conversation c takes the first h turns of conversation c - c % ``every`` (all if fewer, none if absent) in place of
    its own first h; h is crc32 of its decimal id modulo ``most``. Conversations left without turns have length 0.
    """
    convs = lengths(turns).select("conv_id", F.col("length").alias("n"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = saved(convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "convs")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "unit", "n_words")
    heads = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "unit", "n_words")
    taken = convs.where("taken > 0").select("conv_id", "base", "taken").join(heads, "base").where("pos < taken").select("conv_id", "pos", "unit", "n_words")
    made = saved(own.unionByName(taken), "turns")
    out = saved(convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    discard(convs)
    return made, out


def dense_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name): distinct keys numbered from 0 without gaps, in ``BUCKETS`` parts by hash that are ranked apart."""
    distinct = rows.select(*keys).distinct().withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    sizes = distinct.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    ranked = distinct.withColumn("at", F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)))
    return ranked.join(F.broadcast(starts), "bucket").select(*keys, (F.col("start") + F.col("at") - 1).alias("name"))


def _blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Level k: (conv_id, j, name) of the blocks of 2^k turns that begin at turn j * 2^k."""
    out = [saved(turns.join(dense_names(turns, ["unit"]), "unit").select("conv_id", F.col("pos").alias("j"), "name"), "blocks")]
    while 2 ** len(out) <= longest:
        half = F.shiftright("j", 1)
        side = [F.max(F.when(F.col("j") % 2 == i, F.col("name"))).alias(n) for i, n in enumerate("ab")]
        pairs = out[-1].groupBy("conv_id", half.alias("j")).agg(*side).where("b is not null")
        out.append(saved(pairs.join(dense_names(pairs, ["a", "b"]), ["a", "b"]).select("conv_id", "j", "name"), "blocks"))
    return out


def _prefixes(blocks: list[DataFrame]) -> list[DataFrame]:
    """Level k: (conv_id, depth, node) of the prefixes whose depth has 2^k as its lowest binary digit; a node is a name and its level."""
    out: list[DataFrame] = []
    for k in reversed(range(len(blocks))):
        last = blocks[k].where("j % 2 = 0").select("conv_id", F.shiftleft("j", k).alias("before"), F.shiftleft(F.col("j") + 1, k).alias("depth"), F.col("name").alias("b"))
        pairs = last.where("before = 0").withColumn("a", F.lit(ROOT).cast("long"))
        if out:
            known = _union(out).select("conv_id", F.col("depth").alias("before"), F.col("node").alias("a"))
            pairs = pairs.unionByName(last.where("before > 0").join(known, ["conv_id", "before"]))
        made = pairs.join(dense_names(pairs, ["a", "b"]), ["a", "b"]).select("conv_id", "depth", (F.shiftleft("name", 6) + k).alias("node"))
        out.append(saved(made, "prefixes"))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    spark = parts[0].sparkSession
    return spark.read.schema(parts[0].schema).parquet(*[p.scratch_path for p in parts])


def _ids_in_order(batches):
    """Stretches of ids of one node, from rows in order of (node, conv_id): (node, first, ids)."""
    for batch in batches:
        node, conv = (np.asarray(batch.column(i)) for i in range(2))
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)] if len(node) else [0]
        text = list(map(str, conv.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array(node[cuts[:-1]], pa.int64()), pa.array(conv[cuts[:-1]], pa.int64()), pa.array([",".join(text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.string())], names=["node", "first", "ids"])


def _hashes(batches):
    """SHA-256 of each node's stretches, joined by commas, as they come in order of (node, first)."""
    node, state = None, None
    for batch in batches:
        nodes, shas = [], []
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if state:
                    nodes.append(node)
                    shas.append(state.hexdigest())
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(shas, pa.string())], names=["node", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end in each node. Ids are joined in ranges, so of a node where very many end
    only few long stretches meet; its hash, which has to go through them in order, keeps none of them."""
    ranges = members.where("ended").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    stretches = ranges.mapInArrow(_ids_in_order, "node long, first long, ids string")
    return stretches.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashes, "node long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations: turns (conv_id, pos, unit, n_words) and convs (conv_id, length), also of length 0.

    A row for each distinct sequence of first d turns: conv_id (least member), depth, parent_conv_id (the parent's
    conv_id; null at the root), n_convs, n_children, n_leaves (childless nodes below or at it), saved_tokens (over
    those nodes, words of the last turn times members but one), ends_sha256 (of the members that end there).

    Sums over subtrees take no rounds: each node belongs to its least member, whose nodes are then the last ones of its
    path; so a subtree is what its members own from that depth on. No conversations give no nodes. The result is written; all tables on
    the way are removed.
    """
    longest = convs.agg(F.max("length")).first()[0]
    blocks = _blocks(turns, longest or 0)
    prefixes = _prefixes(blocks)
    at = ["conv_id", "depth"]
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("node"))
    members = _union(prefixes).unionByName(root)
    ends = convs.select("conv_id", F.col("length").alias("depth"), F.lit(True).alias("ended"))
    words = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "n_words")
    before = members.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    members = saved(members.join(before, at, "left").join(words, at, "left").join(ends, at, "left").select(*at, "node", "parent", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("ended", F.lit(False)).alias("ended")), "members")
    nodes = members.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("n_words").alias("n_words"), F.count_if("ended").alias("n_ends"))
    nodes = saved(nodes, "nodes")
    owned = nodes.select(*at, ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"))
    paths = members.select(*at, "node").join(owned, at, "left").select(*at, "node", F.floor(F.col("depth") / CHUNK).alias("chunk"), F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    chunk = Window.partitionBy("conv_id").orderBy(F.desc("chunk"))
    later = paths.groupBy("conv_id", "chunk").agg(F.sum("saved").alias("saved_later"), F.sum("leaf").alias("leaf_later"))
    later = later.select("conv_id", "chunk", *[(F.sum(c).over(chunk) - F.col(c)).alias(c) for c in ("saved_later", "leaf_later")])
    down = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    paths = paths.select("conv_id", "chunk", "node", *[F.sum(c).over(down).alias(c) for c in ("saved", "leaf")]).join(later, ["conv_id", "chunk"])
    sums = paths.groupBy("node").agg(F.sum(F.col("saved") + F.col("saved_later")).alias("saved_tokens"), F.sum(F.col("leaf") + F.col("leaf_later")).alias("n_leaves"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(children, "node", "left").join(_ends(members), "node", "left").join(above, "parent", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out = saved(out.select(*at, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")), "trie")
    for table in (*blocks, *prefixes, members, nodes):
        discard(table)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they stand (conv_id, turn, role, text; other columns are not used): see ``numbered`` for
    nulls and ties, ``trie`` for the rows."""
    turns = numbered(conversations)
    out = trie(turns, lengths(turns))
    discard(turns)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    made, convs = branched(turns)
    out = trie(made, convs)
    for table in (turns, made, convs):
        discard(table)
    return out


OP11_SQL = """WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
h AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), CAST(4294967295 AS BIGINT)) % 4 AS h FROM n),
k AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS taken FROM h LEFT JOIN n b ON b.conv_id = h.base),
c AS (SELECT conv_id, taken + greatest(n - h, 0) AS length FROM k),
r AS (SELECT conv_id, pos - h + taken AS pos, role, text FROM t JOIN k USING (conv_id) WHERE pos >= h UNION ALL SELECT k.conv_id, t.pos, t.role, t.text FROM k JOIN t ON t.conv_id = k.base AND t.pos < k.taken),
m AS (SELECT conv_id, pos + 1 AS depth, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS node, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_words FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
g AS (SELECT node, min(conv_id) AS conv_id, max(depth) AS depth, count(*) AS n_convs, max(n_words) AS n_words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length) AS ends, count(*) FILTER (depth = length) AS n_ends FROM m JOIN c USING (conv_id) GROUP BY 1),
p AS (SELECT g.node, up.node AS parent FROM g JOIN m up ON up.conv_id = g.conv_id AND up.depth = g.depth - 1),
s AS (SELECT a.node, CAST(sum((g.n_convs - 1) * g.n_words) AS BIGINT) AS saved_tokens, count(*) FILTER (g.n_ends = g.n_convs) AS n_leaves FROM g JOIN m a ON a.conv_id = g.conv_id AND a.depth <= g.depth GROUP BY 1)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, g.n_convs, (SELECT count(*) FROM p x WHERE x.parent = g.node) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256 FROM g JOIN s USING (node) LEFT JOIN p USING (node) LEFT JOIN g q ON q.node = p.parent"""
