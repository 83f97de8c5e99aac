"""The trie of conversation prefixes against a plain one, and its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from stepframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, node string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [t[-1] for t in sorted(ts, key=lambda t: t[:-1])] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    least = {p: min(m) for p, m in members.items()}
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        tokens = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(m), len(children), len(leaves), tokens, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for c in r.sample(range(-3, 130), 90):
        for turn in range(r.choice([1, 1, 2, 3, 5, 9, 17])):
            out.append((c, r.choice([turn, turn, None]) if c >= 100 else turn, r.choice(["user", "a", None]), r.choice(["hi", "two  words", "", None, "x\ty z"]), "x", "x"))
    out += [(200 + i, t, "user", f"same {t}", "x", "x") for i in range(12) for t in range(6)]
    out += [(300, t % 5, "user", str(t % 3), "x", "x") for t in range(70)] + [(None, 1, "user", "no conversation", "x", "x"), *[(301, 1, None, None, "x", "x")] * 3]
    return out


def test_as_they_stand(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(prefix_trie.prefix_trie(df)) == plain(ordered(rows))


def test_small_chunks_and_buckets(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "BUCKETS", 2)
    some = [r for r in rows if r[0] is not None and r[0] >= 100]
    assert rows_of(prefix_trie.prefix_trie(spark.createDataFrame(some, SCHEMA))) == plain(ordered(some))


def test_query_and_its_sql(spark, rows, tmp_path):
    some = [r[:4] for r in rows if r[0] is None or r[0] >= 0]
    spark.createDataFrame(some, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain(rebuilt(ordered(some)))
    assert rows_of(prefix_trie.op11_prefix_trie(spark, str(tmp_path))) == want
    assert any(len(t) == 0 for t in rebuilt(ordered(some)).values())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.OP11_SQL})").fetchall(), key=str) == want


def test_names_are_dense(spark):
    df = spark.range(1000).selectExpr("id % 300 AS a", "id % 7 AS b")
    names = [r.name for r in prefix_trie.dense_names(df, ["a", "b"]).collect()]
    assert sorted(names) == list(range(df.distinct().count()))


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).collect() == []
    one = spark.createDataFrame([(7, None, None, None, None, None)], SCHEMA)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows_of(prefix_trie.prefix_trie(one)) == sorted([(7, 0, None, 1, 1, 1, 0, sha("")), (7, 1, 7, 1, 0, 1, 0, sha("7"))], key=str)


def test_a_node_where_very_many_end(spark):
    df = spark.range(25_000).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'hello there' AS text")
    got = {r.depth: r for r in prefix_trie.prefix_trie(df).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(25_000))).encode()).hexdigest()
    assert (got[0].n_convs, got[0].n_leaves, got[0].saved_tokens) == (25_000, 1, 2 * 24_999)
