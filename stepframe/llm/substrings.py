"""Substring dedup by prefix-partitioned suffix trees over words (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, key_of_id, saved, whole_row

GRAM = 8
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
#: Bits for each prefix in the filters sent to executors, and the least and most bits of a filter (128 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Words of the suffix groups a task takes at a time.
BATCH_WORDS = 1_500_000


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 0)
        return h


_HASHES = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    power = 1
    for i in range(n):
        out += h[i : i + len(out)] * np.uint64(power)
        power = power * _BASE % (1 << 64)
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def prefix_runs(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, first, last): runs of window starts with the same prefix.

    A window's prefix is the least hash of its word 8-grams, so equal windows have equal prefixes wherever they lie, and
    neighbouring windows mostly share theirs: a run's suffixes travel together as one stretch of words.
    """
    g = sequence_hashes(h, GRAM)
    span, need = 1, window - GRAM + 1
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    while span * 2 <= need:
        g = np.minimum(g[:-span], g[span:])
        span *= 2
    if span < need:
        g = np.minimum(g[: len(g) - (need - span)], g[need - span :])
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], first, np.concatenate([first[1:], [len(g)]]) - 1


def _texts(batches, window: int):
    for batch in batches:
        for key, th, text in zip(batch.column("key").to_pylist(), batch.column("th").to_pylist(), batch.column("text").to_pylist()):
            words = text.encode("utf-8", "replace").split()
            if len(words) >= window:
                h = word_hashes(words)
                yield key, th, h, *prefix_runs(h, window)


def _emit(rows: list[tuple], fields: list[tuple]):
    cols = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _prefixes(window: int):
    def run(batches):
        out: list = []
        n = 0

        def flush():
            p, k, c = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(c)], names=["prefix", "key", "runs"])

        for key, _, _, prefix, _, _ in _texts(batches, window):
            own, counts = np.unique(_signed(prefix), return_counts=True)
            out.append((own, np.full(len(own), key, np.int64), counts))
            n += len(own)
            if n > 200_000:
                yield flush()
                out, n = [], 0
        if out:
            yield flush()

    return run


def _hit(bits: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    at = prefix & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _segments(window: int, repeated, large):
    fields = [("prefix", pa.int64()), ("key", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.int64()))]

    def run(batches):
        out, n = [], 0
        for key, th, h, prefix, first, last in _texts(batches, window):
            take = np.flatnonzero(_hit(repeated.value, prefix) & ~_hit(large.value, prefix))
            for i in take:
                out.append((int(_signed(prefix[i : i + 1])[0]), key, th, int(first[i]), _signed(h[first[i] : last[i] + window])))
                n += len(out[-1][-1])
            if n > 200_000:
                yield _emit(out, fields)
                out, n = [], 0
        yield _emit(out, fields)

    return run


def _long_prefixes(window: int, large):
    def run(batches):
        out: list = []
        n = 0

        def flush():
            w, k, t, p = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(k), pa.array(t), pa.array(p)], names=["whole", "key", "th", "pos"])

        for key, th, h, prefix, first, last in _texts(batches, window):
            for i in np.flatnonzero(_hit(large.value, prefix)):
                whole = _signed(sequence_hashes(h[first[i] : last[i] + window], window))
                out.append((whole, np.full(len(whole), key, np.int64), np.full(len(whole), th, np.int64), np.arange(first[i], last[i] + 1, dtype=np.int32)))
                n += len(whole)
            if n > 200_000:
                yield flush()
                out, n = [], 0
        if out:
            yield flush()

    return run


def subtree_classes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes (by their starts in ``words``) lie under the same node of string depth ``depth``.

    Suffixes are ranked by prefix doubling: the rank by 2n words comes from the ranks by n at two positions. Suffixes of
    equal rank at ``depth`` are the leaves under one internal node of the suffix tree that is at least so deep.
    """
    _, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int64)
    n = 1
    while n < depth:
        step = min(n, depth - n)
        pair = rank[: len(rank) - step] * np.int64(len(words) + 1) + rank[step:]
        n += step
        if n == depth:
            return np.unique(pair[starts], return_inverse=True)[1]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return rank[starts]


def ranges_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive numbers: first and last of each."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])]


_RANGES = [("key", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]


def _trees(window: int):
    """Takes whole prefix groups, a bounded number of words at a time, and gives the windows of later documents."""

    def solve(stretches: list[np.ndarray], owners: list[tuple]):
        words = np.concatenate(stretches)
        length = np.array([len(x) for x in stretches])
        n = length - window + 1
        begin, ends = np.cumsum(length) - length, np.cumsum(n)
        starts = np.repeat(begin - (ends - n), n) + np.arange(ends[-1])
        node = subtree_classes(words, starts, window)
        key = np.array([o[0] for o in owners], np.int64)
        which = np.array([o[3] for o in owners])
        least = np.full(len(stretches), np.iinfo(np.int64).max)
        np.minimum.at(least, which, key)
        under = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(under, node, np.repeat(least, n))
        earlier = under[node]
        lowest = np.minimum.reduceat(earlier, ends - n)
        out = []
        for (k, th, first, i), low in zip(owners, lowest[which].tolist()):
            if k > low:
                later = np.flatnonzero(earlier[ends[i] - n[i] : ends[i]] < k) + first
                out += [(k, th, int(a), int(b)) for a, b in zip(*ranges_of(later))]
        return _emit(out, _RANGES)

    def run(batches):
        stretches, owners, size, group, seen = [], [], 0, None, {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("prefix", "key", "th", "first")]
            lists = batch.column("words")
            flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (prefix, key, th, first) in enumerate(zip(*cols)):
                if prefix != group:
                    # Equal stretches of a group are kept once, with all their owners.
                    group, seen = prefix, {}
                    if size > BATCH_WORDS or len(owners) > BATCH_WORDS // 10:
                        yield solve(stretches, owners)
                        stretches, owners, size = [], [], 0
                words = flat[bounds[i] : bounds[i + 1]]
                at = seen.setdefault(words.tobytes(), len(stretches))
                if at == len(stretches):
                    stretches.append(words.copy())
                    size += len(words)
                owners.append((key, th, first, at))
        if owners:
            yield solve(stretches, owners)

    return run


def _bitmap(prefixes: DataFrame) -> np.ndarray:
    """A bit for each prefix, at its low bits: OR-ed in 64-bit words before the shuffle. Its size follows from the number of
    prefixes and is bounded; a fuller filter only sends more stretches that meet no partner."""
    size = LEAST_BITS
    wanted = min(prefixes.count() * BITS_EACH, MOST_BITS)
    while size < wanted:
        size *= 2
    at = F.col("prefix").bitwiseAND(F.lit(size - 1).cast("long"))
    rows = prefixes.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(prefix & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(size // 64, np.int64)
    table = rows.toArrow()
    bits[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return bits.view(np.uint8)


def repeated_windows(docs: DataFrame, window: int = 50, large_group: int = 2_000) -> DataFrame:
    """(key, th, ranges): window starts whose words also start a window in a document with a smaller doc_id.

    1. Every window has a prefix (see ``prefix_runs``). Counts of prefixes by document leave those in two documents.
    2. Suffixes of these go, as stretches of words, to the group of their prefix; groups are read in batches of bounded
       size, and the nodes of depth ``window`` of each batch's suffix tree give the repeats.
    3. The suffixes of a prefix with over ``large_group`` stretches, too many for a task's memory, take a longer prefix:
       the whole window. Such a group needs no tree: its node is the prefix. Least doc_ids are combined before the
       shuffle and joined back.
    Which prefixes are repeated or large reaches the tasks as two bit maps of bounded size; a chance hit only sends a
    stretch to a group in which it finds no partner, and both ways are exact for any group.
    """
    spark = docs.sparkSession
    rows = docs.select(key_of_id().alias("key"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_prefixes(window), "prefix long, key long, runs long").groupBy("prefix").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("runs").alias("runs")).where("a < b").select("prefix", "runs")
    counted = saved(counted, "prefixes")
    repeated = spark.sparkContext.broadcast(_bitmap(counted))
    large = spark.sparkContext.broadcast(_bitmap(counted.where(F.col("runs") > large_group)))
    segments = rows.mapInArrow(_segments(window, repeated, large), "prefix long, key long, th long, first int, words array<long>")
    small = segments.repartition("prefix").sortWithinPartitions("prefix", "key").mapInArrow(_trees(window), "key long, th long, first int, last int")
    if counted.where(F.col("runs") > large_group).isEmpty():
        return small.groupBy("key", "th").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    whole = saved(rows.mapInArrow(_long_prefixes(window, large), "whole long, key long, th long, pos int"), "windows")
    least = whole.groupBy("whole").agg(F.min("key").alias("least"))
    hot = whole.join(least, "whole").where("key > least").select("key", "th", F.col("pos").alias("first"), F.col("pos").alias("last"))
    return small.union(hot).groupBy("key", "th").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))


def kept_words(n: int, ranges: list[tuple[int, int]], window: int) -> np.ndarray:
    """A mask of words that no range of window starts covers."""
    change = np.zeros(n + 1, np.int64)
    for a, b in ranges:
        change[a] += 1
        change[b + window] -= 1
    return np.cumsum(change[:-1]) == 0


def remove_repeats(docs: DataFrame, window: int = 50, large_group: int = 2_000) -> DataFrame:
    """Adds ``n_words``, ``n_removed`` (long) and ``kept`` (string: the remaining words, joined by a space) to each row.

    A word goes if a window that covers it also starts in a document with a smaller doc_id; all windows are judged on
    the input. Repeats within one document, and rows that repeat a doc_id, don't count. A null doc_id counts as the
    least; null texts and texts under ``window`` words lose nothing. Columns of these names are replaced; others pass
    through; an empty table gives no rows. Word sequences are compared by 64-bit hashes of their words. Apart from
    counted prefixes and repeated stretches, texts are shuffled once, to meet their ranges.
    """
    from pyspark.sql import types as T

    docs = docs.drop("n_words", "n_removed", "kept")
    names = docs.columns
    found = repeated_windows(docs, window, large_group)
    rows = docs.select(whole_row(docs), key_of_id().alias("key"), F.xxhash64("text").alias("th"))
    rows = rows.join(found, ["key", "th"], "left").select("row.*", F.col("ranges").alias("ranges" if "ranges" not in names else "_".join(["ranges", *names])))

    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column(len(names)).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                mask = kept_words(len(words), [(r["first"], r["last"]) for r in ranges or []], window)
                total.append(len(words))
                gone.append(int(len(words) - mask.sum()))
                kept.append(b" ".join(words if not gone[-1] else [w for w, m in zip(words, mask.tolist()) if m]).decode())
            own = batch.columns[: len(names)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(remove_repeats(documents(spark, sf_dir).select("doc_id", "text")))


# Windows as lists of words; for each document the places that a window of an earlier document covers.
OP10_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT doc_id, i AS s, array_to_string(words[i : i + 49], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
hit AS (SELECT a.doc_id, a.s FROM win a JOIN (SELECT k, min(doc_id) AS least FROM win GROUP BY k) b USING (k) WHERE a.doc_id > b.least),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM hit),
word AS (SELECT doc_id, p, words[p] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
