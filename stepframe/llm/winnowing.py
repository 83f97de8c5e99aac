"""Document fingerprints by winnowing (operator 4)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, key_of_id

_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the rolling hash's base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int):
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 4096)
            self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
        return self.up, self.down


_POWERS = _Powers()


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 32-bit hash of each k code points: a polynomial rolling hash modulo 2^64, then mixed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    k = min(k, len(codes))
    up, down = _POWERS.get(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(codes) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(32)


def winnow(text: str, k: int = 24, w: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the least hash of each window of w k-grams, the rightmost of equal ones.

    Any passage of w+k-1 code points that two texts share puts a common hash into both. A text with fewer than w k-grams
    has one window; one shorter than k has one gram, the whole text; the empty text has none.
    """
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = gram_hashes(text, k)
    # The low half orders equal hashes from right to left.
    key = (h << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    w = min(w, len(key))
    span = 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    chosen = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return chosen >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two fingerprints' distinct hashes (Jaccard); two empty ones are alike, an empty and another not."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """The last third of code points replaced by the first as many of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def hexed(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = 24, w: int = 64) -> DataFrame:
    """Adds ``hashes`` (array of long) and ``positions`` (array of int) by winnowing; row by row, no shuffle.

    Null texts are empty; existing columns of these names are replaced; other columns pass through.
    """
    from pyspark.sql import types as T

    docs = docs.drop("hashes", "positions")
    names = docs.columns

    def run(batches):
        for batch in batches:
            both = [winnow(t or "", k, w) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([h.astype(np.int64) for h, _ in both], pa.list_(pa.int64())), pa.array([p.astype(np.int32) for _, p in both], pa.list_(pa.int32()))], names=[*names, "hashes", "positions"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def _bucket(key, bounds: list[int]):
    """Number of bounds below the key, by two levels of search."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    group = F.size(F.filter(tops, lambda b: b < key))
    rest = F.coalesce(F.size(F.filter(F.get(inner, group), lambda b: b < key)), F.lit(0))
    return (group * step + F.when(group < len(groups), rest).otherwise(0)).cast("int")


#: Bytes of text of a partition, about, and the most partitions that are asked for.
PART_BYTES, MOST_PARTS = 64 << 20, 20_000


def with_following(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deals rows so that each partition is a run in the order of descending doc_id, text hash and text that ends with the row after its
    last one.

    Columns: ``key`` (doc_id, null as least), ``doc_id``, ``text``, ``bucket``, ``ghost`` (the extra row). One shuffle of
    texts by ranges of ids, as many as the bytes of all texts ask for; the ranges come from quantiles of the ids. An id that several
    quantiles fall on, as it has many rows, is split into as many ranges of text hashes. The extra row is the first of the
    next range, so the broadcast that marks them has a row for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(key_of_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if partitions is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        partitions = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), MOST_PARTS)
    n = max(1, partitions)
    marks = (rows.agg(F.percentile_approx("key", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n))).first()[0] if n > 1 else None) or []
    bounds = sorted(set(marks))
    # In the order of the run: for each range from the last, first the parts of its largest id, if that is split, then its other ids.
    times = [*[t if (t := marks.count(b)) > 1 else 0 for b in bounds], 0]
    before, total = [0] * len(times), 0
    for b in reversed(range(len(times))):
        before[b] = total
        total += times[b] + 1
    below = F.least(_bucket(F.col("key"), bounds), F.lit(len(bounds)))
    own = F.get(F.lit(times), below)
    split = (own > 0) & (F.col("key") == F.get(F.lit([*bounds, 0]).cast("array<bigint>"), below))
    part = F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * own).cast("int")
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("bucket", F.get(F.lit(before), below) + F.when(split, F.least(part, own - 1)).otherwise(own)).withColumn("nth", F.bitwise_not("th"))
    tops = sorted((r.bucket, *r.top) for r in rows.groupBy("bucket").agg(F.max(F.struct("key", "nth")).alias("top")).collect())
    above = [(*tops[(i + 1) % len(tops)][1:], t[0]) for i, t in enumerate(tops)]
    ghosts = F.broadcast(spark.createDataFrame(above, "key long, nth long, to int"))
    here = F.struct(F.col("bucket"), F.lit(0).alias("ghost"))
    out = rows.join(ghosts, ["key", "nth"], "left").withColumn("at", F.explode(F.when(F.col("to").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("to").alias("bucket"), F.lit(1).alias("ghost"))))))
    return out.select("key", "th", "doc_id", "text", "at.bucket", "at.ghost").repartitionById(total, F.col("bucket")).sortWithinPartitions("bucket", "ghost", F.desc("key"), "th", "text").drop("th")


def _compare(k: int, w: int):
    def run(batches):
        held = None  # the row whose following one is not known yet

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "ghost", "doc_id", "text")))

        out: list[tuple] = []

        def flush():
            cols = list(zip(*out)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_edited_chars"])
            out.clear()
            return batch

        for bucket, ghost, doc, text in rows():
            if held and held[0] != bucket:
                held = None
            if ghost and not held:
                continue
            own = winnow(text, k, w)[0]
            if held:
                _, before_doc, before, prints = held
                changed = edited(before, text)
                other = winnow(changed, k, w)[0]
                out.append((before_doc, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), hexed(prints), hexed(other), likeness(prints, other), likeness(prints, own), len(changed)))
                if len(out) >= 500:
                    yield flush()
            held = None if ghost else (bucket, doc, text, own)
        yield flush()

    return run


def compare_with_edits(docs: DataFrame, k: int = 24, w: int = 64) -> DataFrame:
    """Per document: its winnowing fingerprint, that of its edited text, and its likeness to that and to the next one's.

    The next document is that of the next smaller doc_id (null counts as least; rows of equal doc_id follow by
    text hash, then text);
    after the least comes the greatest; a single document follows itself. Fingerprints are the chosen hashes in order of
    position, 8 hexadecimal digits each. Null texts are empty; repeated rows stay; an empty table gives no rows.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edited_chars int"
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    return with_following(docs).mapInArrow(_compare(k, w), schema)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(documents(spark, sf_dir)).drop("n_edited_chars")
