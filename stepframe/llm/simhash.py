"""SimHash near-duplicates by covering locality-sensitive hashing (operator 5), and the pipeline's near-duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, key_of_id, saved, whole_row
from .components import components

BITS = 64
#: Five-word shingles and exact Jaccard similarity of the pipeline's near-duplicates.
SHINGLE_WORDS, SIMILARITY = 5, (4, 5)
#: MinHash bands and hashes of each: a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32, under 5e-8.
BANDS, BAND_HASHES = 32, 4
#: Members of a bucket that are compared with all its others in the first round, about; in each later one, times as many.
PROBES, MORE = 4, 8
#: Bits kept of each MinHash. A pair at similarity 0.8 differs in 25.6 of 256 bits on average, with a deviation of 5.8, and
#: in more than 60 with a probability of about 1e-8; pairs with more are not compared. At 0.5 the average is 64.
KEPT_BITS, MOST_DIFFERING = 2, 60
#: Longs of the bit map that holds a set's shingles, by hash, for a bound on what two sets share.
MAP_LONGS = 16


def simhash(text: str | None, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of the text's word shingles, with repeats."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    n = max(1, len(parts) - words + 1)
    ends = (starts + lengths)[-n:]
    digest = xxhash.xxh64_intdigest
    return folded(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends.tolist())), np.uint64, n))


def folded(hashes: np.ndarray) -> int:
    """The SimHash of hashes: a bit is 1 if it is set in over half of them."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def add_simhash(docs: DataFrame, words: int = 3) -> DataFrame:
    """(key, doc_id, fp): fp is the fingerprint's 64 bits as a long. Null texts and texts without words have zero."""

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(t, words) for t in batch.column("text").to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(fp)], names=["key", "doc_id", "fp"])

    return docs.select(key_of_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key long, doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1)-1 bit masks of a covering code over 64 bits, as signed longs.

    Bit i gets a non-zero vector m(i) of radius+1 bits, each vector about equally often. The mask of a non-zero vector v
    holds the bits with <m(i), v> odd. Any ``radius`` differing bits span less than the whole space, so some v is
    orthogonal to all of their vectors: that mask leaves them all out, and the pair agrees on it.
    """
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)]
    return [_signed(m) for m in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _moves(mask: int, radius: int) -> list[int]:
    """Bit patterns outside a mask of weight up to half the radius, as signed longs."""
    from itertools import combinations

    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [_signed(sum(c)) for k in range(radius // 2 + 1) for c in combinations(free, k)]


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of ``prints`` (fp, distinct) at ``radius`` or fewer bits.

    Links come from collisions in the tables of the covering code: a pair within the radius agrees on some table's mask, and
    differs only outside it. A bucket's members are verified there without making its pairs: for an even radius two of them
    are within it exactly if, among the bits outside the mask, what each reaches by half the radius meets. So each
    member goes to the values that it reaches in its bucket, some 28 for a radius of 2, and is linked to the least one there. A
    value is reached by at most as many members as it reaches itself, so no group is large. Buckets of one are left out first.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "bucket"))
    shared = tables.groupBy("t", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("t", "bucket")
    colliding = tables.join(shared, ["t", "bucket"], "left_semi")
    moves = F.array(*[F.array(*[F.lit(x).cast("long") for x in _moves(m, radius)]) for m in masks])
    reached = colliding.select("t", "fp", F.explode(F.transform(F.get(moves, F.col("t")), lambda x: x.bitwiseXOR(F.col("fp")))).alias("value"))
    met = reached.groupBy("t", "value").agg(F.collect_list("fp").alias("all")).where("size(all) > 1")
    return met.select(F.explode("all").alias("u"), F.array_min("all").alias("v")).where("u <> v").distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """(doc_id, fp, component): the component's least doc_id, through any chain of links.

    Equal fingerprints are first reduced to one row with its least doc_id, so copies cost no links. Null texts, texts
    without words and empty texts have fingerprint zero, linked like any other. A null doc_id counts as the least id and
    gives a null component; rows that repeat a doc_id each get a row; an empty table gives no rows.
    """
    rows = saved(add_simhash(docs, words), "simhash")
    prints = saved(rows.groupBy("fp").agg(F.min("key").alias("first")), "prints")
    found = components(near_links(prints.select("fp"), radius))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = saved(rooted.join(least, "root").select("fp", "least"), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", F.when(F.col("least") != key_null(), F.col("least")).alias("component"))


def key_null():
    from .common import NULL_ID

    return F.lit(NULL_ID).cast("long")


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes (XXH64, seed 42), sorted, of the text's word shingles; a shorter text is one, a null text is empty."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(max(1, len(parts) - words + 1))), np.uint64))


def _least_hashes(own: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The set's MinHashes."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        x = own[at : at + 4096, None] * odd + add
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, x.min(0))
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band of a set's MinHashes."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND_HASHES))], np.uint64).view(np.int64)


def _sketch(least: np.ndarray) -> np.ndarray:
    """Some bits of each MinHash, in longs."""
    bits = (least[:, None] >> np.arange(20, 20 + KEPT_BITS, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").view(np.int64)


def add_shingles(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, hash, fp, n, simhash, bands, sketch): hash of the text, hash of its set of shingles, the set's size, SimHash, band keys and MinHash bits."""
    r = np.random.default_rng(17)
    odd = r.integers(0, 2**64, BANDS * BAND_HASHES, np.uint64) | np.uint64(1)
    add = r.integers(0, 2**64, BANDS * BAND_HASHES, np.uint64)

    def lists(rows, width):
        ends = np.arange(len(rows) + 1, dtype=np.int32) * width
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))

    def run(batches):
        for batch in batches:
            fp, n, prints, bands, bits = [], [], [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), words)
                least = _least_hashes(own, odd, add)
                fp.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                n.append(len(own))
                prints.append(folded(own))
                bands.append(_band_keys(least))
                bits.append(_sketch(least))
            columns = [batch.column("key"), batch.column("hash"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists(bands, BANDS), lists(bits, BANDS * BAND_HASHES * KEPT_BITS // 64)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "hash", "fp", "n", "simhash", "bands", "sketch"])

    return docs.select(key_of_id().alias("key"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "key long, hash long, fp long, n long, simhash long, bands array<long>, sketch array<long>")


def shingle_sets(texts: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(fp, own) of (fp, text): the set of shingles."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, words) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("fp"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["fp", "own"])

    return texts.select("fp", "text").mapInArrow(run, "fp long, own array<long>")


def set_bounds(sets: DataFrame) -> DataFrame:
    """(fp, alone, m0, m1, ...) of (fp, own): how many of a set's shingles no other set has, and a bit map of the others."""
    each = sets.select("fp", F.explode("own").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("fp").alias("fp"))
    single = each.where("n = 1").groupBy("fp").agg(F.collect_list("shingle").alias("single"))
    names = [f"m{i}" for i in range(MAP_LONGS)]

    def run(batches):
        for batch in batches:
            count, maps = [], np.zeros((len(batch), MAP_LONGS), np.uint64)
            for row, own, single in zip(maps, batch.column("own"), batch.column("single")):
                single = single.values.to_numpy() if single.is_valid else np.zeros(0, np.int64)
                at = np.setdiff1d(own.values.to_numpy(), single, assume_unique=True).view(np.uint64) % np.uint64(64 * MAP_LONGS)
                np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
                count.append(len(single))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(count, pa.int64()), *map(pa.array, np.ascontiguousarray(maps.T).view(np.int64))], names=["fp", "alone", *names])

    return sets.join(single, "fp", "left").select("fp", "own", "single").mapInArrow(run, "fp long, alone long, " + ", ".join(f"{c} long" for c in names))


def simhash_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (u_fp, v_fp) of ``prints`` (fp, distinct; simhash) whose SimHashes lie within the radius, enough to join all of them but for the exact check.

    Sets of one SimHash go with the least of them, and these by the links of the covering tables, so a large group makes no pairs of all its members.
    """
    least = saved(prints.groupBy("simhash").agg(F.min("fp").alias("first")), "simhashes")
    same = prints.join(least, "simhash").where("fp <> first").select(F.col("first").alias("u_fp"), F.col("fp").alias("v_fp"))
    links = near_links(least.select(F.col("simhash").alias("fp")), radius)
    links = links.join(least.select(F.col("simhash").alias("u"), F.col("first").alias("a")), "u").join(least.select(F.col("simhash").alias("v"), F.col("first").alias("b")), "v")
    return same.unionByName(links.select(F.least("a", "b").alias("u_fp"), F.greatest("a", "b").alias("v_fp")))


def similar_components(prints: DataFrame, sets_of) -> DataFrame:
    """(node, root) of the components of all pairs of ``prints`` (fp, distinct; n, simhash, bands, sketch) with similarity 0.8 or more.
    ``sets_of`` gives (fp, own), the sets of a table of fp.

    SimHash goes first: the pairs within its radius are compared exactly, and those that are similar make the components that all else starts from.
    A pair at 0.8 differs in about 10 of 64 bits, though, and tables that hold all such pairs would hold nearly all others, so what
    SimHash can't reach is completed by MinHash bands, in rounds. In each round some members of a bucket, by a hash, meet all its members that aren't yet in
    their component, and are compared exactly unless sizes, sketches or bounds on what they share rule them out; ``MORE``
    times as many in the next, until every pair that shares a band has met or lies in one component. So a large group of
    near copies costs a few rows for each member, and no pair is left out. A set of which over a fifth of the shingles are
    in no other candidate has no links, and leaves at once. A round's new links join the components found before.
    """
    num, den = SIMILARITY
    all_members = prints.select("fp", F.posexplode("bands").alias("band", "bucket"))
    shared = all_members.groupBy("band", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    # A set has the same place in all its buckets, so that buckets of the same members repeat their pairs.
    odds = F.shiftrightunsigned(F.xxhash64("fp", F.lit(29)), 11) / F.lit(float(1 << 53))
    now = saved(all_members.join(shared, ["band", "bucket"]).withColumn("turn", odds * F.col("size")), "members")
    largest = now.agg(F.max("size")).first()[0]
    near = saved(simhash_pairs(prints.select("fp", "simhash")), "near")
    facts = prints.select("fp", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(BANDS * BAND_HASHES * KEPT_BITS // 64)])
    sketch = [c for c in facts.columns if c not in ("fp", "n")]
    facts = facts.join(now.select("fp").union(near.select("u_fp")).union(near.select("v_fp")).distinct(), "fp", "left_semi")
    candidates = saved(sets_of(facts.select("fp")), "sets")
    # A pair shares at most what either has besides shingles that are in no other set, or whose bit the other lacks.
    facts = saved(facts.join(set_bounds(candidates), "fp").where(den * (F.col("n") - F.col("alone")) >= num * F.col("n")), "facts")
    bits = [f"m{i}" for i in range(MAP_LONGS)]
    lacking = lambda a, b: sum((F.bit_count(F.col(f"{a}_{c}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{c}")))) for c in bits), F.col(f"{a}_alone"))
    at_most = F.least(F.col("u_n") - lacking("u", "v"), F.col("v_n") - lacking("v", "u"))
    may_share = (num + den) * at_most >= num * (F.col("u_n") + F.col("v_n"))
    roots = saved(facts.select(F.col("fp").alias("node"), F.col("fp").alias("root")), "roots")

    def joined(pairs: DataFrame) -> DataFrame:
        """Roots after the pairs (u_fp, u_n, u_root, v_fp, v_n, v_root) that are similar join theirs."""
        met = pairs.join(candidates.select(F.col("fp").alias("u_fp"), F.col("own").alias("own_u")), "u_fp")
        met = met.join(candidates.select(F.col("fp").alias("v_fp"), F.col("own").alias("own_v")), "v_fp")
        common = F.size(F.array_intersect("own_u", "own_v"))
        new = met.where((num + den) * common >= num * (F.col("u_n") + F.col("v_n"))).select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
        new, out = saved(new.distinct(), "similar"), roots
        if not new.isEmpty():
            merged = components(new).select(F.col("node").alias("root"), F.col("root").alias("least"))
            out = saved(roots.join(merged, "root", "left").select("node", F.coalesce("least", "root").alias("root")), "roots")
            discard(roots)
        discard(new)
        return out

    side = lambda x: facts.select(*[F.col(c).alias(f"{x}_{c}") for c in facts.columns])
    alike = near.join(side("u"), "u_fp").join(side("v"), "v_fp").where((den * F.least("u_n", "v_n") >= num * F.greatest("u_n", "v_n")) & may_share)
    roots = joined(alike.select("u_fp", "u_n", F.col("u_fp").alias("u_root"), "v_fp", "v_n", F.col("v_fp").alias("v_root")))
    discard(near)
    probes, before = PROBES, 0
    while largest:
        # Buckets within one component are done with.
        rooted = now.select("band", "bucket", "fp", "size", "turn").join(roots.withColumnRenamed("node", "fp"), "fp")
        mixed = rooted.groupBy("band", "bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band", "bucket")
        left = saved(rooted.join(mixed, ["band", "bucket"], "left_semi"), "mixed")
        discard(now)
        now = left
        if now.isEmpty():
            break
        known = now.join(facts, "fp")
        probe = known.where((F.col("turn") >= before) & (F.col("turn") < probes))
        probe = probe.select("band", "bucket", *[F.col(c).alias(f"u_{c}") for c in ("fp", "root", *facts.columns[1:])])
        rest = known.select("band", "bucket", *[F.col(c).alias(f"v_{c}") for c in ("fp", "root", *facts.columns[1:])])
        differing = sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in sketch), F.lit(0))
        near_size = den * F.least("u_n", "v_n") >= num * F.greatest("u_n", "v_n")
        meets = [F.col(f"probe.{c}") == F.col(f"rest.{c}") for c in ("band", "bucket")]
        pairs = probe.alias("probe").join(rest.alias("rest"), [*meets, F.col("u_root") != F.col("v_root"), near_size, differing <= MOST_DIFFERING, may_share])
        least = F.col("u_fp") < F.col("v_fp")
        sides = [F.when(least, F.col(f"u_{c}")).otherwise(F.col(f"v_{c}")).alias(f"u_{c}") for c in ("fp", "n", "root")]
        sides += [F.when(least, F.col(f"v_{c}")).otherwise(F.col(f"u_{c}")).alias(f"v_{c}") for c in ("fp", "n", "root")]
        pairs = saved(pairs.select(*sides).distinct(), "pairs")
        roots = joined(pairs)
        discard(pairs)
        if probes >= largest:
            break
        before, probes = probes, probes * MORE
    return roots


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each group of near-duplicates, all columns: that of least doc_id, of these the one of least text hash.

    Near-duplicates: word shingles with Jaccard similarity 0.8 or more, through any chain; SimHash links them first, see ``similar_components``. Equal sets are first reduced
    to one. Null and empty texts are alike. A null doc_id counts as the least id; rows of null or equal doc_id with texts
    of other groups stay; of rows that repeat id and text one stays. An empty table gives no rows.
    """
    prints = saved(add_shingles(docs, words).groupBy("fp").agg(F.min(F.struct("key", "hash")).alias("first"), F.first("n").alias("n"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "prints")

    def sets_of(fps):
        # Texts are read again: sets of all documents would take more room than the texts.
        wanted = saved(prints.join(fps, "fp", "left_semi").select("fp", F.col("first.key").alias("key"), F.col("first.hash").alias("hash")).hint("rebalance"), "wanted")
        texts = docs.select(key_of_id().alias("key"), F.xxhash64("text").alias("hash"), "text").join(wanted, ["key", "hash"])
        return shingle_sets(texts.groupBy("fp").agg(F.first("text").alias("text")), words)

    found = similar_components(prints.select("fp", "n", "simhash", "bands", "sketch"), sets_of)
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("_key"), F.col("first.hash").alias("_hash"))
    kept = docs.select(whole_row(docs), key_of_id().alias("_key"), F.xxhash64("text").alias("_hash")).join(chosen, ["_key", "_hash"], "left_semi")
    return kept.dropDuplicates(["_key", "_hash"]).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


__all__ = ["add_simhash", "covering_masks", "keep_one", "near_duplicates", "near_links", "op5_simhash", "shingles", "simhash"]
