"""Language-model scores of whole texts by a causal attention model, beside a word unigram base (operator 6)."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .attention import WIDTH, Attention, Symbols, Windows, score_texts
from .common import discard, documents, key_of_id, saved, tokenizer_path
from .encoding import encoder, forget, give_back, slices

#: Words counted more often than this part of all tokens go to the tasks; there are at most as many as its inverse.
HEAVY_SHARE = 1 / 2_000_000
#: Training ids of a shard, about.
SHARD_IDS = 8_000_000
#: A shard of fewer ids, as there is in a small corpus, goes over them more than once, until it has trained on as many, about; at most so
#: many times.
PASSES = 10
#: Of each 16 windows of a shard, those that train between two averagings.
ROUNDS = ((0, 1), (1, 4), (4, 16))
#: Adagrad's first rate; it falls to a tenth. Windows of a step: least, most, and those seen before for each one more.
RATE, LEAST, MOST, SEEN = 0.15, 64, 512, 128
#: Windows cut together, ranks read together, and windows of a shard that train as one.
BLOCK, AT_ONCE, LARGEST = 32_768, 1_000_000, 2_000_000
#: Parts of the parameters that are summed apart from each other, and their fixed point.
PARTS, POINT = 16, 1 << 20
#: Words between white space that a worker remembers, and pieces while it encodes.
REMEMBERED, PIECES = 400_000, 600_000
#: How ids and windows are written.
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
#: Word counts travel in so many parts by hash; distinct words that are added up at a time.
WORD_PARTS, WORDS_HELD = 256, 2_000_000


def is_held_out() -> Column:
    """crc32 of the doc_id as text, modulo 7, is 2; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


class _WordHashes:
    """64-bit hashes of the encoder's pieces, kept beside it."""

    def __init__(self, enc):
        self.enc, self.index, self.hashes = enc, None, np.zeros(0, np.int64)

    def get(self) -> np.ndarray:
        if self.index is not self.enc.index:
            self.index, self.hashes = self.enc.index, np.zeros(0, np.int64)
        if len(self.index) > len(self.hashes):
            new = [xxhash.xxh64_intdigest(w, 0) for w in islice(self.index, len(self.hashes), None)]
            self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64).view(np.int64)])
        return self.hashes


_HASHES: dict[int, _WordHashes] = {}


def _hashes_of(enc) -> _WordHashes:
    """The worker's hashes for an encoder, kept from task to task like the encoder."""
    return _HASHES.setdefault(id(enc), _WordHashes(enc))


def _make_room() -> None:
    """Workers go from stage to stage: what they remember of pieces isn't needed once texts are encoded, and takes hundreds of MB."""
    forget()
    _HASHES.clear()
    give_back()


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of binaries in one array, and each row's offsets in it."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(data, kind, (offsets[-1] - offsets[0]) // size, offsets[0]) if data is not None and len(column) else np.zeros(0, kind)
    return flat, (offsets - offsets[0]) // size


_TEXT = {"key": pa.int64(), "th": pa.int64(), "held": pa.bool_(), "ids": pa.binary(), "goes_on": pa.binary(), "words": pa.binary(), "times": pa.binary()}
_GATHERED = "kind int, what long, n long, key long, th long, held boolean, ids binary, goes_on binary, words binary, times binary"


def _gather(path: str):
    """Summed within each task, of training texts: word counts (kind 0), counts of symbols (1), the number of texts (3); and
    each text's ids, and whether each one's piece goes on after it though it could end there (2)."""

    def run(batches):
        # Hashes and counts of all remembered pieces stand beside them here; words of a run before are of no use.
        _WORDS.clear()
        give_back()
        enc = encoder(path, PIECES)
        hashes = _hashes_of(enc)
        symbols = np.zeros(2 * enc.tokenizer.get_vocab_size(), np.int64)
        texts_seen, index, totals = 0, enc.index, np.zeros(0, np.int64)

        def rows(kind, keys, counts):
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(keys), pa.array(counts), *[pa.nulls(n, t) for t in _TEXT.values()]], names=["kind", "what", "n", *_TEXT])

        def flush():
            used = np.flatnonzero(totals)
            words, part = hashes.hashes[used], hashes.hashes[used] & (WORD_PARTS - 1)
            order = np.argsort(part.astype(np.uint16), kind="stable")
            at = np.searchsorted(part[order], np.arange(WORD_PARTS + 1))
            none = [pa.nulls(WORD_PARTS, t) for t in list(_TEXT.values())[:-2]]
            counted = _binary(words[order], at), _binary(totals[used][order], at)
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(WORD_PARTS, np.int32)), pa.array(np.arange(WORD_PARTS)), pa.nulls(WORD_PARTS, pa.int64()), *none, *counted], names=["kind", "what", "n", *_TEXT])

        for batch in batches:
            give_back()
            for first, texts in slices(batch):
                n = len(texts)
                own = batch.slice(first, n)
                pieces, counts = enc.pieces(texts, lower=True)
                if enc.index is not index:
                    # The encoder has numbered its pieces anew; the hashes are still those of the old numbers.
                    yield flush()
                    index, totals = enc.index, np.zeros(0, np.int64)
                hashes.get()
                train = ~own.column("held").to_numpy(zero_copy_only=False)
                texts_seen += int(train.sum())
                counted = np.bincount(pieces[np.repeat(train, counts)], minlength=len(index))
                counted[: len(totals)] += totals
                totals = counted
                ids, bounds = enc.ids(pieces, counts)
                length = enc.lengths[pieces]
                goes_on = enc.ending[ids]
                goes_on[np.cumsum(length)[length > 0] - 1] = False
                known = np.repeat(train, np.diff(bounds))
                symbols += np.bincount((ids + goes_on * np.int64(len(symbols) // 2))[known], minlength=len(symbols))
                columns = [own.column("key"), own.column("th"), own.column("held"), _binary(ids.astype(_id_type(len(symbols) // 2)), bounds), _binary(goes_on.view(np.uint8), bounds), *[pa.nulls(n, pa.binary())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.diff(bounds)), *columns], names=["kind", "what", "n", *_TEXT])
        yield flush()
        used = np.flatnonzero(symbols)
        yield rows(1, used, symbols[used])
        yield rows(3, np.zeros(1, np.int64), np.array([texts_seen]))
        give_back()

    return run


def _word_counts(batches):
    """(word, c) from word counts of tasks. A part with too many words to hold gives some of them more than once."""
    held: list = []

    def summed():
        words, counts = (np.concatenate(x) for x in zip(*held))
        own, at = np.unique(words, return_inverse=True)
        return own, np.bincount(at, counts, len(own)).astype(np.int64)

    def give():
        own, counts = summed()
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts)], names=["word", "c"])

    size = 0
    for batch in batches:
        for first in range(0, len(batch), WORD_PARTS):
            own = batch.slice(first, WORD_PARTS)
            held.append((_flat(own.column("words"), np.int64)[0], _flat(own.column("times"), np.int64)[0]))
            size += len(held[-1][0])
            if size > WORDS_HELD:
                held = [summed()]
                size = len(held[0][0])
                if size > WORDS_HELD // 2:
                    yield give()
                    held, size = [], 0
    if size:
        yield give()


def _id_type(vocabulary: int):
    return np.uint16 if vocabulary <= 1 << 16 else np.uint32


def _ranks(batch, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    vocabulary = len(symbols.rank) // 2
    ids, bounds = _flat(batch.column("ids"), _id_type(vocabulary))
    goes_on, _ = _flat(batch.column("goes_on"), np.uint8)
    return symbols.rank[ids.astype(np.int64) + goes_on.astype(np.int64) * vocabulary], bounds


def _runs(batch, symbols: Symbols):
    """(first row, last row, ranks, bounds) for runs of a batch's rows with a bounded number of ranks, a longer text alone."""
    size = np.cumsum(batch.column("n").to_numpy())
    first = 0
    while first < len(size):
        end = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + AT_ONCE, "right")))
        yield first, end, *_ranks(batch.slice(first, end - first), symbols)
        first = end


def _cut(sent, end_id: int):
    """Cuts texts, sorted by shard, into windows: for each shard and round a row with all of its windows."""

    def run(batches):
        _make_room()
        symbols = sent.value
        end, kind = int(symbols.rank[end_id]), _id_type(symbols.used + 2)
        none, now, number = np.iinfo(kind).max, None, 0
        held: list[list[np.ndarray]] = [[] for _ in ROUNDS]

        def rows(rounds):
            full = [k for k in rounds if held[k]]
            out = pa.RecordBatch.from_arrays([pa.array([now] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([np.concatenate(held[k]).tobytes() for k in full], pa.binary())], names=["shard", "round", "windows"])
            for k in full:
                held[k] = []
            return out

        for batch in batches:
            own = batch.column("shard").to_numpy()
            for first, last in _spans(own):
                if now != own[first]:
                    if now is not None:
                        yield rows(range(len(ROUNDS)))
                    now, number = int(own[first]), 0
                for _, _, ranks, bounds in _runs(batch.slice(first, last - first), symbols):
                    windows = Windows(ranks, bounds, end, WIDTH)
                    for a in range(0, len(windows), BLOCK):
                        which = np.arange(a, min(a + BLOCK, len(windows)))
                        for k, (low, high) in enumerate(ROUNDS):
                            turn = (number + which) % 16
                            mine = windows.take(which[(turn >= low) & (turn < high)])[1]
                            held[k].append(np.where(mine < 0, none, mine).astype(kind))
                            if len(held[k]) * BLOCK > LARGEST:
                                yield rows([k])
                    number += len(windows)
        if now is not None:
            yield rows(range(len(ROUNDS)))

    return run


_SUMS = "part int, sums binary"


def _train(sent, part: tuple[int, int], expected: float, passes: int = 1):
    """Trains on each row's windows, so many times, from the parameters that were sent, and adds up the results."""

    def run(batches):
        _make_room()
        symbols, flat = sent.value
        kind = _id_type(symbols.used + 2)
        model, before = Attention(symbols), passes * expected * part[0] / 16
        rows_of = model.rows_of()
        totals, trained = np.zeros(len(flat), np.int64), np.zeros(symbols.used + 2, np.int64)
        for batch in batches:
            for shard, windows in zip(batch.column("shard").to_pylist(), batch.column("windows")):
                own = np.frombuffer(windows.as_buffer(), kind).reshape(-1, WIDTH + 1).astype(np.int32)
                own[own == np.iinfo(kind).max] = -1
                model.load(flat)
                order, done = np.random.default_rng(shard), before
                for _ in range(passes):
                    own, first = own[order.permutation(len(own))], 0
                    while first < len(own):
                        size = int(min(max(done // SEEN, LEAST), MOST))
                        model.step(own[first : first + size], RATE * (1 - 0.9 * min(done / max(passes * expected, 1), 1)))
                        first, done = first + size, done + size
                seen = np.zeros(symbols.used + 1, bool)
                seen[np.maximum(own.ravel(), 0)] = True
                totals += np.where((rows_of < 0) | seen[rows_of], np.rint(model.flat().astype(np.float64) * POINT).astype(np.int64), 0)
                trained[:-1] += seen
                trained[-1] += 1
        if trained[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array([x.tobytes() for x in (*np.array_split(totals, PARTS), trained)], pa.binary())], names=["part", "sums"])

    return run


def _spans(values: np.ndarray):
    """First and last of each run of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    return zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(values)]]).tolist()) if len(values) else ()


def _add(batches):
    totals: dict = {}
    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            own = np.frombuffer(batch.column("sums")[i].as_buffer(), np.int64)
            totals[part] = totals[part] + own if part in totals else own.copy()
    if totals:
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["part", "sums"])


def fit(texts: DataFrame, symbols: Symbols, end_id: int) -> Attention:
    """The model after a pass over all windows of ``texts`` (key, n, th, ids, goes_on), or ``PASSES`` at most in a small corpus.

    Texts are dealt to shards of about ``SHARD_IDS`` ids by a hash of id and text and stand there in the order of another,
    so shards don't depend on partitions. In each round every shard trains on its part of its windows from the same
    parameters, and these are averaged: rows of a symbol over the shards that saw it, the rest over all. Sums are of whole
    numbers in fixed point, the same in any order; each task adds up its shards, and each of ``PARTS`` parts meets in one
    row. The driver gets those rows, a few megabytes whatever the input. A shard with over ``LARGEST`` windows in a
    round, which takes a huge text, trains as several.
    """
    spark = texts.sparkSession
    model = Attention(symbols)
    total = texts.agg(F.sum("n")).first()[0]
    if total is None:
        return model
    count = int(max(1, -(-total // SHARD_IDS)))
    passes = int(min(max(round(SHARD_IDS * count / max(total, 1)), 1), PASSES))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("key", "th", F.lit(71)), F.lit(count)).cast("int")).withColumn("turn", F.xxhash64("key", "th", F.lit(5)))
    own = dealt.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "turn", "key", "th").select("shard", "n", "ids", "goes_on")
    shards = saved(own.mapInArrow(_cut(spark.sparkContext.broadcast(symbols), end_id), "shard int, round int, windows binary"), "shards", **ZSTD)
    for k, part in enumerate(ROUNDS):
        flat = model.flat()
        sums = shards.where(F.col("round") == k).mapInArrow(_train(spark.sparkContext.broadcast((symbols, flat)), part, total / WIDTH / count, passes), _SUMS)
        got = {r.part: np.frombuffer(bytes(r.sums), np.int64) for r in sums.repartition(PARTS + 1, "part").mapInArrow(_add, _SUMS).collect()}
        if got:
            trained, rows_of = got[PARTS], model.rows_of()
            n = np.where(rows_of < 0, trained[-1], trained[:-1][rows_of])
            model.load(np.where(n > 0, np.concatenate([got[i] for i in range(PARTS)]) / POINT / np.maximum(n, 1), flat).astype(np.float32))
    discard(shards)
    return model


def _score(sent, end_id: int):
    def run(batches):
        _make_room()
        symbols, flat = sent.value
        model, end = Attention(symbols).load(flat), int(symbols.rank[end_id])
        for batch in batches:
            for first, last, ranks, bounds in _runs(batch, symbols):
                own = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("th"), pa.array(score_texts(model, ranks, bounds, end) / np.log(10))], names=["key", "th", "score"])

    return run


class _Words(dict):
    """Numbers words between white space and keeps log10 of each one's count and 1; NaN for words that aren't in the table."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        super().__init__()
        self.keys, self.table, self.fresh = keys, logs, []
        self.hashes, self.logs = np.zeros(0, np.int64), np.zeros(0)

    def __missing__(self, word):
        self[word] = at = len(self)
        self.fresh.append(xxhash.xxh64_intdigest(word, 0))
        return at

    def numbers(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words in one array, and how many each text has; valid until the next call."""
        if len(self) > REMEMBERED:
            self.clear()
            self.hashes, self.logs = np.zeros(0, np.int64), np.zeros(0)
        look, parts = self.__getitem__, []
        for text in texts:
            words = text.encode("utf-8", "replace").lower().split() if text else []
            parts.append(np.fromiter(map(look, words), np.int64, len(words)))
        if self.fresh:
            new, self.fresh = np.array(self.fresh, np.uint64).view(np.int64), []
            at = np.minimum(np.searchsorted(self.keys, new), max(len(self.keys) - 1, 0))
            self.hashes = np.concatenate([self.hashes, new])
            self.logs = np.concatenate([self.logs, np.where(self.keys[at] == new, self.table[at], np.nan) if len(self.keys) else np.full(len(new), np.nan)])
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.fromiter(map(len, parts), np.int64, len(parts))


_WORDS: dict = {}
_PARTS = "rid long, word long, n long, doc_id long, key long, th long, held_out boolean, n_tokens long, n_known long, heavy double"
_DOC = {"doc_id": pa.int64(), "key": pa.int64(), "th": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "heavy": pa.float64()}


def _base(heavy):
    """For each text a row with what frequent words give, and one for each other word in it, with its hash and count."""

    def run(batches):
        _make_room()
        if heavy.value is not _WORDS.get("sent"):
            _WORDS.update(sent=heavy.value, words=_Words(*heavy.value))
        table = _WORDS["words"]
        for batch in batches:
            for first, texts in slices(batch):
                m, own = len(texts), batch.slice(first, len(texts))
                numbers, counts = table.numbers(texts)
                text, logs = np.repeat(np.arange(m), counts), table.logs[numbers]
                known = ~np.isnan(logs)
                rid = own.column("rid").to_numpy()
                docs = [own.column("doc_id"), own.column("key"), own.column("th"), own.column("held"), pa.array(counts + 1), pa.array(np.bincount(text, known, m).astype(np.int64)), pa.array(np.bincount(text[known], logs[known], m))]
                yield pa.RecordBatch.from_arrays([own.column("rid"), pa.array(rid * 2_654_435_761 + 97), pa.array(np.zeros(m, np.int64)), *docs], names=["rid", "word", "n", *_DOC])
                size = max(len(table.hashes), 1)
                pair, n = np.unique((text * np.int64(size) + numbers)[~known], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rid[pair // size]), pa.array(table.hashes[pair % size] if len(pair) else pair), pa.array(n), *[pa.nulls(len(pair), t) for t in _DOC.values()]], names=["rid", "word", "n", *_DOC])

    return run


def _by_id(rows: DataFrame, size: int) -> np.ndarray:
    """Sums of n by what, a row for each symbol of the vocabulary at most."""
    out = np.zeros(size, np.int64)
    table = rows.groupBy("what").agg(F.sum("n").alias("n")).toPandas()
    out[table["what"].to_numpy(int)] = table["n"].to_numpy(int)
    return out


def scores(docs: DataFrame, tokenizer: str | None = None, end_id: int = 49407) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Base: add-one unigram probabilities of lower-cased words and an end, from all training texts. Score: probability, by the
    attention model, of the text's subword ids and an end; after an id that can end a piece between white space, whether
    the piece goes on is part of the symbol that the model predicts. So the score, like the base, is that of the text up to the kind of its
    white space. Words are counted by 64-bit hashes.

    All training texts are counted, and each of their ids is a target of one window. Texts are encoded once; ids stand in the shared folder. Counts are summed in the tasks before the shuffle. Words over ``HEAVY_SHARE`` of all tokens, at
    most its inverse in number, go to the tasks as a table; only the others of a document are shuffled to meet their
    counts, so no word has many rows. Null texts are empty: one end. Rows that repeat a doc_id each get a row. Without
    training texts all words are unknown and the model is as it starts. An empty table gives no rows; other columns are ignored.
    """
    path = tokenizer or tokenizer_path()
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of_id().alias("key"), F.xxhash64("text").alias("th"), is_held_out().alias("held"), "text")
    got = saved(rows.select("key", "th", "held", "text").mapInArrow(_gather(path), _GATHERED), "gathered", **ZSTD)
    dealt = got.where("kind = 0").select("what", "words", "times").repartition("what").mapInArrow(_word_counts, "word long, c long")
    counts = saved(dealt.groupBy("word").agg(F.sum("c").alias("c")), "words")
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = got.where("kind = 3").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = words + ends, distinct + (ends > 0)
    seen = _by_id(got.where("kind = 1"), 2 * encoder(path).tokenizer.get_vocab_size())
    seen[end_id] += ends
    symbols, texts = Symbols(seen), got.where("kind = 2")
    model = fit(texts.where("not held").select("key", "n", "th", "ids", "goes_on"), symbols, end_id)
    sent = spark.sparkContext.broadcast((symbols, model.flat()))
    top = counts.where(F.col("c") > total * HEAVY_SHARE).toPandas().sort_values("word")
    heavy = spark.sparkContext.broadcast((top["word"].to_numpy(np.int64), np.log10(top["c"].to_numpy(float) + 1)))
    # Equal texts of equal ids have equal scores.
    scored = texts.select("key", "th", "n", "ids", "goes_on").mapInArrow(_score(sent, end_id), "key long, th long, score double").dropDuplicates(["key", "th"])
    parts = rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_base(heavy), _PARTS)
    met = parts.join(counts, "word", "left").groupBy("rid").agg(*[F.max(c).alias(c) for c in _DOC], F.sum(F.when(F.col("c").isNotNull(), F.col("n") * F.log10(F.col("c") + 1)).otherwise(0.0)).alias("rest"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_rest"))
    base = F.col("heavy") + F.col("rest") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1)))
    return met.join(scored, ["key", "th"]).select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("n_rest") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
