"""Sum-of-squares online packing of documents into fixed windows (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved, tokenizer_path
from .encoding import encoder, forget, give_back, slices
from .token_files import crc32_of_ids

#: Distinct words that a worker remembers beside its open windows.
REMEMBERED = 900_000
PIECES = "doc_id long, start long, length long, doc_tokens long, part int, local_id long, offset long, ids array<int>"


class SumOfSquaresPacker:
    """Places each item into the fill level that minimises the sum over levels of squared counts of open windows.

    ``levels[h]`` counts the open windows filled to h. Moving a window from h to h+s changes the sum by
    2*(levels[h+s]-levels[h])+2, one less if that fills it; a new window changes it by 2*levels[s]+1. Ties go to the
    fullest window. An item is (document, start, ids); ``full`` receives each filled window as a list of items.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, item: tuple) -> list | None:
        size, cap, levels = len(item[2]), self.capacity, self.levels
        if size == cap:
            return [item]
        h = np.flatnonzero(levels[1 : cap - size + 1]) + 1
        window, level = [], 0
        if len(h):
            cost = 2 * (levels[h + size] - levels[h]) + 2 - (h + size == cap)
            best = len(h) - 1 - int(np.argmin(cost[::-1]))
            if cost[best] <= 2 * levels[size] + 1:
                level = int(h[best])
                window = self.open[level].pop()
                levels[level] -= 1
        window.append(item)
        if level + size == cap:
            return window
        levels[level + size] += 1
        self.open.setdefault(level + size, []).append(window)
        return None

    def rest(self):
        """Windows still open: the emptiest are cut to fill the fullest; the last one is cut at powers of two."""
        left = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        i, j = 0, len(left) - 1
        fill = [sum(len(x[2]) for x in w) for w in left]
        while i < j:
            gap = self.capacity - fill[i]
            doc, start, ids = left[j].pop()
            fill[j] -= min(gap, len(ids))
            left[i].append((doc, start + len(ids) - min(gap, len(ids)), ids[-min(gap, len(ids)) :]))
            fill[i] += min(gap, len(ids))
            if len(ids) > gap:
                left[j].append((doc, start, ids[:-gap]))
            if not left[j]:
                j -= 1
            if fill[i] == self.capacity:
                yield left[i]
                i += 1
        if i != j:
            return
        items, total = left[i], fill[i]
        for bit in range(total.bit_length() - 1, -1, -1):
            want, window = total & (1 << bit), []
            while want:
                doc, start, ids = items.pop(0)
                if len(ids) > want:
                    items.insert(0, (doc, start + want, ids[want:]))
                    ids = ids[:want]
                window.append((doc, start, ids))
                want -= len(ids)
            if window:
                yield window


def _pack(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        enc, packer = encoder(tokenizer, REMEMBERED), SumOfSquaresPacker(capacity)

        def rows(windows):
            nonlocal seq
            cols, all_ids = [[] for _ in range(6)], []
            for window in windows:
                offset = 0
                for (doc, n), start, ids in window:
                    for col, value in zip(cols, (doc, start, len(ids), n, seq, offset)):
                        col.append(value)
                    all_ids.append(ids)
                    offset += len(ids)
                seq += 1
            doc, start, length, n, local, offset = (pa.array(c, pa.int64()) for c in cols)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in all_ids])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32), pa.int32()))
            return pa.RecordBatch.from_arrays([doc, start, length, n, pa.array(np.full(len(doc), part, np.int32)), local, offset, ids], names=["doc_id", "start", "length", "doc_tokens", "part", "local_id", "offset", "ids"])

        for batch in batches:
            give_back()
            keys = batch.column("doc_id").to_pylist()
            for first, texts in slices(batch):
                ids, bounds = enc.encode(texts, end_id)
                done = []
                for i in range(len(texts)):
                    own = ids[bounds[i] : bounds[i + 1]]
                    for at in range(0, len(own), capacity):
                        # A copy, so that an open window doesn't hold the whole batch.
                        if window := packer.place(((keys[first + i], len(own)), at, own[at : at + capacity].copy())):
                            done.append(window)
                yield rows(done)
        yield rows(packer.rest())

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents with their sequence, offset and ids; no shuffle of texts.

    Each partition packs its own documents online: whole windows of a long document at once, its remainder by sum of
    squares. Windows open at the partition's end are merged by cutting the emptiest, and the last is cut at powers of
    two, so nothing is padded. A partition holds at most its open windows in memory. ``sequence_id`` is gapless over all
    partitions: the pieces are written to the shared folder, then each partition's first number is added (one row for
    each partition goes to the driver). Null texts are empty (an end id only), null doc_ids stay null, repeated rows are
    packed once each, an empty table gives no rows, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = saved(rows.mapInArrow(_pack(tokenizer or tokenizer_path(), end_id, capacity), PIECES), "packed")
    at, first = 0, []
    for part, n in pieces.groupBy("part").agg(F.max("local_id") + 1).orderBy("part").collect():
        first.append((part, at))
        at += n
    index = spark.createDataFrame(first, "part int, first long")
    return pieces.join(F.broadcast(index), "part").select("doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("local_id")).alias("sequence_id"), "offset", "ids")


def _checksums(batches):
    forget()
    yield from crc32_of_ids(batches)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.mapInArrow(_checksums, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(documents(spark, sf_dir)))
