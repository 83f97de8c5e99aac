"""Token ids of documents in Parquet files (operator 1).

A file's columns: ``doc_id``, metadata columns, ``n_tokens``, ``part``, ``local_start`` and ``ids`` (a list of 32-bit
integers). Rows ascend by doc_id within a file and from file to file. Ids are delta encoded, metadata are dictionary
encoded, row groups and pages have a set size, and each column has a page index, so that a reader of some columns or
some doc_ids touches only their pages. ``<path>_index`` holds each part's first token position.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, new_path, tokenizer_path
from .encoding import encoder, slices


def writer_options(row_group_mb: int, page_kb: int) -> dict:
    return {
        "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_mb << 20, "parquet.page.size": page_kb << 10,
        "parquet.page.row.count.limit": 1000, "parquet.enable.dictionary#ids.list.element": "false", "parquet.enable.dictionary#doc_id": "false",
        "compression": "zstd",
    }


def _encode(tokenizer: str, end_id: int, keep: list[str]):
    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for batch in batches:
            for first, texts in slices(batch):
                ids, bounds = enc.encode(texts, end_id)
                n = np.diff(bounds)
                rows = batch.slice(first, len(texts))
                cols = [rows.column(c) for c in keep]
                cols += [pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(start + bounds[:-1]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                start += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", "part", "local_start", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, metadata: tuple[str, ...] = ("lang", "source"), row_group_mb: int = 32, page_kb: int = 256) -> None:
    """Write the ids of every whole text, each document followed by ``end_id``, in ascending doc_id order.

    One range shuffle of the texts; encoding follows it, so the sampling of ranges doesn't encode. Null texts are empty
    (only the end id); a null doc_id comes first; rows of equal doc_id are ordered by
    the hash of their text, as the ranges are; repeated rows all stay; an
    empty table gives empty files; columns other than ``metadata`` are ignored and may have any name.
    """
    tokenizer = tokenizer or tokenizer_path()
    keep = ["doc_id", *[c for c in metadata if c in docs.columns]]
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_tokens", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    rows.mapInArrow(_encode(tokenizer, end_id, keep), schema).write.options(**writer_options(row_group_mb, page_kb)).mode("overwrite").parquet(path)
    spark = docs.sparkSession
    at, index = 0, []
    # One row for each file: bounded by the number of write tasks.
    for part, n in spark.read.schema(schema).parquet(path).groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():
        index.append((part, at))
        at += n
    spark.createDataFrame(index, "part int, first long").coalesce(1).write.mode("overwrite").parquet(f"{path}_index")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the number of ids of all documents before. Columns not selected are not read."""
    index = spark.read.schema("part int, first long").parquet(f"{path}_index")
    return spark.read.parquet(path).join(F.broadcast(index), "part").withColumn("start", F.col("first") + F.col("local_start")).drop("part", "first", "local_start")


def crc32_of_ids(batches):
    """Adds the unsigned CRC-32 of each row's ids as little-endian unsigned 32-bit integers, in place of the ids."""
    for batch in batches:
        at = batch.schema.get_field_index("ids")
        lists = batch.column(at)
        flat, bounds = lists.values.to_numpy(zero_copy_only=False).view("<u4"), lists.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        cols = [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=[*[n for n in batch.schema.names if n != "ids"], "ids_crc32"])


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path)
    rows = read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids")
    return rows.mapInArrow(crc32_of_ids, "doc_id long, start long, n_tokens long, ids_crc32 long")
