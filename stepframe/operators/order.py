"""Places of rows in an order, and joins in which missing keys meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which a missing key equals a missing key; the keys stand once, before the other columns."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`"))
    out = left.join(other, test, how)
    if how in ("left_semi", "left_anti"):
        return out
    full = how in ("full", "full_outer", "outer", "right", "right_outer")
    shown = [F.coalesce(f"`{k}`", f"`__{k}`").alias(k) if full else F.col(f"`{k}`") for k in keys]
    return out.select(*shown, *[f"`{c}`" for c in left.columns if c not in keys], *[f"`{c}`" for c in right.columns if c not in keys])


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out over as many tasks as a shuffle has, for work that costs far more than its rows' bytes: small files hold many rows in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def placed(df: DataFrame, keys: list[str], order: list[str], name: str = "_at") -> DataFrame:
    """Adds each row's place, from 0, in its group (the table, without keys) by ``order``, missing first.

    A group of any size is spread over tasks: rows are dealt out by ranges of (keys, order) and written; ranges are counted, and a
    row's place is its place in the range and what its group has in the ranges before. Rows that are equal in all of
    ``order`` lie in one range, in any order among themselves. A missing key is a group. What was written stays in the shared folder, as
    the result reads it.
    """
    spark = df.sparkSession
    path = new_folder(spark, "placed")
    ranged = df.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]]).withColumn("__part", F.spark_partition_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    sizes = rows.groupBy(*keys, "__part").agg(F.count("*").alias("__rows"))
    starts = sizes.select(*keys, "__part", (F.sum("__rows").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__rows")).alias("__start"))
    at = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]))
    out = join_same(rows.withColumn("__at", at), starts, [*keys, "__part"])
    return out.select(*[f"`{c}`" for c in df.columns], (F.col("__start") + F.col("__at") - 1).alias(name))
