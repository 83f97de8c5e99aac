"""Row-order operators. A table has no order of its own: each takes the order explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import join_same, placed


def with_input_order(df: DataFrame, name: str = "_row") -> DataFrame:
    """The physical place of a scanned row, (file path, row in file), independent of partitioning."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))


def sort(df: DataFrame, by: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """A total order by keys; missing first, or last where descending."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_first() for c in by])


def first_of_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """NODUPKEY: the first row of each key; keys compare missing as equal."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_rows(df: DataFrame, n: int, keys: list[str], order: list, place: str = "_n") -> DataFrame:
    """The first n rows of each key (of the table, without keys), with their place from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if not keys:
        return df.orderBy(*order).limit(n).withColumn(place, F.row_number().over(w))
    return df.withColumn(place, F.row_number().over(w)).where(F.col(place) <= n)


def by_group(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, maxima: dict[str, tuple[str, float]] | None = None, carried: dict[str, str] | None = None) -> DataFrame:
    """Adds _first and _last (1/0), running sums, retained maxima and carried values of each BY group.

    sums: new column -> value, missing counts as 0. maxima: new column -> (value, start). carried: new column -> value,
    the last that isn't missing. All run over one window specification, so there is one shuffle and one sort.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = {"_first": (F.row_number().over(w) == 1).cast("int"), "_last": F.lead(F.lit(0), 1, 1).over(w)}
    out |= {n: F.sum(F.coalesce(F.col(v), F.lit(0))).over(run) for n, v in (sums or {}).items()}
    out |= {n: F.greatest(F.max(v).over(run), F.lit(start)) for n, (v, start) in (maxima or {}).items()}
    out |= {n: F.last(v, ignorenulls=True).over(run) for n, v in (carried or {}).items()}
    return df.withColumns(out)


def outputs(df: DataFrame, targets: dict[str, tuple[Column | None, list[str] | None]]) -> dict[str, DataFrame]:
    """One step, several targets: name -> (row condition, columns)."""
    out = {}
    for name, (condition, columns) in targets.items():
        rows = df.where(condition) if condition is not None else df
        out[name] = rows.select(*columns) if columns else rows
    return out


def best_of(df: DataFrame, keys: list[str], column: str, ranking: list[str], ties: list[str]) -> DataFrame:
    """The row of each key whose value stands first in ``ranking``; values not in it come last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ranking)), F.col(column)), F.lit(0)), F.lit(len(ranking) + 1))
    return first_of_key(df, keys, [rank, *ties])


def top_two(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """best, top, runner_up score, and whether they tie, of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(label))
    ranked = df.withColumns({"_n": F.row_number().over(w), "runner_up": F.coalesce(F.lead(score).over(w), F.lit(0.0))})
    return ranked.where("_n = 1").select(*keys, F.col(label).alias("best"), F.col(score).alias("top"), "runner_up", (F.col(score) == F.col("runner_up")).alias("tie"))


def extra_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how many rows are extra."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with a count for each: side, the columns, n."""
    cols = left.columns
    counted = left.withColumn("_d", F.lit(1)).unionByName(right.select(*cols).withColumn("_d", F.lit(-1)))
    d = counted.groupBy(*cols).agg(F.sum("_d").alias("d")).where("d <> 0")
    return d.select(F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), *cols, F.abs("d").alias("n"))


def merge(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str] | None = None, right_order: list[str] | None = None, in_left: str | None = None, in_right: str | None = None, place: str | None = None) -> DataFrame:
    """Match-merge: the rows of a key are put side by side by their place in each table's order.

    Where one table has fewer rows of a key, its last row is carried on; where it has none, its columns are missing. A column of both
    is what the last table that still has a row of its own at that place says, the right one first. A missing key is a
    key. Without an order, rows of a key follow their other columns. ``in_left``, ``in_right``: columns of 1 or 0, whether
    that table has the key at all; ``place``: a column of the place in the key, from 0. Places are counted in a distributed order, so a key may have any number of rows.
    """
    sides = {}
    for name, df, order in (("l", left, left_order), ("r", right, right_order)):
        others = [c for c in df.columns if c not in keys]
        rows = placed(df, keys, order or others, "__at")
        one = rows.select(*[f"`{k}`" for k in keys], "__at", F.struct(F.lit(1).alias("__in"), *[F.col(f"`{c}`") for c in others]).alias(f"__{name}"))
        last = one.groupBy(*keys).agg(F.max_by(f"__{name}", "__at").alias(f"__last_{name}"))
        sides[name] = (others, one, last)
    out = join_same(sides["l"][1], sides["r"][1], [*keys, "__at"], "full_outer")
    out = join_same(join_same(out, sides["l"][2], keys, "left"), sides["r"][2], keys, "left")

    def value(c: str):
        own = [n for n in ("r", "l") if c in sides[n][0]]
        picked = F.when(F.col(f"__{own[0]}").isNotNull(), F.col(f"__{own[0]}").getField(c))
        for n in own[1:]:
            picked = picked.when(F.col(f"__{n}").isNotNull(), F.col(f"__{n}").getField(c))
        return picked.otherwise(F.col(f"__last_{own[0]}").getField(c)).alias(c)

    columns = [*sides["l"][0], *[c for c in sides["r"][0] if c not in sides["l"][0]]]
    flags = [F.col(f"__last_{n}").isNotNull().cast("int").alias(c) for n, c in (("l", in_left), ("r", in_right)) if c]
    at = [F.col("__at").alias(place)] if place else []
    return out.select(*[f"`{k}`" for k in keys], *map(value, columns), *flags, *at)


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed lookup: a left join with one row of the table for each key, the least by its other columns. Spark broadcasts the
    table if its size in bytes allows."""
    other = [c for c in table.columns if c not in keys]
    one = table.groupBy(*keys).agg(F.min(F.struct(*other)).alias("_own")).select(*keys, "_own.*")
    return df.join(one, keys, "left")


def replace_subset(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose keys ``new`` lacks, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
