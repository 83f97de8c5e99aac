"""Lookup of values in many, possibly overlapping, bands without a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import placed

#: Levels of the tree over places; 2^62 bounds are more than any table has.
LEVELS = 62


def _on_tree(df: DataFrame, value: str, bands: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """(p, l, node) of the distinct values, and (l, node, *carried) of ``bands`` (__lo, __hi, *carried): a value lies in exactly those bands that it shares a node with.

    All distinct values and bounds get their places in one sorted, distributed order. A band is a run of places, cut into
    the few whole nodes of a binary tree over places that make it up; a value lies in one node of each level that has such nodes.
    """
    values = df.where(F.col(f"`{value}`").isNotNull()).select(F.col(f"`{value}`").cast("double").alias("p")).distinct()
    # Sorted places are small as files and large as rows, so they are not to be broadcast by the size of their files.
    places = placed(values.union(bands.select("__lo")).union(bands.select("__hi")).distinct(), [], ["p"], "at").hint("merge")
    ends = bands.join(places.select(F.col("p").alias("__lo"), F.col("at").alias("a")).hint("merge"), "__lo").join(places.select(F.col("p").alias("__hi"), F.col("at").alias("b")).hint("merge"), "__hi")
    # At level l a run [a, b) of places is [ceil(a / 2^l), floor(b / 2^l)); its odd ends are nodes that no higher one covers.
    highest = F.least(F.lit(LEVELS), F.floor(F.log2((F.col("b") - F.col("a")).cast("double"))).cast("int") + 1)
    runs = ends.select(*carried, "a", "b", F.explode(F.sequence(F.lit(0), highest)).alias("l")).where("shiftleft(1L, l) <= b - a").select(*carried, "l", F.expr("shiftright(a + shiftleft(1L, l) - 1, l)").alias("x"), F.expr("shiftright(b, l)").alias("y")).where("x < y")
    nodes = runs.select("l", F.explode(F.filter(F.array(F.when(F.col("x") % 2 == 1, F.col("x")), F.when(F.col("y") % 2 == 1, F.col("y") - 1)), lambda n: n.isNotNull())).alias("node"), *carried)
    levels = nodes.agg(F.collect_set("l").alias("l")).scalar()  # at most LEVELS
    reached = values.join(places, "p").withColumn("l", F.explode(levels)).select("p", "l", F.expr("shiftright(at, l)").alias("node"))
    return reached, nodes


def _bounds(low: str, high: str) -> list[Column]:
    lo = F.coalesce(F.col(f"`{low}`").cast("double"), F.lit(float("-inf")))
    return [lo.alias("__lo"), F.coalesce(F.col(f"`{high}`").cast("double"), F.lit(float("nan"))).alias("__hi")]  # after every number, as Spark orders it


def band_lookup(df: DataFrame, value: str, bands: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Left join to every band with low <= value < high; a missing bound is open, a missing value meets no band.

    Each distinct value meets its bands by an equi-join on the nodes of a tree, and rows meet them by their value: work grows with rows, bands
    (times the logarithm of their number) and matches. Bands with low >= high match nothing. Where only a number or an extreme of
    a row's bands is asked for, ``band_summary`` gives it without the matches.
    """
    keyed = bands.select(F.struct(*[F.col(f"`{c}`") for c in bands.columns]).alias("__band"), *_bounds(low, high)).where("__lo < __hi")
    reached, nodes = _on_tree(df, value, keyed, ["__band"])
    matches = reached.join(nodes, ["l", "node"]).select(F.col("p").alias("__p"), "__band")
    out = df.join(matches, F.col(f"`{value}`").cast("double") == F.col("__p"), "left")
    return out.select(*[f"`{c}`" for c in df.columns], *[F.col("__band").getField(c).alias(c) for c in bands.columns])


def band_summary(df: DataFrame, value: str, bands: DataFrame, band: str, low: str = "low", high: str = "high") -> DataFrame:
    """The rows with ``n_bands`` and ``first_band``: how many bands ``band_lookup`` joins to a row (null ``band`` not counted), and the least ``band`` of them.

    Bands of the same bounds are summed to one, then those of each node, before a value adds up its nodes. So no match is made a row: work
    grows with rows and bands, times the logarithm of bands, however many bands a value lies in.
    """

    def summed(rows, *by):
        return rows.groupBy(*by).agg(F.sum("__n").alias("__n"), F.min("__first").alias("__first"))

    keyed = bands.select(*_bounds(low, high), F.when(F.col(f"`{band}`").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("__n"), F.col(f"`{band}`").alias("__first")).where("__lo < __hi")
    reached, nodes = _on_tree(df, value, summed(keyed, "__lo", "__hi"), ["__n", "__first"])
    found = summed(reached.join(summed(nodes, "l", "node").hint("merge"), ["l", "node"]), "p").hint("merge")
    out = df.join(found, F.col(f"`{value}`").cast("double") == F.col("p"), "left")
    return out.select(*[f"`{c}`" for c in df.columns], F.coalesce("__n", F.lit(0).cast("long")).alias("n_bands"), F.col("__first").alias("first_band"))
