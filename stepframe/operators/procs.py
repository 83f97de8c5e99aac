"""Summaries and frequency tables by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATISTICS = {"n": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def _aggregates(var: str, stats: dict):
    """A statistic is of ``var``, or, as (statistic, variable), of another."""
    return [STATISTICS[s](F.col(v)).alias(name) for name, (s, v) in ((n, (x, var) if isinstance(x, str) else x) for n, x in stats.items())]


def means(df: DataFrame, classes: list[str], var: str, stats: dict[str, str], missing: bool = False, types: bool = True) -> DataFrame:
    """One row for each class combination: _type_, _freq_ (rows) and statistics (new column -> statistic).

    n counts rows whose variable isn't missing. Rows with a missing class are left out unless ``missing``.
    """
    rows = df if missing or not classes else df.dropna(subset=classes)
    out = rows.groupBy(*classes).agg(F.lit(2 ** len(classes) - 1).alias("_type_"), F.count("*").alias("_freq_"), *_aggregates(var, stats))
    return out if types else out.drop("_type_", "_freq_")


def means_all(df: DataFrame, classes: list[str], var: str, stats: dict[str, str], missing: bool = False) -> DataFrame:
    """One row for each combination of each subset of classes; _type_ has a bit for each class that is used."""
    rows = df if missing else df.dropna(subset=classes)
    return rows.cube(*classes).agg((F.lit(2 ** len(classes) - 1) - F.grouping_id()).cast("int").alias("_type_"), F.count("*").alias("_freq_"), *_aggregates(var, stats))


def freq(df: DataFrame, columns: list[str], missing: bool = False) -> DataFrame:
    """count and percent of all counted rows for each combination. The total is taken over the grouped rows, whose shuffle both
    uses share."""
    rows = df if missing else df.dropna(subset=columns)
    counted = rows.groupBy(*columns).agg(F.count("*").alias("count"))
    total = counted.agg(F.sum("count").alias("_all"))
    return counted.crossJoin(F.broadcast(total)).select(*columns, "count", (100 * F.col("count") / F.col("_all")).alias("percent"))


def summarize(df: DataFrame, classes: list[str], var: str) -> DataFrame:
    """n, total and avg of a variable by class."""
    return means(df, classes, var, {"n": "n", "total": "sum", "avg": "mean"}, types=False)


def flag_high(df: DataFrame, var: str, threshold) -> DataFrame:
    from ..functions.expr import flag

    return df.withColumn("high_flag", flag(F.col(var) > threshold))
