"""Scorecards, measures, pivots and date tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import join_same


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row for each day: date, year, month, month_start, label."""
    return _dated(spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 day)) AS date"))


def _dated(d: DataFrame) -> DataFrame:
    return d.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.trunc("date", "MM").alias("month_start"), F.date_format("date", "yyyy-MM").alias("label"))


def calendar_of(df: DataFrame, day: str) -> DataFrame:
    """The calendar from the first to the last day of a column; empty if it has none."""
    span = df.agg(F.min(F.col(day).cast("date")).alias("a"), F.max(F.col(day).cast("date")).alias("b"))
    return _dated(span.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("date")))


def grid(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row for each ``row``, one column for each listed value."""
    return df.groupBy(row).pivot(column, columns).agg(F.max(value))


def accuracy(df: DataFrame, by: list[str], correct: str) -> DataFrame:
    return df.groupBy(*by).agg(F.round(100 * F.avg(F.col(correct).cast("double")), 1).alias("accuracy"))


def pairs(df: DataFrame, item: str, method: str, label: str) -> DataFrame:
    """Each unordered pair of methods on each item: method_a < method_b, label_a, label_b. Equi-join on the item."""
    a = df.select(item, F.col(method).alias("method_a"), F.col(label).alias("label_a"))
    b = df.select(item, F.col(method).alias("method_b"), F.col(label).alias("label_b"))
    return a.join(b, item).where("method_a < method_b")


def scorecard(status: DataFrame, attempts: DataFrame, checks: DataFrame) -> DataFrame:
    """Per method and run: programs by final status, first attempts and repairs, checks a/b, minutes, cost."""
    key = ["method", "run"]
    s = status.groupBy(*key).agg(
        F.count("*").alias("programs"), F.count_if(F.col("final_status") == "VALIDATED").alias("validated"),
        F.count_if((F.col("final_status") == "VALIDATED") & (F.col("attempts") <= 1)).alias("validated_first_attempt"),
        F.count_if((F.col("final_status") == "VALIDATED") & (F.col("attempts") > 1)).alias("validated_after_repair"),
        F.count_if(F.col("final_status") == "MANUAL_REVIEW").alias("manual_review"), F.count_if(F.col("final_status") == "NOT_SUPPORTED").alias("not_supported"),
    )
    c = checks.groupBy(*key).agg(F.count_if("passed").alias("_p"), F.count("*").alias("_n"), F.count_if(F.col("passed") & F.startswith("check", F.lit("planted_"))).alias("_tp"), F.count_if(F.startswith("check", F.lit("planted_"))).alias("_tn"))
    a = attempts.groupBy(*key).agg(F.count_if(F.col("model") != "rules").alias("_calls"), F.round(F.sum("latency_s") / 60, 1).alias("_min"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0))), 3).alias("_cost"))
    out = s.join(c, key, "left").join(a, key, "left").fillna(0, ["_p", "_n", "_tp", "_tn", "_calls", "_min", "_cost"])
    return out.select(*s.columns, F.concat_ws("/", "_p", "_n").alias("checks_passed"), F.concat_ws("/", "_tp", "_tn").alias("planted_traps_passed"), F.col("_calls").alias("llm_calls"), F.col("_min").alias("minutes"), F.col("_cost").alias("cost_usd"))


def rate(numerator, denominator):
    """A ratio that is missing where the denominator is 0."""
    return F.try_divide(numerator, denominator)


def filtered_rate(df: DataFrame, by: list[str], part, whole=None, whole_over_all: bool = False) -> DataFrame:
    """Rows meeting ``part`` over rows meeting ``whole``, by group; the denominator over all groups if asked for."""
    test = whole if whole is not None else F.lit(True)
    g = df.groupBy(*by).agg(F.count_if(part & test).alias("part"), F.count_if(test).alias("whole"))
    if whole_over_all:
        g = g.drop("whole").crossJoin(F.broadcast(g.agg(F.sum("whole").alias("whole"))))
    return g.withColumn("rate", rate(F.col("part"), F.col("whole")))


def measures(status: DataFrame, checks: DataFrame, migration: DataFrame, attempts: DataFrame, forecast: DataFrame, payments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The nine measures of the report, in one row, or for each ``by`` (columns of status, checks and attempts; the other tables have no such columns,
    so their measures are the same in every row).

    Counts are 0 and ratios missing where there is nothing. ``traps_passed_rate`` divides planted checks that passed by the
    distinct planted checks of all groups, and is 0 where there are none passed.
    """
    by = by or []
    planted = F.col("planted") == 1
    s = status.groupBy(*by).agg(F.count_if(F.col("final_status") == "VALIDATED").alias("validated"), F.count_if(F.col("final_status") == "MANUAL_REVIEW").alias("manual_review"), F.count("*").alias("_n"))
    s = s.select(*by, "validated", "manual_review", rate(F.col("validated"), F.col("_n")).alias("validation_rate"))
    c = checks.groupBy(*by).agg(rate(F.sum("passed"), F.count("*")).alias("checks_passed_rate"), F.sum(F.when(planted, F.col("passed")).otherwise(0)).alias("_traps"))
    a = attempts.groupBy(*by).agg(F.sum("cost_usd").alias("conversion_cost"))
    alone = [
        checks.agg(F.countDistinct(F.when(planted, F.col("check"))).alias("_all_traps")),
        migration.where("expected_to_pass = 1").agg(rate(F.sum("passed"), F.count("*")).alias("migration_checks_passed_rate")),
        forecast.agg(F.max("abs_diff").alias("max_forecast_diff")),
        payments.agg(F.avg("delinquent_flag").alias("late_payment_rate")),
    ]
    out = join_same(join_same(s, c, by, "left"), a, by, "left") if by else s.crossJoin(c).crossJoin(a)  # one row each
    for x in alone:
        out = out.crossJoin(F.broadcast(x))  # one row
    traps = F.coalesce(rate(F.col("_traps"), F.col("_all_traps")), F.lit(0.0)).alias("traps_passed_rate")
    return out.select(*by, "validated", "validation_rate", "checks_passed_rate", "migration_checks_passed_rate", "conversion_cost", "max_forecast_diff", "late_payment_rate", "manual_review", traps)
