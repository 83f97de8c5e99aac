"""Regression, double-exponential forecasts and agreement."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import join_same, placed


def ols(df: DataFrame, target: str, regressors: list[str]) -> DataFrame:
    """One row: intercept, a coefficient for each regressor, _rmse_ = sqrt(SSE / (n - k - 1)).

    Rows with a missing value are left out. One aggregation of means and co-moments, which merge in parallel without loss
    of precision; the driver solves the (k x k) system of that single row.
    """
    names = [target, *regressors]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    k = len(regressors)
    pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
    r = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    schema = ", ".join(f"`{c}` double" for c in ("intercept", *regressors, "_rmse_"))
    if r.n <= k + 1:
        return df.sparkSession.createDataFrame([(None,) * (k + 2)], schema)
    c = np.zeros((k + 1, k + 1))
    for i, j in pairs:
        c[i, j] = c[j, i] = r[f"c{i}_{j}"]
    slope = np.linalg.lstsq(c[1:, 1:], c[1:, 0], rcond=None)[0]
    intercept = r.m0 - sum(b * r[f"m{i + 1}"] for i, b in enumerate(slope))
    sse = max(0.0, r.n * (c[0, 0] - slope @ c[1:, 0]))
    return df.sparkSession.createDataFrame([(float(intercept), *map(float, slope), float((sse / (r.n - k - 1)) ** 0.5))], schema)


@dataclass(frozen=True)
class Forecast:
    """``rows``: by, t, y and the one-step forecast ``fitted``; ``states``: by, the last t, s1, s2, constant, linear; months ahead."""

    rows: DataFrame
    states: DataFrame
    lead: int


#: Steps of a series that are gone through in one expression.
FAN = 256
#: Steps of a series that meet its end together.
STRETCH = 65536


def _scan(items: DataFrame, by: list[str], start: DataFrame, longest: int, weight: float) -> DataFrame:
    """Adds s1 and s2, the state before each item, to items (by, i, n, v1, v2, data): i from 0 without gaps in each series.

    An item stands for n steps: from state s it makes A^n s + v, where A is the matrix of one step. Items of a stretch of FAN
    combine to one such item, since the composition of affine maps is one; stretches are scanned in the same way until one stretch is left, then
    each is gone through from the state that it starts with. So a series of any length is spread over tasks, in time linear in its rows.
    """
    w, b = weight, 1 - weight

    def step(s1, s2, x):
        p = F.pow(F.lit(b), x["n"])
        return p * s1 + x["v1"], p * s2 + x["n"] * w * p * s1 + x["v2"]

    item = F.struct("i", "n", "v1", "v2", "data")
    if longest <= FAN:
        stretches = join_same(items.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("x")), start, by) if by else items.agg(F.sort_array(F.collect_list(item)).alias("x")).crossJoin(F.broadcast(start))
    else:
        stretches = items.groupBy(*by, F.floor(F.col("i") / FAN).alias("k")).agg(F.sort_array(F.collect_list(item)).alias("x"))

        def add(a, x):
            v1, v2 = step(a["v1"], a["v2"], x)
            return F.struct((a["n"] + x["n"]).alias("n"), v1.alias("v1"), v2.alias("v2"))

        whole = F.aggregate("x", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("v1"), F.lit(0.0).alias("v2")), add)
        above = stretches.select(*by, F.col("k").alias("i"), whole.alias("m")).select(*by, "i", "m.n", "m.v1", "m.v2", F.lit(None).cast("int").alias("data"))
        states = _scan(above, by, start, -(-longest // FAN), weight).select(*by, F.col("i").alias("k"), "s1", "s2")
        stretches = join_same(stretches, states, [*by, "k"])

    def go(a, x):
        s1, s2 = step(a["s1"], a["s2"], x)
        seen = F.array_append(a["seen"], F.struct(x["i"].alias("i"), x["n"].alias("n"), x["v1"].alias("v1"), x["v2"].alias("v2"), x["data"].alias("data"), a["s1"].alias("s1"), a["s2"].alias("s2")))
        return F.struct(s1.alias("s1"), s2.alias("s2"), seen.alias("seen"))

    kind = items.schema["data"].dataType.simpleString()
    none = F.array().cast(f"array<struct<i:bigint,n:bigint,v1:double,v2:double,data:{kind},s1:double,s2:double>>")
    return stretches.select(*by, F.explode(F.aggregate("x", F.struct("s1", "s2", none.alias("seen")), go)["seen"]).alias("x")).select(*by, "x.*")


def brown(df: DataFrame, time: str, value: str, by: list[str] | None = None, weight: float = 0.2, nstart: int = 12, lead: int = 12) -> Forecast:
    """Brown's double-exponential smoothing of each series in order of time.

    Start values come from a regression on the first ``nstart`` points (a single point has slope 0). Points of equal time follow
    their value; a missing value is left out, as is its time. One series may have any number of points, see ``_scan``.
    """
    if not 0 < weight < 1:
        raise ValueError("weight must lie between 0 and 1")
    # Names of the keys can't clash with those of the work.
    named, by = by or [], [f"_by{n}" for n, _ in enumerate(by or [])]
    w, b = weight, 1 - weight
    rows = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(named, by, strict=True)], F.col(time).alias("t"), F.col(value).cast("double").alias("y")).where("y is not null")
    rows = placed(rows, by, ["t", "y"], "i")
    i = F.col("i") + 1
    first = rows.where(F.col("i") < nstart).groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("sy"), F.sum(i * F.col("y")).alias("sty"), F.sum(i).cast("double").alias("st"), F.sum(i * i).cast("double").alias("stt"))
    slope = F.coalesce(F.try_divide(F.col("n") * F.col("sty") - F.col("st") * F.col("sy"), F.col("n") * F.col("stt") - F.col("st") * F.col("st")), F.lit(0.0))
    level = F.col("sy") / F.col("n") - F.col("slope") * (F.col("st") / F.col("n"))
    start = first.withColumn("slope", slope).withColumn("level", level).where("n > 0").select(*by, (F.col("level") - b / w * F.col("slope")).alias("s1"), (F.col("level") - 2 * b / w * F.col("slope")).alias("s2"))
    items = rows.select(*by, "i", F.lit(1).cast("long").alias("n"), (w * F.col("y")).alias("v1"), (w * w * F.col("y")).alias("v2"), F.struct("t", "y").alias("data"))
    longest = rows.agg(F.max("i")).first()[0]
    seen = _scan(items, by, start, (longest or 0) + 1, weight)
    trend = w / b * (F.col("s1") - F.col("s2"))
    back = [F.col(k).alias(c) for c, k in zip(named, by, strict=True)]
    fitted = seen.select(*back, F.col("data.t").alias("t"), F.col("data.y").alias("y"), (2 * F.col("s1") - F.col("s2") + trend).alias("fitted"))
    # The state after all N points needs no state on the way: it is A^N s + the sum of A^(N - 1 - i) times what point i adds.
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("t").alias("last"))
    # A long series meets its end in stretches, so no task has it whole.
    stretch = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH))).alias("k")
    whole = join_same(rows.withColumn("k", F.floor(F.col("i") / STRETCH)), ends.select("*", stretch), [*by, "k"]).withColumn("left", F.col("n") - 1 - F.col("i"))
    power = F.pow(F.lit(b), F.col("left"))
    parts = whole.groupBy(*by, "k").agg(F.first("n").alias("n"), F.first("last").alias("last"), F.sum(w * power * F.col("y")).alias("v1"), F.sum(w * w * (F.col("left") + 1) * power * F.col("y")).alias("v2"))
    added = parts.groupBy(*by).agg(F.first("n").alias("n"), F.first("last").alias("last"), F.sum("v1").alias("v1"), F.sum("v2").alias("v2"))
    both = join_same(added, start, by) if by else added.crossJoin(F.broadcast(start))
    power = F.pow(F.lit(b), F.col("n"))
    last = both.where("n > 0").select(*by, F.struct("last", (power * F.col("s1") + F.col("v1")).alias("s1"), (power * F.col("s2") + F.col("n") * w * power * F.col("s1") + F.col("v2")).alias("s2")).alias("e"))
    states = last.select(*back, "e.last", "e.s1", "e.s2").withColumns({"constant": 2 * F.col("s1") - F.col("s2"), "linear": trend})
    return Forecast(fitted, states, lead)


def forecast_rows(fitted: Forecast, by: list[str] | None = None) -> DataFrame:
    """(month, _type_, _lead_, y): ACTUAL and one-step FORECAST rows of the history, and the months after its last."""
    by = by or []

    def row(month, kind, ahead, y):
        return F.struct(month.alias("month"), F.lit(kind).alias("_type_"), ahead.cast("int").alias("_lead_"), y.alias("y"))

    both = F.array(row(F.col("t"), "ACTUAL", F.lit(0), F.col("y")), row(F.col("t"), "FORECAST", F.lit(1), F.col("fitted")))
    past = fitted.rows.select(*by, F.explode(both).alias("x")).select(*by, "x.*")
    ahead = fitted.states.select(*by, "last", "constant", "linear", F.explode(F.sequence(F.lit(1), F.lit(fitted.lead))).alias("_ahead"))
    ahead = ahead.select(*by, F.add_months(F.col("last"), F.col("_ahead")).alias("month"), F.lit("FORECAST").alias("_type_"), F.col("_ahead").cast("int").alias("_lead_"), (F.col("constant") + F.col("linear") * F.col("_ahead")).alias("y"))
    return past.unionByName(ahead)


def forecast_states(fitted: Forecast, by: list[str] | None = None) -> DataFrame:
    """(_type_, value): S1, S2, CONSTANT, LINEAR."""
    by = by or []
    return fitted.states.select(*by, F.expr("stack(4, 'S1', s1, 'S2', s2, 'CONSTANT', constant, 'LINEAR', linear) as (_type_, value)"))


def kappa(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, agreement in percent and Cohen's kappa (3 places; missing where both have a single label)."""
    by = by or []
    joint = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = joint.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    left = joint.groupBy(*by, F.col(a).alias("label")).agg(F.sum("n").alias("na"))
    right = joint.groupBy(*by, F.col(b).alias("label")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"))
    both = total.join(chance, by, "left") if by else total.crossJoin(F.broadcast(chance))
    po, pe = F.col("same") / F.col("total"), F.coalesce("chance", F.lit(0.0)) / (F.col("total").cast("double") * F.col("total"))
    return both.select(*by, F.col("total").alias("n"), F.round(100 * po, 1).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 3).alias("kappa"))
