"""An extension: running BY-group state over a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def running_totals(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value, running_sum, running_max) of each row in arrival batches; state is two numbers for each key.

    Rows of one micro-batch are taken in ``order``; a missing value adds nothing. Needs append mode.
    """

    def step(k, frames, state):
        total, top = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(order)
        v = rows["v"].fillna(0.0)
        rows["running_sum"] = total + v.cumsum()
        rows["running_max"] = v.cummax().clip(lower=top)
        if len(rows):
            state.update((float(rows["running_sum"].iloc[-1]), float(rows["running_max"].iloc[-1])))
        yield rows[["k", "o", "v", "running_sum", "running_max"]]

    rows = stream.selectExpr(f"cast(`{key}` as string) k", f"cast(`{order}` as timestamp) o", f"cast(`{value}` as double) v")
    order = "o"
    return rows.groupBy("k").applyInPandasWithState(step, "k string, o timestamp, v double, running_sum double, running_max double", "total double, top double", "append", "NoTimeout")
