"""A sliding-window limiter and a circuit breaker over streams of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def limited(calls: DataFrame, key: str, ident: str, most: int, seconds: int) -> DataFrame:
    """Admission of a stream of calls (key, ident, ts), each micro-batch in order of time: key, ident, ok, wait. State: the admitted times."""
    kind = {f.name: f.dataType.simpleString() for f in calls.schema}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken: list[float] = list(state.get[0]) if state.exists else []
        g = pd.concat(list(parts)).sort_values(["us", ident], kind="stable")
        ok, wait = [], []
        for ts in g["us"] / 1e6:
            taken = [t for t in taken if t > ts - seconds]
            free = len(taken) < most
            ok.append(free)
            wait.append(0.0 if free else max(0.0, taken[0] + seconds - ts))
            if free:
                taken.append(ts)
        state.update((taken,))
        yield pd.DataFrame({key: g[key], ident: g[ident], "ok": ok, "wait": wait})

    df = calls.select(key, ident, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = f"{key} {kind[key]}, {ident} {kind[ident]}, ok boolean, wait double"
    return df.groupBy(key).applyInPandasWithState(step, out, "taken array<double>", "append", "NoTimeout")


def breaker(calls: DataFrame, key: str, ident: str, threshold: int) -> DataFrame:
    """After each batch of a stream of calls (key, ident, failed): key, failures in a row, tripped. A trip starts the count anew."""
    kind = {f.name: f.dataType.simpleString() for f in calls.schema}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for failed in pd.concat(list(parts)).sort_values(ident)["failed"]:
            n = n + 1 if failed else 0
        tripped = n >= threshold
        state.update((0 if tripped else n,))
        yield pd.DataFrame({key: [k[0]], "failures": [n], "tripped": [tripped]})

    return calls.select(key, ident, "failed").groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, failures long, tripped boolean", "n long", "append", "NoTimeout")


def windowed_rates(calls: DataFrame, key: str, minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """Calls and failures of each key in windows of minutes, closed by a watermark."""
    w = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")
    stamped = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(w, key).agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed")).select(F.col("window.start").alias("start"), key, "n", "n_failed")
