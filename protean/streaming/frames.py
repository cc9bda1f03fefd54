"""Structured Streaming over frames: the batch operators' one-pass twins.

Sources are any streaming DataFrame of (series, ts, value, ...); a watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(stream: DataFrame) -> DataFrame:
    """A watermark needs a timestamp with a zone."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def running_fluctuation(stream: DataFrame, keys=("series",)) -> DataFrame:
    """(keys, frames, mean, rmsf): three moments of state for each key. Complete or update mode."""
    return stream.groupBy(*keys).agg(F.count("value").alias("frames"), F.avg("value").alias("mean"), F.sqrt(F.var_pop("value")).alias("rmsf"))


def tumbling(stream: DataFrame, size: str, delay: str, keys=("event_type",)) -> DataFrame:
    """(start, end, keys, n, total) of windows that do not overlap; rows later than ``delay`` are left out."""
    w = _timed(stream).withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sliding(stream: DataFrame, size: str, step: str, delay: str, keys=("event_type",)) -> DataFrame:
    w = _timed(stream).withWatermark("ts", delay).groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, gap: str, delay: str, keys=("series",)) -> DataFrame:
    w = _timed(stream).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def unwrap(stream: DataFrame, period: float) -> DataFrame:
    """(series, frame, value): jumps of more than half a period undone; the state is one frame of each series.

    Frames of a series come in order, as a trajectory's do.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, image = state.get if state.exists else (None, 0.0)
        got = pd.concat(list(batches)).sort_values("frame")
        out = []
        for f, v in zip(got["frame"], got["value"], strict=True):
            if last is not None:
                image -= round((v - last) / period)
            last = v
            out.append((key[0], f, v + image * period))
        state.update((last, image))
        yield pd.DataFrame(out, columns=["series", "frame", "value"])

    return stream.groupBy("series").applyInPandasWithState(step, "series long, frame long, value double", "last double, image double", "append", GroupStateTimeout.NoTimeout)


def per_frame(stream: DataFrame, analyse, sink) -> object:
    """Runs ``sink(analyse(batch), batch_id)`` on each micro-batch of frames; a writer to start."""
    return stream.writeStream.foreachBatch(lambda df, i: sink(analyse(df), i))
