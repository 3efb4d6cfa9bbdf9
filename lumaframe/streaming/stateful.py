"""State kept by key across a stream: Kalman tracks, background models, motion.

With ``forget`` a key's state is dropped when nothing has come for it for so many milliseconds; a stream with it runs
until it is stopped, as time alone makes new batches. Within a batch a key's rows are taken in order; rows that come in a
later batch than later ones are left out, as the state has passed them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import velocity_filter
from ..sources.files import new_folder

KALMAN = "track_id long, seq long, z double, position double, speed double"


def _ordered(order: str, out: dict[str, str], step: Callable, forget: int | None) -> Callable:
    """Runs ``step(state tuple or None, rows) -> (columns, state tuple)`` over a key's new rows in order; the state begins with the last row's place."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(order, kind="stable")
        if held is not None:
            rows = rows[rows[order] > held[0]]
        if len(rows):
            columns, rest = step(held, rows)
            state.update((int(rows[order].iloc[-1]), *rest))
            yield pd.DataFrame({next(iter(out)): key[0], order: rows[order].to_numpy(), **columns})[list(out)]
        if forget:
            state.setTimeoutDuration(forget)

    return run


def _stream(df: DataFrame, key: str, order: str, out: str, state: str, step: Callable, forget: int | None) -> DataFrame:
    names = {c.split()[0]: c.split()[1] for c in out.split(", ")}
    return df.groupBy(key).applyInPandasWithState(_ordered(order, names, step, forget), out, f"last long, {state}", "append", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)


def kalman_stream(measurements: DataFrame, forget: int | None = None) -> DataFrame:
    """Filtered (track_id, seq, z) of a stream."""

    def step(held: tuple | None, rows: pd.DataFrame):
        filt = velocity_filter()
        if held is not None:
            filt.x, filt.p = np.array(held[1]), np.array(held[2]).reshape(2, 2)
        xs = []
        for z in rows["z"]:
            filt.predict()
            xs.append(filt.update([z]).copy())
        return {"z": rows["z"].to_numpy(), "position": [x[0] for x in xs], "speed": [x[1] for x in xs]}, (filt.x.tolist(), filt.p.ravel().tolist())

    return _stream(measurements, "track_id", "seq", KALMAN, "x array<double>, p array<double>", step, forget)


def background_stream(frames: DataFrame, learning_rate: float = 0.05, threshold: float = 0.1, forget: int | None = None) -> DataFrame:
    """(video_id, index, foreground): number of foreground pixels of each gray frame, by a running mean."""

    def step(held: tuple | None, rows: pd.DataFrame):
        mean = np.array(held[1]) if held is not None else None
        out = []
        for data in rows["data"]:
            g = np.asarray(data, float)
            mean = g.copy() if mean is None else (1 - learning_rate) * mean + learning_rate * g
            out.append(int((np.abs(g - mean) > threshold).sum()))
        return {"foreground": out}, (mean.tolist(),)

    return _stream(frames, "video_id", "index", "video_id long, index long, foreground long", "mean array<double>", step, forget)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their values by time window and type, with a watermark for late data."""
    w = F.window("ts", width, slide or width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The table that a stream of what is there now writes: Parquet in the shared folder, beside its checkpoint."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")
    table = f"{folder}/table"
    out = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if mode == "append":
        out = out.format("parquet").option("path", table)
    else:  # each batch tells all rows anew
        out = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(table))
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)
