"""Kalman tracks of a stream whose rows come in any order, by state with timers, time-to-live and an initial state.

A track's rows are filtered in the order of their numbers. A row that comes before its turn waits in a list state until the rows before it have
come; with ``patience``, a timer lets all waiting rows go on without them after so many milliseconds. Rows whose turn is over (repeated ones,
or ones that the timer has passed) are not lost: they leave by a second output, ``late``. With ``ttl``, states of silent tracks are forgotten after so many milliseconds.
A stream with either runs until it is stopped, as time alone makes new batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import velocity_filter, velocity_step

OUT = "track_id long, seq long, z double, position double, speed double, late boolean"
STATE = "last long, x array<double>, p array<double>"
#: Waiting rows of a batch are one entry, or several of at most ``ENTRY`` rows.
WAITING = "seqs array<long>, zs array<double>"
ENTRY = 10_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedKalman(StatefulProcessor):
    def __init__(self, patience: int | None, ttl: int | None, first: int):
        self.patience, self.ttl, self.first = patience, ttl, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("filter", STATE, self.ttl)
        self.waiting = handle.getListState("waiting", WAITING, self.ttl)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        r = initialState
        self.state.update((int(r["last"]), [float(v) for v in r["x"]], [float(v) for v in r["p"]]))

    def _held(self) -> tuple:
        held = self.state.get()
        if held is not None:
            return held
        k = velocity_filter()
        return (self.first - 1, k.x.tolist(), k.p.ravel().tolist())

    def _filtered(self, key: tuple, rows: list[tuple[int, float]], held: tuple, all_: bool) -> tuple[list[Row], list[tuple[int, float]]]:
        """Results of the rows whose turn it is, and the rows that wait on; ``all_`` passes over gaps."""
        last, x, p = held
        out, left, step = [], [], velocity_step(x, p)
        for seq, z in sorted(rows):
            if seq <= last:
                out.append(Row(track_id=key[0], seq=seq, z=z, position=None, speed=None, late=True))
            elif all_ or seq == last + 1:
                position, speed = step(z)
                out.append(Row(track_id=key[0], seq=seq, z=z, position=position, speed=speed, late=False))
                last = seq
            else:
                left.append((seq, z))
        if last != held[0]:
            self.state.update((last, *step()))
        return out, left

    def _waiting(self) -> list[tuple[int, float]]:
        return [r for seqs, zs in self.waiting.get() for r in zip(seqs, zs, strict=True)]

    @staticmethod
    def _entries(rows: list[tuple[int, float]]) -> list[tuple[list[int], list[float]]]:
        return [tuple(map(list, zip(*rows[k : k + ENTRY], strict=True))) for k in range(0, len(rows), ENTRY)]

    def _wait(self, left: list[tuple[int, float]], before: bool) -> None:
        if left:
            self.waiting.put(self._entries(left))
        elif before:
            self.waiting.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r["seq"], r["z"]) for r in rows]
        held = self._held()
        if self.ttl is not None or any(seq == held[0] + 1 for seq, _ in new):  # writing all anew puts off their end
            waiting = self._waiting()
            out, left = self._filtered(key, [*new, *waiting], held, False)
            self._wait(left, bool(waiting))
        else:  # no waiting row's turn has come, so that they stay as they are
            out, left = self._filtered(key, new, held, False)
            if left:
                self.waiting.appendList(self._entries(left))
        if self.patience is not None:
            timers = list(self.handle.listTimers())
            if left and not timers:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
            elif not left and not self.waiting.exists():
                for t in timers:
                    self.handle.deleteTimer(t)
        yield from out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        out, left = self._filtered(key, self._waiting(), self._held(), True)
        self._wait(left, True)
        yield from out

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Streams with timers and lists need the state store on local disks with checkpoints in the shared folder."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "") != PROVIDER:
        spark.conf.set(key, PROVIDER)


def ordered_kalman(measurements: DataFrame, patience: int | None = None, ttl: int | None = None, first: int = 1, initial: DataFrame | None = None) -> DataFrame:
    """(track_id, seq, z, position, speed, late) of a stream of (track_id, seq, z); tracks begin with number ``first``.

    ``initial`` holds the states (track_id, last, x, p) of tracks that go on from an earlier run.
    """
    use_state_store(measurements.sparkSession)
    rows = measurements.filter("track_id IS NOT NULL AND seq IS NOT NULL AND z IS NOT NULL").select("track_id", F.col("seq").cast("long").alias("seq"), F.col("z").cast("double").alias("z"))
    start = initial.groupBy("track_id") if initial is not None else None
    return rows.groupBy("track_id").transformWithState(OrderedKalman(patience, ttl, first), OUT, "Append", "None" if patience is None and ttl is None else "ProcessingTime", start)


def on_time(results: DataFrame) -> DataFrame:
    return results.filter("NOT late").drop("late")


def late(results: DataFrame) -> DataFrame:
    """The second output: rows whose turn was over when they came."""
    return results.filter("late").select("track_id", "seq", "z")


def states(results: DataFrame) -> DataFrame:
    """Where tracks stand after the rows of a finished run: (track_id, last), to be joined with a filter's state."""
    return on_time(results).groupBy("track_id").agg(F.max("seq").alias("last"))
