"""Sessions of a stream that close on time, by event-time timers.

Sessions with neighbouring ids share a block: one value in the state store, with their
settings and their counts by second, of those seconds that can still lie before a close.
A batch reads and writes the value of a block once, however many of its sessions it brings
rows of, and a block holds at most ``SESSIONS`` of them, so one batch costs what it brings
and not what came before. The timer of a block stands at the earliest close among its open
sessions. A session closes when the watermark passes its deadline, also if nothing more
arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from casebook import fixed_values as V
from casebook.operators.sessions import time_limit_seconds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"

CLOSED = "session_id bigint, closed_s bigint, reason string, actions_kept bigint, rounds_completed bigint, time_remaining bigint"
#: What the processor returns: numbers and flags only, as text columns differ between versions of pandas.
NUMBERS = {"session_id": "int64", "closed_s": "int64", "ended": "bool", "actions_kept": "int64", "rounds_completed": "int64", "time_remaining": "int64"}
NUMBERS_SCHEMA = ", ".join(f"{c} {'boolean' if kind == 'bool' else 'bigint'}" for c, kind in NUMBERS.items())
#: Ids in a block: a power of two, at most 256.
SESSIONS = 64
#: ``due`` is the second of the timer, -1 without one. A session goes by its place in the
#: block: ``closed`` has a byte for each closed one, ``settings`` and ``seconds`` have rows
#: of whole numbers for the open ones.
STATE = "due bigint, closed binary, settings binary, seconds binary"
#: Place, limit, whether pauses are enabled.
SETTINGS = 3
#: Place, second, then by second all actions, user messages, ends, pauses asked for; in order, no second twice.
SECONDS = 6
KINDS = ("user_message", "end", "pause")


def accepted(asked: list[int], enabled: bool) -> list[int]:
    """Seconds of the pauses that count: in order, none while one runs, at most three."""
    out: list[int] = []
    for t in asked if enabled else []:
        if len(out) < V.MAX_PAUSES and (not out or t >= out[-1] + V.PAUSE_SECONDS):
            out.append(t)
    return out


def deadline(start: int, limit: int, pauses: list[int]) -> int:
    """The start plus the limit, moved by each pause that begins before it."""
    at = start + limit
    for t in pauses:
        at += V.PAUSE_SECONDS if t < at else 0
    return at


def _table(numbers: bytes, width: int) -> np.ndarray:
    return np.frombuffer(bytes(numbers), np.int64).reshape(-1, width)


def by_second(rows: np.ndarray) -> np.ndarray:
    """Rows of ``seconds`` in order, those of the same second summed."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][: len(rows)])
    return np.concatenate([rows[starts, :2], np.add.reduceat(rows[:, 2:], starts, axis=0)], axis=1) if len(rows) else rows


def reachable(rows: np.ndarray, limit: int) -> np.ndarray:
    """Of a session's rows those that a close can reach, whatever pauses and earlier rows may come."""
    return rows[rows[:, 1] <= rows[0, 1] + max(limit, 0) + V.MAX_PAUSES * V.PAUSE_SECONDS]


def closes(rows: np.ndarray, limit: int, enabled: bool) -> tuple[int, int, bool]:
    """(deadline, close, whether by an end) of a session by the rows known so far."""
    at = deadline(int(rows[0, 1]), limit, accepted(rows[rows[:, 5] > 0, 1].tolist(), enabled))
    ends = rows[rows[:, 4] > 0, 1]
    if len(ends) and ends[0] <= at:
        return at, int(ends[0]), True
    return at, at, False


def _sessions(settings: np.ndarray, seconds: np.ndarray) -> Iterator[tuple[int, int, bool, np.ndarray]]:
    """Place, limit, whether pauses are enabled, and rows of each open session."""
    starts = np.searchsorted(seconds[:, 0], settings[:, 0])
    ends = np.searchsorted(seconds[:, 0], settings[:, 0], side="right")
    for (place, limit, enabled), lo, hi in zip(settings.tolist(), starts, ends, strict=True):
        yield place, limit, bool(enabled), seconds[lo:hi]


class Closing(StatefulProcessor):
    """Keeps the seconds of a block's open sessions, and closes each at its end or deadline once the watermark is past it.

    Input rows carry a second (offset_s), what was done then, and the session's settings.
    A session closed once stays closed: later rows of it change nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        due, closed, settings, seconds = self.block.get() or (-1, b"", b"", b"")
        closed = bytes(closed)
        settings, seconds, came = _table(settings, SETTINGS), _table(seconds, SECONDS), False
        for part in rows:
            place = part["session_id"].to_numpy(np.int64) % SESSIONS
            part = part[part["offset_s"].notna().to_numpy() & ~np.isin(place, np.frombuffer(closed, np.uint8))]
            if not len(part):
                continue
            place, came = part["session_id"].to_numpy(np.int64) % SESSIONS, True
            ones = np.ones(len(part), np.int64)
            new = [place, part["offset_s"], ones, *(part["kind"] == n for n in range(len(KINDS)))]
            seconds = by_second(np.concatenate([seconds, np.stack([np.asarray(c, np.int64) for c in new], axis=1)]))
            # The settings that came first stay.
            named = np.stack([np.asarray(c, np.int64) for c in (place, part["limit_s"], part["pause_enabled"])], axis=1)
            settings = np.concatenate([settings, named])
            settings = settings[np.unique(settings[:, 0], return_index=True)[1]]
        if came:
            self._keep(due, closed, settings, seconds)
        yield from ()

    def _keep(self, due: int, closed: bytes, settings: np.ndarray, seconds: np.ndarray) -> None:
        """Write what is known of the open sessions, and set the timer."""
        kept = [(reachable(own, limit), limit, enabled) for _, limit, enabled, own in _sessions(settings, seconds)]
        # Past the close, so that every action of that second is there.
        close = min((closes(*session)[1] for session in kept), default=-1)
        if close != due:
            if due >= 0:
                self.handle.deleteTimer(due * 1000)
            if kept:
                self.handle.registerTimer(close * 1000)
        seconds = np.concatenate([own for own, _, _ in kept]) if kept else seconds[:0]
        self.block.update((close, closed, settings.tobytes(), seconds.tobytes()))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, closed, settings, seconds = self.block.get()
        if expiredTimerInfo.getExpiryTimeInMs() != due * 1000:
            return
        settings, seconds, out, past = _table(settings, SETTINGS), _table(seconds, SECONDS), [], []
        for place, limit, enabled, own in _sessions(settings, seconds):
            at, close, ended = closes(own, limit, enabled)
            if close * 1000 <= timerValues.getCurrentWatermarkInMs():
                n, users = own[own[:, 1] <= close, 2:4].sum(axis=0).tolist()
                out.append((key[0] * SESSIONS + place, close, ended, n, min(1 + users, V.TOTAL_ROUNDS), at - close))
                past.append(place)
        # The engine removes the timer that has run out.
        still = ~np.isin(settings[:, 0], past), ~np.isin(seconds[:, 0], past)
        self._keep(-1, bytes(closed) + bytes(past), settings[still[0]], seconds[still[1]])
        yield pd.DataFrame(out, columns=list(NUMBERS)).astype(NUMBERS)

    def close(self) -> None:
        pass


def start_limits(actions: DataFrame, settings: DataFrame, folder: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Write each session of a stream ``actions(session_id, ts, offset_s, kind)`` when it closes.

    ``offset_s`` are whole seconds since the epoch of ``ts``, above 0, on which the timers run;
    ``settings(session_id, time_limit_min, pause_enabled)`` is a table. Rows that come
    more than ``delay`` behind the latest event are late: they are dropped before they
    reach the state, as the watermark has passed them. The state of open sessions is in
    RocksDB, and a restart from the same checkpoint goes on where it stopped. Rows whose
    session (not null) is not in the settings only move the watermark, as ticks of a clock do.
    """
    spark = actions.sparkSession
    if spark.conf.get(STORE, None) != ROCKSDB:
        raise ValueError(f"start_limits needs {STORE}={ROCKSDB}")
    limit = time_limit_seconds(F.col("time_limit_min"))
    known = settings.select("session_id", limit.alias("limit_s"), F.coalesce("pause_enabled", F.lit(False)).alias("pause_enabled"))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)) - 1
    rows = (
        actions.withWatermark("ts", delay)
        .select("session_id", "ts", F.col("offset_s").cast("bigint").alias("offset_s"), kind.alias("kind"))
        .join(known, "session_id")
        .select(F.shiftright("session_id", SESSIONS.bit_length() - 1).alias("block"), "session_id", "ts", "offset_s", "limit_s", "pause_enabled", "kind")
    )
    closed = rows.groupBy("block").transformWithStateInPandas(
        Closing(), outputStructType=NUMBERS_SCHEMA, outputMode="Append", timeMode="EventTime"
    )
    reason = F.when(F.col("ended"), "ended").otherwise("time_up").alias("reason")
    closed = closed.select("session_id", "closed_s", reason, "actions_kept", "rounds_completed", "time_remaining")
    return (
        closed.writeStream.format("parquet")
        .outputMode("append")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_closed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CLOSED).parquet(folder)
