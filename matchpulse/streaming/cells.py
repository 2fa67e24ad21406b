"""The round state of each session in cells of its own, with timers.

A session's round number is a value cell, its players' kills at round start and their last rounds are map cells, one
per player. A micro-batch reads the cells of the players it meets, once each, and writes only those that changed, so
a session with many players costs what its living ones cost. A registered timer forgets an idle session; a time to live
lets the cells of players who left expire by themselves.

The state store must be RocksDB (:func:`rocksdb`). The rules of play and the dealing of hot sessions are those of
``streaming.state``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import MapState

from matchpulse.operators.events import parse_events, slim_timeline
from matchpulse.streaming.state import FEATURES_WITH_POSITION, IDLE_MS, SALTS, dealt, in_order, play, tick_features

ROUND = "current_round int, archived boolean"
PLAYER = "player string"
START_KILLS = "kills int"
HISTORY = "rounds array<struct<kills:int,damage:int>>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Cells:
    """A map state read cell by cell, each once a micro-batch; :meth:`write` writes the changed ones."""

    def __init__(self, state: MapState) -> None:
        self._state, self._known, self._changed, self._anew = state, {}, set(), False

    def get(self, player: str, default=None):
        if player not in self._known:
            found = None if self._anew else self._state.getValue((player,))
            # structs come as Rows, which a state does not take back
            self._known[player] = found and ([tuple(x) for x in found[0]] if isinstance(found[0], list) else found[0])
        value = self._known[player]
        return default if value is None else value

    def __setitem__(self, player: str, value) -> None:
        self._known[player] = value
        self._changed.add(player)

    def update(self, pairs: Iterable[tuple]) -> None:
        for player, value in pairs:
            self[player] = value

    def clear(self) -> None:
        self._known, self._changed, self._anew = {}, set(), True

    def write(self) -> int:
        """Write what changed; returns the number of cells written."""
        if self._anew:
            self._state.clear()
        for player in self._changed:
            self._state.updateValue((player,), (self._known[player],))
        return len(self._changed)


class RoundCells(StatefulProcessor):
    """Rows of a (session, salt) -> feature rows of its ticks; rules as in :func:`streaming.state.play`."""

    def __init__(self, idle_ms: int = IDLE_MS, player_ttl_ms: int | None = None, **rules) -> None:
        self.idle_ms, self.player_ttl_ms, self.rules = idle_ms, player_ttl_ms, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.round = handle.getValueState("round", ROUND)
        self.start = handle.getMapState("start_kills", PLAYER, START_KILLS, self.player_ttl_ms)
        self.history = handle.getMapState("history", PLAYER, HISTORY, self.player_ttl_ms)

    def _rearm(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            if timer != at:
                self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = in_order(pd.concat(rows, ignore_index=True))
        current, archived = self.round.get() or (0, False)
        start, history = Cells(self.start), Cells(self.history)
        sums, (after, done) = play(batch, current, archived, start, history, **self.rules)
        if (after, done) != (current, archived) or not self.round.exists():
            self.round.update((after, done))
        start.write()
        history.write()
        self._rearm(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if (batch["kind"] == "tick").any():
            yield tick_features(batch, sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for cell in (self.round, self.start, self.history):
            cell.clear()
        self._rearm(None)
        return iter(())

    def close(self) -> None:
        pass


def live_features_in_cells(
    raw: DataFrame, hot: list[str] | None = None, salts: int = SALTS, idle_ms: int = IDLE_MS, player_ttl_ms: int | None = None, **rules
) -> DataFrame:
    """As :func:`streaming.state.live_features`, with a cell per player. ``player_ttl_ms``: how long a player's cells last unwritten."""
    return (
        dealt(slim_timeline(parse_events(raw)), hot or [], salts)
        .groupBy("session", "salt")
        .transformWithStateInPandas(RoundCells(idle_ms, player_ttl_ms, **rules), FEATURES_WITH_POSITION, "append", "processingTime")
    )
