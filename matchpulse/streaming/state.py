"""The round state of each session as keyed streaming state.

*Hot sessions.* Only control rows move a session's state; ticks read it. A hot session is therefore dealt to
``SALTS`` keys: its control rows go to all of them, each tick to one, and every key replays the few control
rows and sums its own ticks. Other sessions have one key.

*Many sessions.* A call of Python costs milliseconds however few rows it gets, and with the log both the sessions and the
micro-batches that each of them spans grow. Keys are therefore dealt to ``BUCKETS``; one call plays all sessions of a bucket
and its state holds theirs.

*Order.* ``live_features`` takes rows in order inside a micro-batch and micro-batches as they come.
``live_features_in_order`` keeps rows until the watermark has passed their second, so that rows of
several micro-batches are played in order; rows that come too late for that leave on the side.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchpulse import schemas
from matchpulse.operators.events import parse_events, slim_timeline
from matchpulse.operators.rounds import ARCHIVE_RULES, FIRST_ROUND, HISTORY_ROUNDS

STATE = (
    "current_round int, archived boolean, start_kills map<string,int>, "
    "history map<string,array<struct<kills:int,damage:int>>>"
)
IDLE_MS = 4 * 60 * 60 * 1000
SALTS = 16
#: A session with more than this share of a log's rows is hot, so there are fewer than its inverse.
HOT_SHARE = 1 / 8
FEATURES_WITH_POSITION = (
    ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.FEATURE_ROW) + ", partition int, offset bigint"
)
#: What is looked at of ticks, and of control rows.
LIVING, MOVES = ("alive_ct", "alive_t"), ("round_phase", "round_num", "players")


@lru_cache(maxsize=4096)
def _players(side: str) -> tuple[str, ...]:
    return tuple(json.loads(side))


def _sums(living: Iterable, history: dict) -> list[tuple[int, ...]]:
    """The four last-three-rounds sums of ticks (living of each side, as text or lists) that see the same history.

    Few sides differ between two archives: as text they are summed once.
    """
    totals: dict[str, tuple[int, int]] = {}
    sums: dict[str, tuple[int, int]] = {}

    def total(player: str) -> tuple[int, int]:
        if player not in totals:
            totals[player] = tuple(map(sum, zip(*history.get(player, ())))) or (0, 0)
        return totals[player]

    def summed(players: Iterable[str]) -> tuple[int, int]:
        known = [total(p) for p in players]
        return sum(x[0] for x in known), sum(x[1] for x in known)

    out = []
    for sides in living:
        found: tuple[int, ...] = ()
        for side in sides:
            if not isinstance(side, str):
                found += summed(() if side is None else side)
                continue
            if side not in sums:
                sums[side] = summed(_players(side))
            found += sums[side]
        out.append(found)
    return out


def _told(players: list | str) -> Iterable[tuple[str, int, int]]:
    """Player, kills and damage of a control row, which :func:`dealt` hands over as JSON text: only rows that move the state are read."""
    if isinstance(players, str):
        held = json.loads(players)
        return zip(held["player"], held["kills"], held["damage"])
    return ((p["player"], int(p["kills"]), int(p["damage"])) for p in players)


class _Columns:
    """Rows in order as plain lists, so that many sessions are played from one table: ticks and control rows by place."""

    def __init__(self, is_tick: np.ndarray, living: Iterable[tuple], moves: Iterable[tuple]) -> None:
        """``living``: both sides of each tick; ``moves``: phase, round and players of each control row."""
        self.is_tick, self.ticks, self.control = is_tick, is_tick.nonzero()[0], (~is_tick).nonzero()[0]
        self.living = list(living)
        self.moves = [(at, *move) for at, move in zip(self.control.tolist(), moves)]

    @classmethod
    def of(cls, rows: pd.DataFrame) -> _Columns:
        is_tick = (rows["kind"] == "tick").to_numpy()
        living = zip(*(rows[side].to_numpy()[is_tick] for side in LIVING))
        return cls(is_tick, living, zip(*(rows[c].to_numpy()[~is_tick].tolist() for c in MOVES)))

    def play(
        self, begin: int, end: int, current: int, archived: bool, start: dict, history: dict, reset_on_new_match: bool = False, archive_rule: str = "equal"
    ) -> tuple[list[tuple[int, ...]], tuple[int, bool]]:
        """One session's rows, those of the places from ``begin`` to ``end``; see :func:`play`."""
        ends = ARCHIVE_RULES[archive_rule]
        first, last = self.ticks.searchsorted((begin, end))
        found: list[tuple[int, ...]] = []

        def told(upto: int) -> None:
            """Sum the ticks before the ``upto``-th that are still open."""
            if first + len(found) < upto:
                found.extend(_sums(self.living[first + len(found) : upto], history))

        for at, phase, number, players in self.moves[slice(*self.control.searchsorted((begin, end)))]:
            if reset_on_new_match and phase == "freezetime" and number <= FIRST_ROUND < current:
                told(self.ticks.searchsorted(at))
                current, archived = 0, False
                start.clear()
                history.clear()
            if phase == "freezetime" and number > current:
                start.update((player, kills) for player, kills, _ in _told(players))
                current, archived = int(number), False
            elif phase == "over" and not archived and number - current in ends:
                told(self.ticks.searchsorted(at))
                for player, kills, damage in _told(players):
                    entry = (max(0, kills - start.get(player, kills)), damage)
                    history[player] = [*history.get(player, ()), entry][-HISTORY_ROUNDS:]
                archived = True
        told(last)
        return found, (current, archived)


def play(rows: pd.DataFrame, current: int, archived: bool, start: dict, history: dict, **rules) -> tuple[pd.DataFrame, tuple[int, bool]]:
    """Run one session's rows, in order, over its state; returns the sums of its ticks, the round and whether it is archived.

    ``start`` and ``history`` (player -> kills, last rounds) are changed in place. Control rows are visited one by one; the
    ticks between two archives are summed together. The rules are those of the batch form.
    """
    columns = _Columns.of(rows)
    found, after = columns.play(0, len(rows), current, archived, start, history, **rules)
    return pd.DataFrame(found, columns=schemas.PREV3, index=rows.index[columns.is_tick]), after


def _loaded(state: GroupState) -> tuple[int, bool, dict, dict]:
    if not state.exists:
        return 0, False, {}, {}
    current, archived, start, history = state.get[:4]
    return current, archived, dict(start), {p: [(r[0], r[1]) for r in rounds] for p, rounds in history.items()}


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(schemas.ORDER, kind="stable", ignore_index=True)


def tick_features(rows: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
    ticks = rows[rows["kind"] == "tick"]
    out = ticks[["session_key", "round_num", "second", *schemas.STATELESS]].rename(columns={"second": "event_timestamp"})
    out[schemas.PREV3] = sums[schemas.PREV3]
    out[["partition", "offset"]] = ticks[["partition", "offset"]]
    return out


def advance(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int = IDLE_MS, **rules
) -> Iterator[pd.DataFrame]:
    """Rows of one key in this micro-batch -> feature rows; a session idle too long is forgotten.

    The micro-batch bounds what is held here (maxOffsetsPerTrigger / maxFilesPerTrigger), the
    number of a session's players bounds the state.
    """
    if state.hasTimedOut:
        state.remove()
        return
    rows = in_order(pd.concat(batches, ignore_index=True))
    current, archived, start, history = _loaded(state)
    sums, after = play(rows, current, archived, start, history, **rules)
    state.update((*after, start, history))
    state.setTimeoutDuration(idle_ms)
    if (rows["kind"] == "tick").any():
        yield tick_features(rows, sums)


def hot_sessions(raw: DataFrame, share: float = HOT_SHARE) -> list[str]:
    """Sessions with more than ``share`` of the rows of a log: fewer than 1 / share of them, whatever its size."""
    counts = raw.groupBy(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("session")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.select(F.sum("rows")).scalar()
    return [r["session"] for r in counts.filter(F.col("rows") > total * share).select("session").collect()]


def dealt(timeline: DataFrame, hot: list[str], salts: int = SALTS) -> DataFrame:
    """The rows with their ``salt``: 0, but for hot sessions ticks by position and control rows once per salt.

    Players become text, as nested values are dear to hand to Python: few control rows are looked into, and the living of ticks repeat.
    """
    by_place = F.pmod(F.xxhash64("partition", "offset"), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    is_hot = F.col("session").isin(*hot) if hot else F.lit(False)
    keys = F.when(~is_hot, F.array(F.lit(0))).when(F.col("kind") == "tick", F.array(by_place)).otherwise(every)
    told = F.to_json(F.struct(*[F.col(f"players.{c}").alias(c) for c in ("player", "kills", "damage")]))
    texts = {"players": F.when(F.col("players").isNotNull(), told), **{side: F.to_json(side) for side in LIVING}}
    # made before the rows multiply
    return timeline.withColumns(texts).withColumn("salt", F.explode(keys))


# --- many sessions under one key

#: Keys of a stream's state: each holds the sessions that fall to it.
BUCKETS = 256
STATE_OF_BUCKET = "sessions string"


def bucketed(keyed: DataFrame, buckets: int) -> DataFrame:
    return keyed.withColumn("bucket", F.pmod(F.xxhash64("session", "salt"), F.lit(buckets)).cast("int"))


def by_session(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[tuple[str, int], int, int]]]:
    """Rows with each (session, salt) together and in order, and where each of them begins and ends."""
    rows = in_order(rows)
    number = rows.groupby(["session", "salt"], sort=False).ngroup().to_numpy()
    order = number.argsort(kind="stable")
    rows, number = rows.iloc[order].reset_index(drop=True), number[order]
    edges = [0, *((number[1:] != number[:-1]).nonzero()[0] + 1).tolist(), len(rows)] if len(rows) else []
    names = list(zip(rows["session"].to_numpy()[edges[:-1]], rows["salt"].to_numpy()[edges[:-1]].tolist())) if edges else []
    return rows, list(zip(names, edges, edges[1:]))


def _written(sessions: dict[tuple[str, int], list]) -> str:
    return json.dumps([[*name, *held] for name, held in sessions.items()])


def _read(text: str | None) -> dict[tuple[str, int], list]:
    return {(entry[0], entry[1]): entry[2:] for entry in json.loads(text or "[]")}


def advance_bucket(batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int = IDLE_MS, **rules) -> Iterator[pd.DataFrame]:
    """As :func:`advance` for the sessions of a bucket: per (session, salt) its round state and the time after which it is idle.

    A session is forgotten when it is called no more after that time; the bucket's timeout is the earliest of them.
    """
    now = state.getCurrentProcessingTimeMs()
    sessions = _read(state.get[0]) if state.exists else {}
    parts = [] if state.hasTimedOut else [b for b in batches if len(b)]
    rows, spans = by_session(pd.concat(parts, ignore_index=True)) if parts else (None, [])
    met = {name for name, _, _ in spans}
    sessions = {name: held for name, held in sessions.items() if name in met or held[4] >= now}
    if spans:
        columns, found = _Columns.of(rows), []
        for name, begin, end in spans:
            current, archived, start, history = sessions.get(name, (0, False, {}, {}))[:4]
            sums, after = columns.play(begin, end, current, archived, start, history, **rules)
            found += sums
            sessions[name] = [*after, start, history, now + idle_ms]
    if sessions:
        state.update((_written(sessions),))
        state.setTimeoutDuration(max(1, min(held[4] for held in sessions.values()) - now))
    elif state.exists:
        state.remove()
    if spans and len(columns.ticks):
        yield tick_features(rows, pd.DataFrame(found, columns=schemas.PREV3, index=rows.index[columns.is_tick]))


def live_features(
    raw: DataFrame, hot: list[str] | None = None, salts: int = SALTS, idle_ms: int = IDLE_MS, buckets: int | None = BUCKETS, **rules
) -> DataFrame:
    """Stream of raw telemetry -> stream of feature rows with their log position.

    Decoding and the row-local features run before the shuffle; only slim rows are shuffled and
    handed to Python, as Arrow batches. Sessions are dealt to ``buckets``, so that a micro-batch calls Python once per bucket
    and not once per session; without buckets each session is a key of its own. ``hot``, ``salts`` and ``buckets`` are part of the
    state's keys: a checkpoint goes on only with the same ones. ``rules``: reset_on_new_match and archive_rule, as in batch.
    """
    keyed = dealt(slim_timeline(parse_events(raw)), hot or [], salts)
    if buckets is None:
        return keyed.groupBy("session", "salt").applyInPandasWithState(
            lambda key, batches, state: advance(key, batches, state, idle_ms, **rules),
            FEATURES_WITH_POSITION, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout,
        )
    return (
        bucketed(keyed, buckets)
        .groupBy("bucket")
        .applyInPandasWithState(
            lambda key, batches, state: advance_bucket(batches, state, idle_ms, **rules),
            FEATURES_WITH_POSITION, STATE_OF_BUCKET, "append", GroupStateTimeout.ProcessingTimeTimeout,
        )
    )


# --- in event order over micro-batches

STATE_IN_ORDER = STATE_OF_BUCKET + ", waiting binary"
FEATURES_IN_ORDER = FEATURES_WITH_POSITION + ", kind string, late boolean"
#: What stands for a number that is missing: it comes last, and no watermark passes it.
NEVER = 2**63 - 1


def packed(rows: pd.DataFrame | pa.Table, kept: pa.Schema, compression: str | None = None) -> bytes:
    """Rows as one value of a state."""
    table = rows if isinstance(rows, pa.Table) else pa.Table.from_pandas(rows, kept, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(packed: bytes | None) -> pd.DataFrame | None:
    return pa.ipc.open_stream(packed).read_pandas() if packed else None


def _numbers(rows: pa.Table, name: str) -> np.ndarray:
    return rows[name].cast("int64").fill_null(NEVER).to_numpy()


def spans_of(rows: pa.Table) -> tuple[np.ndarray, list[tuple[tuple[str, int], int, int]]]:
    """As :func:`by_session` for an Arrow table, whose rows stay where they are: their order, and where each (session, salt) begins and ends in it."""
    if not rows.num_rows:
        return np.zeros(0, "int64"), []
    session, salt = rows["session"].combine_chunks().dictionary_encode(), _numbers(rows, "salt")
    width = int(salt.max()) + 1
    number = session.indices.to_numpy().astype("int64") * width + salt
    order = np.lexsort((*(_numbers(rows, c) for c in reversed(schemas.ORDER)), number))
    number = number[order]
    edges = [0, *((number[1:] != number[:-1]).nonzero()[0] + 1).tolist(), len(number)]
    sessions = session.dictionary.to_pylist()
    names = [(sessions[i // width], i % width) for i in number[edges[:-1]].tolist()]
    return order, list(zip(names, edges, edges[1:]))


def _values(rows: pa.Table, name: str, at: np.ndarray) -> np.ndarray:
    return rows[name].take(pa.array(at)).to_numpy()


def advance_in_order(kept: pa.Schema, grace_ms: int, idle_ms: int | None) -> Callable:
    """The keyed function that plays rows of a bucket's sessions once the watermark plus ``grace_ms`` has passed their second.

    Held per (session, salt): its round state, the second up to which it has been played and its latest second; the waiting rows of
    all sessions lie together. A session is called when it has new rows, when waiting rows of it have become complete or when it has been idle.
    Each row passes here twice, so rows stay in columns of Arrow and only what is played of them becomes Python's.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        edge = (watermark + grace_ms) // 1000  # seconds before it are complete
        text, waiting = state.get if state.exists else (None, None)
        sessions = _read(text)
        held = pa.ipc.open_stream(waiting).read_all() if waiting else kept.empty_table()
        new = [pa.Table.from_pandas(b, kept, preserve_index=False, nthreads=1) for b in batches if len(b)]
        rows = pa.concat_tables([held, *new]).combine_chunks()
        order, spans = spans_of(rows)
        is_new, second = order >= held.num_rows, _numbers(rows, "second")[order]
        passed = np.zeros(len(order), "int64")
        for name, begin, end in spans:
            passed[begin:end] = sessions[name][4] if name in sessions else 0
        late = second < passed
        if late.any():
            left = rows.select(["session_key", "round_num", "second", "partition", "offset", "kind"]).take(pa.array(order[late])).to_pandas()
            yield left.rename(columns={"second": "event_timestamp"}).assign(**dict.fromkeys(schemas.FEATURES), late=True)
        due = (second < edge) & ~late
        rest = ~due & ~late
        ready = order[due]
        is_tick = pc.equal(rows["kind"], "tick").to_numpy()[ready]
        ticks, control = ready[is_tick], ready[~is_tick]
        living, moves = ([_values(rows, c, at).tolist() for c in names] for names, at in ((LIVING, ticks), (MOVES, control)))
        columns, found, done = _Columns(is_tick, zip(*living), zip(*moves)), [], 0
        idle = lambda latest: idle_ms is not None and latest is not None and watermark >= latest * 1000 + idle_ms
        waits = set()
        for name, begin, end in spans:
            n = int(due[begin:end].sum())
            if rest[begin:end].any():
                waits.add(name)
            if not n and not is_new[begin:end].any():
                continue
            current, archived, start, history, before, latest = sessions.get(name, (0, False, {}, {}, 0, None))
            if n:
                # rows are in order, so the due ones of a session are its first ones that are not late
                played = second[begin:end][due[begin:end]]
                if idle_ms is not None and latest is not None and (int(played[0]) - latest) * 1000 > idle_ms:
                    current, archived, start, history = 0, False, {}, {}
                sums, (current, archived) = columns.play(done, done + n, current, archived, start, history)
                found += sums
                done, latest = done + n, int(played[-1])
            elif name not in waits and idle(latest):
                sessions.pop(name, None)
                continue
            sessions[name] = [current, archived, start, history, max(before, edge), latest]
        if len(ticks):
            out = rows.select(["session_key", "round_num", "second", *schemas.STATELESS, "partition", "offset", "kind"]).take(pa.array(ticks)).to_pandas()
            sums = dict(zip(schemas.PREV3, np.array(found, "int64").T))
            yield out.rename(columns={"second": "event_timestamp"}).assign(**sums, late=False)
        met = {name for name, _, _ in spans}
        for name in [name for name, held in sessions.items() if name not in met and idle(held[5])]:
            del sessions[name]
        if not sessions:
            if state.exists:
                state.remove()
            return
        state.update((_written(sessions), packed(rows.take(pa.array(order[rest])), kept, "lz4") if waits else None))
        moments = [latest * 1000 + idle_ms for name, (*_, latest) in sessions.items() if name not in waits and idle_ms is not None and latest is not None]
        if rest.any() and (earliest := int(second[rest].min())) != NEVER:
            moments.append((earliest + 1) * 1000 - grace_ms - 1)
        if moments:
            state.setTimeoutTimestamp(max(watermark + 1, min(moments)))

    return run


def live_features_in_order(
    raw: DataFrame,
    delay_s: int,
    grace_s: int = 60,
    hot: list[str] | None = None,
    salts: int = SALTS,
    idle_ms: int | None = IDLE_MS,
    buckets: int = BUCKETS,
) -> DataFrame:
    """As :func:`live_features`, but rows of a session are played in event order over micro-batches.

    A row waits until the stream has come ``delay_s`` past its second. A row that comes later than that leaves
    unplayed with ``late`` = true (see :func:`on_time` and :func:`too_late`); one later by ``grace_s`` more is dropped by Spark
    and counted in the query's progress. Idle time is event time here.
    """
    lines = slim_timeline(parse_events(raw.withWatermark("timestamp", f"{delay_s + grace_s} seconds")), keep=("event_timestamp",))
    keyed = dealt(lines, hot or [], salts)
    kept = to_arrow_schema(keyed.drop("event_timestamp").schema)
    run = advance_in_order(kept, grace_s * 1000, idle_ms)
    return bucketed(keyed, buckets).groupBy("bucket").applyInPandasWithState(
        run, FEATURES_IN_ORDER, STATE_IN_ORDER, "append", GroupStateTimeout.EventTimeTimeout
    )


def on_time(features: DataFrame) -> DataFrame:
    return features.filter(~F.col("late")).drop("late", "kind")


def too_late(features: DataFrame) -> DataFrame:
    """Rows that came too late to be played: ticks and control rows, by position."""
    return features.filter("late").select("kind", "session_key", "round_num", "event_timestamp", "partition", "offset")
