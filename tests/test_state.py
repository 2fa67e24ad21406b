"""The round state, case by case, through the batch form and through the streaming function."""

from functools import reduce

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from matchpulse import schemas
from matchpulse.operators.events import parse_events, slim_timeline
from matchpulse.operators.rounds import build_features
from matchpulse.streaming.state import IDLE_MS, advance, advance_bucket, advance_in_order, by_session, dealt, in_order, play, spans_of
from tests.messages import event, log, player


class FakeState:
    """What the streaming function asks of a group's state."""

    def __init__(self):
        self.value, self.timeout, self.hasTimedOut, self.removed = None, None, False, False

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def remove(self):
        self.value, self.removed = None, True

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def both(ct_kills, ct_damage, t_kills, t_damage):
    return {"ct1": player("CT", 100, ct_kills, ct_damage), "t1": player("T", 100, t_kills, t_damage)}


def freeze(number, players=None):
    return event("freezetime", number, players or both(0, 0, 0, 0))


def live(number, players=None):
    return event("live", number, players or both(0, 0, 0, 0))


def over(number, players):
    return event("over", number, players)


def _four_rounds():
    total = 0
    for number, (kills, damage) in enumerate([(2, 11), (1, 24), (4, 35), (3, 47)], 1):
        yield freeze(number, both(total, 0, 0, 0))
        yield live(number)
        total += kills
        yield over(number, both(total, damage, 0, 0))
    yield live(5)


def _missed_rounds():
    there, away = both(0, 7, 0, 7), {"t1": player("T", damage=7)}
    for number in range(1, 6):
        yield freeze(number, there)
        yield over(number, away if number in (2, 4) else there)
    yield live(5, there)


# name -> messages of one session, and the four sums of each scored message
CASES = {
    "history grows over rounds": (
        [
            freeze(1),
            live(1, both(3, 71, 2, 44)),
            over(1, both(3, 71, 2, 44)),
            freeze(2, both(3, 0, 2, 0)),
            live(2, both(4, 52, 5, 37)),
            over(2, both(4, 52, 5, 37)),
            freeze(3, both(4, 0, 5, 0)),
            live(3, both(6, 18, 5, 9)),
        ],
        [(0, 0, 0, 0), (3, 71, 2, 44), (4, 123, 5, 81)],
    ),
    "window is three rounds": (
        list(_four_rounds()),
        [(0, 0, 0, 0), (2, 11, 0, 0), (3, 35, 0, 0), (7, 70, 0, 0), (8, 106, 0, 0)],
    ),
    "late joiner and dead player add nothing": (
        [
            freeze(1, {"ct1": player()}),
            over(1, {"ct1": player(kills=3, damage=100)}),
            live(1, {"ct1": player(), "new": player(health=80)}),
            live(1, {"ct1": player(health=0), "new": player()}),
        ],
        [(3, 100, 0, 0), (0, 0, 0, 0)],
    ),
    "freezetime and over emit nothing": ([freeze(1), over(1, both(0, 0, 0, 0))], []),
    "only the first over of the current round archives": (
        [freeze(1), over(2, both(9, 900, 9, 900)), over(1, both(4, 97, 1, 63)), over(1, both(5, 200, 5, 200)), live(7)],
        [(4, 97, 1, 63)],
    ),
    "round zero counts damage but no kills": (
        [freeze(0), over(0, both(4, 55, 1, 66)), event("bomb", 0, both(0, 0, 0, 0))],
        [(0, 55, 0, 66)],
    ),
    "second match is stale until its rounds pass the first": (
        [
            freeze(9),
            over(9, both(2, 20, 0, 0)),
            freeze(1),
            over(1, both(5, 50, 0, 0)),
            live(1),
            freeze(10, both(1, 0, 0, 0)),
            over(10, both(4, 40, 0, 0)),
            live(10),
        ],
        [(2, 20, 0, 0), (5, 60, 0, 0)],
    ),
    "missed round takes no place": (list(_missed_rounds()), [(0, 21, 0, 21)]),
    "kills never count negative": (
        [freeze(1, both(5, 0, 0, 0)), over(1, both(2, 10, 0, 0)), live(1)],
        [(0, 10, 0, 0)],
    ),
    "player back after rounds keeps the older snapshot": (
        [freeze(1, both(1, 0, 1, 0)), freeze(2, {"t1": player("T", kills=1)}), over(2, both(4, 9, 1, 0)), live(2)],
        [(3, 9, 0, 0)],
    ),
    "side switch moves the history": (
        [freeze(1), over(1, both(2, 8, 0, 0)), live(1, {"ct1": player("T"), "t1": player("CT")})],
        [(0, 0, 2, 8)],
    ),
}


@pytest.fixture(scope="module")
def in_batch(spark):
    """All cases in one run, a session each, over few slices so that sessions are cut."""
    logs = [log(spark, bodies, key=name) for name, (bodies, _) in CASES.items()]
    rows = build_features(parse_events(reduce(DataFrame.union, logs)), slices=5).collect()
    return {
        name: [
            tuple(r[c] for c in schemas.PREV3)
            for r in sorted(rows, key=lambda r: r.event_timestamp)
            if r.session_key == name
        ]
        for name in CASES
    }


@pytest.mark.parametrize("name", CASES)
def test_batch(in_batch, name):
    assert in_batch[name] == CASES[name][1]


@pytest.mark.parametrize("chunk", [1, 100])
@pytest.mark.parametrize("name", CASES)
def test_stream(spark, name, chunk):
    bodies, want = CASES[name]
    rows = slim_timeline(parse_events(log(spark, bodies))).toPandas().sort_values("offset")
    state, got = FakeState(), []
    for i in range(0, len(rows), chunk):
        for pdf in advance((name,), iter([rows.iloc[i : i + chunk]]), state):
            got += list(pdf[schemas.PREV3].itertuples(index=False, name=None))
    assert got == want


def test_same_second_follows_the_log(spark):
    bodies = [freeze(1), live(1), over(1, both(1, 9, 0, 0)), live(1)]
    rows = slim_timeline(parse_events(log(spark, bodies, seconds=[5, 5, 5, 5]))).toPandas()
    (pdf,) = advance(("s",), iter([rows.iloc[[3, 1]], rows.iloc[[2, 0]]]), FakeState())
    assert list(pdf["offset"]) == [1, 3] and list(pdf["ct_alive_kills_prev3_sum"]) == [0, 1]


def test_null_and_empty_key_share_state(spark):
    bodies = [event("freezetime", 1, both(0, 0, 0, 0)), event("over", 1, both(2, 5, 0, 0)), event("live", 1, both(0, 0, 0, 0))]
    raw = log(spark, bodies[:2], key=None).union(log(spark, [bodies[2]], key="", seconds=[9]))
    row = build_features(parse_events(raw)).collect()
    assert [(r.session_key, r.ct_alive_kills_prev3_sum) for r in row] == [("", 2)]


def test_feature_schema(spark):
    rows = build_features(parse_events(log(spark, ['{"map":{},"round":{"phase":"live"}}'])))
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in schemas.FEATURE_ROW]
    assert tuple(rows.collect()[0])[:2] == ("s1", 0)


def test_idle_session_is_forgotten(spark):
    rows = slim_timeline(parse_events(log(spark, [event("freezetime", 3, both(0, 0, 0, 0))]))).toPandas()
    state = FakeState()
    assert list(advance(("s1",), iter([rows]), state)) == []
    assert state.timeout == IDLE_MS and state.value[0] == 3
    state.hasTimedOut = True
    assert list(advance(("s1",), iter([pd.DataFrame()]), state)) == [] and state.removed


def test_a_bucket_plays_its_sessions_and_forgets_the_idle_ones(spark):
    """All cases in one bucket, row by row of the log in turn: one call a step, a state a bucket."""
    logs = [log(spark, bodies, key=name) for name, (bodies, _) in CASES.items()]
    rows = slim_timeline(parse_events(reduce(DataFrame.union, logs))).toPandas().assign(salt=0)
    state, got, now = FakeState(), {name: [] for name in CASES}, [0]
    state.getCurrentProcessingTimeMs = lambda: now[0]
    for _, step in rows.groupby("second"):
        for pdf in advance_bucket(iter([step]), state):
            for r in pdf.itertuples():
                got[r.session_key].append(tuple(getattr(r, c) for c in schemas.PREV3))
    assert got == {name: want for name, (_, want) in CASES.items()}
    assert state.timeout == IDLE_MS
    one = next(iter(CASES))
    now[0] = 1000
    list(advance_bucket(iter([rows[rows["session"] == one].head(1)]), state))
    assert state.timeout == IDLE_MS - 1000  # the others are idle first
    now[0], state.hasTimedOut = IDLE_MS + 1, True
    assert list(advance_bucket(iter([pd.DataFrame()]), state)) == [] and one in state.value[0] and state.timeout == 999
    assert not any(name in state.value[0] for name in CASES if name != one)
    now[0] = IDLE_MS + 1001
    assert list(advance_bucket(iter([pd.DataFrame()]), state)) == [] and state.removed


class EventState(FakeState):
    """A state with a watermark."""

    def __init__(self):
        super().__init__()
        self.watermark = 0

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms


def _dealt_rows(raw):
    lines = dealt(slim_timeline(parse_events(raw), keep=("event_timestamp",)), [])
    return lines.toPandas(), to_arrow_schema(lines.drop("event_timestamp").schema)


def test_a_bucket_in_order_waits_plays_and_forgets(spark):
    """All cases in one bucket, backwards and in three micro-batches; a row without time waits on, one that comes after its second leaves late."""
    logs = [log(spark, bodies, key=name) for name, (bodies, _) in CASES.items()]
    rows, kept = _dealt_rows(reduce(DataFrame.union, logs))
    run, state, last = advance_in_order(kept, 0, IDLE_MS), EventState(), int(rows["second"].max())
    timeless = rows.head(1).assign(second=None, session="timeless", session_key="timeless")
    back = rows.iloc[::-1]
    for part in (back.iloc[::3], pd.concat([back.iloc[1::3], timeless]), back.iloc[2::3]):
        assert list(run((0,), iter([part.head(5), part.iloc[5:]]), state)) == []
    assert pa.ipc.open_stream(state.value[1]).read_all().num_rows == len(rows) + 1
    assert state.timeout == (int(rows["second"].min()) + 1) * 1000 - 1
    state.watermark = (last + 1) * 1000
    (out,) = run((0,), iter([]), state)
    for name, (_, want) in CASES.items():
        own = out[out["session_key"] == name].sort_values("event_timestamp")
        assert list(own[schemas.PREV3].itertuples(index=False, name=None)) == want
    assert len(out) == (rows["kind"] == "tick").sum() and not out["late"].any() and set(out["kind"]) == {"tick"}
    tick = rows[rows["kind"] == "tick"].head(1)
    (left,) = run((0,), iter([tick]), state)
    assert left["late"].all() and left["offset"].tolist() == tick["offset"].tolist() and left["event_timestamp"].tolist() == tick["second"].tolist()
    state.watermark = (last + 1) * 1000 + IDLE_MS
    assert list(run((0,), iter([]), state)) == []
    assert pa.ipc.open_stream(state.value[1]).read_all()["session"].to_pylist() == ["timeless"]
    assert "timeless" in state.value[0] and not any(name in state.value[0] for name in CASES)


def test_an_idle_bucket_in_order_is_removed(spark):
    rows, kept = _dealt_rows(log(spark, [freeze(1), live(1)]))
    run, state = advance_in_order(kept, 0, IDLE_MS), EventState()
    assert list(run((0,), iter([rows]), state)) == []
    state.watermark = (int(rows["second"].max()) + 1) * 1000
    assert [len(out) for out in run((0,), iter([]), state)] == [1] and state.value[1] is None
    assert state.timeout == int(rows["second"].max()) * 1000 + IDLE_MS
    state.watermark = state.timeout
    assert list(run((0,), iter([]), state)) == [] and state.removed


def test_waiting_rows_are_held_as_compressed_columns(spark):
    """A waiting row passes Python and the state store twice: its players are text, and many rows take few bytes each."""
    ten = {f"player{i}": player("CT" if i < 5 else "T", 100, i, 10 * i) for i in range(10)}
    bodies = [freeze(1, ten), *[live(1, ten)] * 700, over(1, ten), *[over(1, ten)] * 600, *[live(1, ten)] * 700]
    rows, kept = _dealt_rows(log(spark, bodies))
    run, state = advance_in_order(kept, 0, None), EventState()
    assert list(run((0,), iter([rows]), state)) == []
    held = pa.ipc.open_stream(state.value[1]).read_all()
    assert held.num_rows == 2002 and {str(held.schema.field(c).type) for c in ("alive_ct", "alive_t", "players")} == {"string"}
    assert len(state.value[1]) < 60 * held.num_rows
    state.watermark = 2**41
    (out,) = run((0,), iter([]), state)
    sums, _ = play(in_order(rows), 0, False, {}, {})
    assert out.sort_values("offset")[schemas.PREV3].to_numpy().tolist() == sums.to_numpy().tolist()
    assert sums.iloc[-1].tolist() == [0, 100, 0, 350] and sums.iloc[0].tolist() == [0, 0, 0, 0]


def test_spans_of_columns_are_those_of_rows():
    """Ties go by partition and offset, a missing second comes last, whatever order rows are in."""
    rows = pd.DataFrame(
        [(s, salt, second, p, o) for s in ("b", "", "a") for salt in (0, 2) for second, p, o in ((5, 1, 1), (5, 0, 9), (None, 0, 0), (4, 1, 7))],
        columns=["session", "salt", "second", "partition", "offset"],
    ).sample(frac=1, random_state=7)
    want, spans = by_session(rows)
    order, found = spans_of(pa.Table.from_pandas(rows, preserve_index=False).set_column(2, "second", pa.array(rows["second"], "int64", from_pandas=True)))
    rows = rows.reset_index(drop=True)
    groups = lambda table, spans: {name: table.iloc[a:b].fillna(-1).to_numpy().tolist() for name, a, b in spans}
    assert groups(rows.iloc[order], found) == groups(want, spans) and len(found) == 6
    assert [r[2] for r in groups(rows.iloc[order], found)[("", 2)]] == [4, 5, 5, -1]
