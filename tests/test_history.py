from pyspark.sql import functions as F

import pytest

from matchpulse.functions import expressions as X
from matchpulse.operators import history as H
from matchpulse.sources import derived
from tests.messages import log


def message(session="s1", round_num=1, prob=0.5, ts=1_700_000_000_000):
    return {"sessionKey": session, "round": round_num, "probCtWin": prob, "timestamp": ts}


def test_reading_skips_tombstones_and_junk(spark):
    raw = log(spark, [message(), None, "junk", message(ts=1_700_000_000)])
    rows = H.read_predictions(raw).orderBy("offset").collect()
    assert [r.offset for r in rows] == [0, 3]
    assert {r.timestamp_ms for r in rows} == {1_700_000_000_000}
    assert [tuple(r) for r in H.unreadable_predictions(raw).collect()] == [(0, 1)]


@pytest.mark.parametrize("prob,percent,side", [(0.5, 50, "CT Win"), (0.4999, 50, "T Win"), (0.005, 1, "T Win"), (1.0, 100, "CT Win")])
def test_outcome(spark, prob, percent, side):
    row = H.with_outcome(H.read_predictions(log(spark, [message("76561190000001", prob=prob)]))).collect()[0]
    assert (row.ct_percent, row.outcome, row.session_label) == (percent, side, "…90000001")


def test_latest_of_nothing_is_nothing(spark):
    empty = H.read_predictions(log(spark, [None]))
    assert H.latest_prediction(empty).collect() == [] and H.current_round(empty).collect() == []


def test_clear_without_markers_keeps_everything(spark):
    predictions = H.read_predictions(log(spark, [message(), message()]))
    none = predictions.select("seq").limit(0)
    assert H.since_last_clear(predictions, none).count() == 2
    assert H.since_last_clear(predictions, predictions.select("seq")).count() == 0


def test_append_keeps_what_is_there(spark, tmp_path):
    predictions = H.read_predictions(log(spark, [message(), message()]))
    for _ in range(2):
        H.append_history(predictions, f"{tmp_path}/history")
    assert spark.read.parquet(f"{tmp_path}/history").count() == 4


def test_snapshot_is_written(spark, tmp_path):
    predictions = H.read_predictions(log(spark, [message(), message(round_num=2)]))
    H.history_snapshot(predictions, f"{tmp_path}/snap")
    assert spark.read.parquet(f"{tmp_path}/snap/round_history").count() == 2


@pytest.mark.parametrize("slices", [1, 7, 40])
@pytest.mark.parametrize("by", [("round",), ("session_key", "round")])
def test_ticks_over_any_number_of_slices(spark, sf_dir, by, slices):
    """Null sessions and two partitions included; the columns come in one order."""
    predictions = H.read_predictions(derived.prediction_log(spark, sf_dir))
    ticks = H.tick_index(predictions, by, slices)
    assert ticks.columns == [*predictions.columns, "tick"]
    rows = ticks.collect()
    assert any(r.session_key is None for r in rows) and {r.partition for r in rows} == {0, 1}
    count, want = {}, {}
    for r in sorted(rows, key=lambda r: (r.partition, r.offset)):
        group = tuple(r[c] for c in by)
        count[group] = want[r.offset] = count.get(group, 0) + 1
    assert {r.offset: r.tick for r in rows} == want and len(rows) == predictions.count()


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_last_n_of_any_size(spark, sf_dir, n):
    predictions = H.read_predictions(derived.prediction_log(spark, sf_dir))
    sessions = {}
    for r in sorted(predictions.collect(), key=lambda r: (r.partition, r.offset)):
        sessions.setdefault(r.session_key, []).append(r.offset)
    want = sorted(o for offsets in sessions.values() for o in offsets[-n:])
    assert sorted(r.offset for r in H.last_n(predictions, n, slices=6).collect()) == want


def test_summaries_are_hash_aggregates(spark, sf_dir):
    predictions = H.read_predictions(derived.prediction_log(spark, sf_dir))
    for df in (
        H.latest_prediction(predictions),
        H.latest_by_session(predictions),
        H.round_summary(predictions),
        H.first_ticks(predictions),
        H.first_ticks(predictions, ("round",)),
        H.current_round(predictions),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_numbers_come_in_any_form(spark):
    loose = '{"sessionKey":"s","round":%s,"probCtWin":%s,"timestamp":%s}'
    raw = log(spark, ["", "  ", "null", "5", loose % ("3.0", '"0.5"', "1.7e12"), loose % ('"x"', "[]", "1e400")])
    rows = [tuple(r) for r in H.read_predictions(raw).select("round", "prob_ct_win", "timestamp_ms").collect()]
    assert rows == [(3, 0.5, 1_700_000_000_000), (None, None, None)]
    assert [tuple(r) for r in H.unreadable_predictions(raw).collect()] == [(0, 4)]


def test_long_rounds_go_on_in_pages(spark, monkeypatch):
    monkeypatch.setattr(H, "PAGE_TICKS", 3)
    predictions = H.read_predictions(log(spark, [message() for _ in range(8)]))
    pages = sorted((r.page, [t.tick for t in r.ticks]) for r in H.round_history_nested(predictions).collect())
    assert pages == [(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8])]


def test_uuid_tells_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("a|1", "b", "c"), ("a", "1|b", "c")], "x string, y string, z string")
    assert rows.select(X.uuid_from(*map(F.col, "xyz"))).distinct().count() == 5


def test_uuid_is_stable(spark):
    df = spark.range(3).select(X.uuid_from(F.col("id")).alias("u"))
    assert df.collect() == df.collect() and len({r.u for r in df.collect()}) == 3
