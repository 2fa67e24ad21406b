"""Writes that come twice, pages kept up by appends, two-tier retention, counts in the same pass."""

from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from matchpulse.operators import history, pages
from matchpulse.sources import derived, kafka, ledger
from tests.messages import START


@pytest.fixture
def predictions(spark, sf_dir):
    return history.read_predictions(derived.prediction_log(spark, sf_dir))


def plain(df):
    return sorted(map(str, df.collect()))


def test_a_batch_that_comes_twice_counts_once(spark, predictions, tmp_path):
    root = str(tmp_path / "h")
    assert history.read_history(spark, root).count() == 0
    first, second = predictions.filter("offset < 400"), predictions.filter("offset >= 400")
    assert [history.append_history_once(x, root, "q", i) for i, x in ((0, first), (0, first), (1, second), (0, first), (1, second))] == [True, False, True, False, False]
    assert plain(history.read_history(spark, root)) == plain(predictions)
    # the same messages once more, from another query: counted by position
    history.append_history_once(first, root, "again", 0)
    assert plain(history.read_history(spark, root)) == plain(predictions)
    assert ledger.read(spark, root, history.HISTORY).count() == predictions.count() + first.count()


def test_a_try_that_was_not_published_does_not_count(spark, predictions, tmp_path, monkeypatch):
    root = str(tmp_path / "h")

    def dies(*_):
        raise RuntimeError("lost before the ledger was written")

    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", dies)
        m.setattr(ledger, "published", lambda *_: False)
        with pytest.raises(RuntimeError):
            history.append_history_once(predictions, root, "q", 0)
    assert history.read_history(spark, root).count() == 0
    assert history.append_history_once(predictions, root, "q", 0)
    assert history.read_history(spark, root).count() == predictions.count()


def test_a_stream_into_the_ledger(spark, sf_dir, tmp_path):
    """The query is started twice over a checkpoint that has lost its commits, so every batch comes to the sink again."""
    log = derived.prediction_log(spark, sf_dir)
    for low in (0, 350, 700):
        log.filter((F.col("offset") >= low) & (F.col("offset") < low + 350)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for i in range(2):
        stream = history.read_predictions(kafka.read_files(spark, f"{tmp_path}/in", files_per_trigger=1))
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c{i}")
        assert ledger.to_ledger(writer, f"{tmp_path}/h", "live").start().awaitTermination(300)
    assert plain(history.read_history(spark, f"{tmp_path}/h")) == plain(history.read_predictions(log))


def test_appended_pages_equal_a_rebuild_and_leave_full_pages_alone(spark, predictions, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "PAGE_TICKS", 7)
    monkeypatch.setattr(pages, "PAGE_TICKS", 7)
    root = str(tmp_path / "p")
    cuts = predictions.approxQuantile("seq", [0.3, 0.6], 0.0)
    parts = [predictions.filter(f"seq <= {cuts[0]}"), predictions.filter(f"seq > {cuts[0]} and seq <= {cuts[1]}"), predictions.filter(f"seq > {cuts[1]}")]
    for i, part in enumerate(parts):
        assert pages.append_ticks(part, root, i) and not pages.append_ticks(part, root, i)
    columns = ["session_key", "round", "page", "ticks"]
    assert plain(pages.pages(spark, root).select(columns)) == plain(history.round_history_nested(predictions).select(columns))
    written = ledger.read(spark, f"{root}/pages", pages.PAGES)
    again = written.groupBy("session_key", "round", "page").agg(F.count("*").alias("n"), F.min(F.size("ticks")).alias("least")).filter("n > 1")
    assert again.count() > 0 and again.filter("least = 7").count() == 0  # only unfilled pages have a second version
    for i, part in enumerate(parts):
        met = {(r[0], r[1]) for r in part.select("session_key", "round").collect()}
        assert {(r[0], r[1]) for r in written.filter(F.col("batch") == i).select("session_key", "round").collect()} <= met


@pytest.mark.parametrize("n", [0, 1, 30])
def test_two_tiers_tell_what_the_whole_history_does(predictions, n):
    kept, summaries = predictions.limit(0), None
    for part in (predictions.filter("seq % 3 = 0"), predictions.filter("seq % 3 = 1"), predictions.filter("seq % 3 = 2")):
        kept, summaries = history.compacted(kept, summaries, part, n)
    assert plain(history.merged(summaries, history.folded(kept))) == plain(history.folded(predictions))
    if n:
        assert all(r["count"] <= n for r in kept.groupBy("session_key").count().collect())


def test_last_n_by_limits_and_over_slices(predictions):
    for n in (1, 5, 100):
        assert plain(history.last_n(predictions, n)) == plain(history.last_n(predictions, n, slices=5))


def test_counts_come_with_the_same_pass(spark, sf_dir):
    raw = derived.prediction_log(spark, sf_dir)
    observation = Observation("log")
    rows = history.observed_predictions(raw, observation).count()
    unreadable = history.unreadable_predictions(raw).agg(F.sum("unreadable")).first()[0]
    assert observation.get == {"messages": rows + unreadable, "unreadable": unreadable, "readable": rows}
    assert unreadable > 0 and rows == history.read_predictions(raw).count()


def test_counts_of_a_stream_stand_in_its_progress(spark, sf_dir, tmp_path):
    raw = derived.prediction_log(spark, sf_dir)
    raw.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = history.observed_predictions(kafka.read_files(spark, f"{tmp_path}/in"), "log")
    query = kafka.writer(stream, "counted", mode="parquet", path=f"{tmp_path}/out", available_now=True, checkpoint_root=str(tmp_path)).start()
    assert query.awaitTermination(300)
    counted = [p["observedMetrics"]["log"] for p in query.recentProgress if p["observedMetrics"]][0].asDict()
    assert counted["readable"] == spark.read.parquet(f"{tmp_path}/out").count() and counted["messages"] == counted["readable"] + counted["unreadable"]


def test_a_stretch_of_an_archive_reads_its_files_only(spark, tmp_path):
    rows = [("s", f"{i}", START + timedelta(hours=i), i % 2, i) for i in range(24 * 5)]
    log = spark.createDataFrame(rows, kafka.LOG_SCHEMA)
    kafka.archive(log, f"{tmp_path}/a")
    assert plain(kafka.replay_archive(spark, f"{tmp_path}/a")) == plain(log)
    part = kafka.replay_archive(spark, f"{tmp_path}/a", kafka.Stretch(START + timedelta(hours=30), START + timedelta(hours=40)))
    assert sorted(int(r["value"]) for r in part.collect()) == list(range(30, 40))
    for day in (1, 3, 4, 5):  # folders outside the stretch may be broken: they are not read
        for file in Path(f"{tmp_path}/a/day=2024-05-0{day}").glob("*.parquet"):
            file.write_bytes(b"no parquet")
    assert part.count() == 10
    kafka.archive(log, f"{tmp_path}/b")
    some = kafka.replay_archive(spark, f"{tmp_path}/b", kafka.Stretch(offsets={1: (None, 10), 0: (100, None)}))
    assert sorted(int(r["value"]) for r in some.collect()) == [1, 3, 5, 7, 9, *range(100, 120, 2)]
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(" in plan and "GreaterThanOrEqual(offset,100)" in plan


def test_stretches_of_a_topic():
    topic = kafka.Topic("b:9092", "t", "latest")
    by_offset = kafka.replay_options(topic, kafka.Stretch(offsets={1: (5, None), 0: (None, 9)}))
    assert by_offset["startingOffsets"] == '{"t": {"0": -2, "1": 5}}' and by_offset["endingOffsets"] == '{"t": {"0": 9, "1": -1}}'
    by_time = kafka.replay_options(topic, kafka.Stretch(START, START + timedelta(hours=1)))
    assert int(by_time["endingTimestamp"]) - int(by_time["startingTimestamp"]) == 3_600_000
    with pytest.raises(ValueError):
        kafka.replay_options(topic, kafka.Stretch(START, None, {0: (1, 2)}))
    with pytest.raises(ValueError):
        kafka.replay_options(topic, kafka.Stretch(START.replace(tzinfo=None)))
