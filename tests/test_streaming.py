"""Streams over message files give what the batch forms give."""

import json
import time
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchpulse import schemas
from matchpulse.operators import rounds
from matchpulse.operators.events import parse_events, slim_timeline
from matchpulse.operators.history import as_percentages, read_predictions, round_summary, sequence, since_last_clear
from matchpulse.operators.matching import match_responses, read_responses
from matchpulse.plans import queries
from matchpulse.sources import derived, kafka
from matchpulse.streaming import live
from matchpulse.streaming.cells import PROVIDER, ROCKSDB, Cells, live_features_in_cells, rocksdb
from matchpulse.streaming.state import SALTS, dealt, hot_sessions, live_features, live_features_in_order, on_time, too_late
from tests.compare import compare
from tests.messages import START, event, player


def write_chunks(raw, folder, chunks):
    """Files in log order, one per chunk and written one after the other."""
    size = raw.agg(F.max("offset")).first()[0] // chunks + 1
    for i in range(chunks):
        part = raw.filter(F.floor(F.col("offset") / size) == i).coalesce(1)
        part.write.mode("append").parquet(folder)


def run(df, folder, name, **options):
    out = f"{folder}/{name}"
    query = kafka.writer(
        df, name, mode="parquet", path=out, available_now=True, checkpoint_root=f"{folder}/checkpoints", **options
    ).start()
    assert query.awaitTermination(300)
    return df.sparkSession.read.schema(df.schema).parquet(out)


COLUMNS = [*schemas.FEATURE_ROW.fieldNames(), "offset"]


def rows_of(df):
    return sorted(map(str, df.select(COLUMNS).collect()))


@pytest.mark.parametrize("hot", [[], ["arena", ""]])
def test_live_features_equal_batch(spark, sf_dir, tmp_path, hot):
    """One micro-batch and several, with and without keys dealt to salts, on the log with disordered rounds."""
    raw = derived.telemetry(spark, sf_dir, True)
    write_chunks(raw, f"{tmp_path}/in", 6 if hot else 1)
    stream = live_features(kafka.read_files(spark, f"{tmp_path}/in", files_per_trigger=1), hot, salts=5)
    got = run(stream, tmp_path, "features")
    assert rows_of(got) == rows_of(rounds.tick_features(rounds.timeline(parse_events(raw))))


def test_live_features_by_match_equal_batch(spark, sf_dir, tmp_path):
    raw = derived.telemetry(spark, sf_dir, True)
    write_chunks(raw, f"{tmp_path}/in", 2)
    rules = {"reset_on_new_match": True, "archive_rule": "equal_or_next"}
    stream = live_features(kafka.read_files(spark, f"{tmp_path}/in", files_per_trigger=1), ["arena"], 3, **rules)
    got = run(stream, tmp_path, "features")
    line = rounds.split_matches(rounds.timeline(parse_events(raw)))
    assert rows_of(got) == rows_of(rounds.tick_features(line, "equal_or_next"))


def test_features_in_cells_equal_batch(spark, sf_dir, tmp_path):
    """Several micro-batches over the cells of RocksDB, with and without the rules of matches."""
    raw = derived.telemetry(spark, sf_dir, True)
    write_chunks(raw, f"{tmp_path}/in", 4)
    by_match = {"reset_on_new_match": True, "archive_rule": "equal_or_next"}
    for name, rules, line in (
        ("plain", {}, rounds.timeline(parse_events(raw))),
        ("matches", by_match, rounds.split_matches(rounds.timeline(parse_events(raw)))),
    ):
        with rocksdb(spark):
            stream = live_features_in_cells(kafka.read_files(spark, f"{tmp_path}/in", files_per_trigger=1), ["arena"], 3, **rules)
            got = run(stream, tmp_path, name)
        assert rows_of(got) == rows_of(rounds.tick_features(line, rules.get("archive_rule", "equal")))


def test_only_changed_cells_are_written():
    class Map(dict):
        reads = 0

        def getValue(self, key):
            self.reads += 1
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    stored = Map({("a",): (1,), ("b",): (2,)})
    cells = Cells(stored)
    assert [cells.get("a"), cells.get("a"), cells.get("c", 7)] == [1, 1, 7] and stored.reads == 2
    cells.update([("c", 3)])
    assert cells.write() == 1 and stored == {("a",): (1,), ("b",): (2,), ("c",): (3,)}
    cells.clear()
    cells["d"] = 4
    assert cells.get("a", 0) == 0 and cells.write() == 1 and stored == {("d",): (4,)}


def test_a_hot_session_is_spread_over_tasks(spark, sf_dir):
    raw = derived.telemetry(spark, sf_dir)
    hot = hot_sessions(raw)
    assert hot == ["arena"]
    lines = dealt(slim_timeline(parse_events(raw)), hot)
    tasks = lines.repartition(32, "session", "salt").withColumn("task", F.spark_partition_id()).filter("session = 'arena'")
    sizes = [r["count"] for r in tasks.groupBy("task").count().collect()]
    ticks = tasks.filter("kind = 'tick'").count()
    control = tasks.filter("kind = 'control'").select("offset").distinct().count()
    assert len(sizes) >= 8 and tasks.filter("kind = 'tick'").select("offset").distinct().count() == ticks
    assert max(sizes) <= 4 * (control + ticks / SALTS)


def in_order(spark, folder, delay, **options):
    stream = live_features_in_order(kafka.read_files(spark, folder, files_per_trigger=1), delay, **options)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        return run(stream, folder, "ordered")
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def closing(spark, raw, folder, batches=2):
    for i in range(batches):
        end = raw.agg((F.max("timestamp") + F.make_dt_interval(days=F.lit(i + 1))).alias("timestamp"))
        rest = [F.lit(None).cast(t).alias(c) for c, t in raw.dtypes if c != "timestamp"]
        end.select("timestamp", *rest).select(raw.columns).coalesce(1).write.mode("append").parquet(folder)


def test_rows_out_of_order_over_micro_batches_are_played_in_order(spark, sf_dir, tmp_path):
    """Seven micro-batches; each row comes up to a day late, rounds run up and down besides."""
    raw = derived.telemetry(spark, sf_dir, True)
    arrival = F.col("timestamp").cast("bigint") + F.pmod(F.xxhash64("offset"), F.lit(86_400))
    placed = raw.withColumn("place", F.ntile(7).over(Window.orderBy(arrival)))
    for i in range(1, 8):
        placed.filter(F.col("place") == i).drop("place").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    closing(spark, raw, f"{tmp_path}/in")
    got = in_order(spark, f"{tmp_path}/in", 86_401, hot=["arena"], salts=3, idle_ms=None)
    assert too_late(got).count() == 0
    assert rows_of(on_time(got)) == rows_of(rounds.tick_features(rounds.timeline(parse_events(raw))))


def test_rows_too_late_leave_on_the_side(spark, tmp_path):
    def write(*messages):
        rows = [("s", value and json.dumps(value), START + timedelta(seconds=at), 0, offset) for offset, at, value in messages]
        spark.createDataFrame(rows, kafka.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    one = {"a": player("CT", 100, 3, 30)}
    write((1, 0, event("freezetime", 1, {"a": player("CT")})), (2, 40, event("live", 2, one)))
    write((3, 10, event("over", 1, one)), (4, 200, None))  # late for file order, in time for the delay of 60 s
    write((6, 205, None))  # the timer of the first rows fires here
    write((5, 20, event("live", 2, one)), (7, 400, None))  # passed by then
    write((8, 500, None))
    got = in_order(spark, f"{tmp_path}/in", 60, grace_s=600)
    assert [tuple(r) for r in too_late(got).select("kind", "offset").collect()] == [("tick", 5)]
    assert [(r["offset"], r["ct_alive_kills_prev3_sum"]) for r in on_time(got).collect()] == [(2, 3)]


@pytest.mark.parametrize("job", [live_features, live_features_in_cells])
def test_an_idle_session_starts_anew(spark, tmp_path, job):
    """A real timer fires: after the idle time the session's history is gone."""
    def write(offset, value):
        rows = [("s", json.dumps(value), START + timedelta(seconds=offset), 0, offset)]
        spark.createDataFrame(rows, kafka.LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    one = {"a": player("CT", 100, 3, 30)}
    write(1, event("freezetime", 1, {"a": player("CT")}))
    rows = []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    store = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB if job is live_features_in_cells else store)
    try:
        stream = job(kafka.read_files(spark, f"{tmp_path}/in"), idle_ms=15_000)
        query = (
            stream.writeStream.outputMode("append")
            .trigger(processingTime="500 milliseconds")
            .option("checkpointLocation", f"{tmp_path}/c")
            .foreachBatch(lambda df, _: rows.extend((r["offset"], r["ct_alive_kills_prev3_sum"]) for r in df.collect()))
            .start()
        )

        def until(what):
            for _ in range(240):
                if what():
                    return
                time.sleep(0.5)
            raise AssertionError("waited too long")

        write(2, event("over", 1, one))
        write(3, event("live", 2, one))
        until(lambda: len(rows) == 1)
        held = lambda: [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        until(lambda: held() and held()[-1] == 0)  # the timer has dropped the state
        write(4, event("live", 2, one))
        until(lambda: len(rows) == 2)
        query.stop()
    finally:
        spark.conf.set(PROVIDER, store)
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    assert rows == [(3, 3), (4, 0)]


def test_live_summary_goes_on_from_history_and_after_a_clear(spark, sf_dir, tmp_path):
    raw = derived.prediction_log(spark, sf_dir)
    old, new = raw.filter("offset < 500"), raw.filter("offset >= 500")
    new.write.parquet(f"{tmp_path}/in")
    marker = new.filter("offset = 700").select(sequence())
    for name, seed, markers, want in (
        ("seeded", live.round_totals(read_predictions(old)), None, read_predictions(raw)),
        ("cleared", None, marker, since_last_clear(read_predictions(new), marker)),
    ):
        stream = live.live_round_summary(kafka.read_files(spark, f"{tmp_path}/in"), seed=seed, markers=markers)
        latest = {} if seed is None else {r["round"]: tuple(r) for r in as_percentages(seed, ("round",)).collect()}
        query = (
            stream.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{tmp_path}/{name}")
            .foreachBatch(lambda df, _: latest.update({r["round"]: tuple(r) for r in df.collect()}))
            .start()
        )
        assert query.awaitTermination(300)
        assert sorted(latest.values()) == sorted(map(tuple, round_summary(want).collect()))


def test_live_matches(spark, tmp_path):
    """ok, error, late, unanswered, answered twice, and an answer to nobody."""
    at = lambda s: START + timedelta(seconds=s)
    end = [("end", at(500))]
    asked = [("a", at(1)), ("b", at(2)), ("c", at(3)), ("d", at(4)), ("e", at(5))]
    given = [
        ("a", '{"correlationId":"a","probCtWin":0.25}', at(3), 0, 1),
        ("b", '{"correlationId":"b","error":"no model"}', at(4), 0, 2),
        ("c", '{"correlationId":"c","probCtWin":0.5}', at(14), 0, 3),
        ("e", '{"correlationId":"e","probCtWin":0.75}', at(6), 0, 4),
        ("x", '{"correlationId":"x","probCtWin":1.0}', at(6), 0, 5),
        ("x", None, at(6), 0, 6),
        ("x", "{", at(6), 0, 7),
    ]
    again = [("e", '{"correlationId":"e","probCtWin":0.1}', at(8), 0, 8)]
    last = [("end", '{"correlationId":"end","probCtWin":0.1}', at(501), 0, 9), ("z", "{", at(600), 0, 10)]
    ask_schema = "correlation_id string, requested_at timestamp"
    requests, responses = f"{tmp_path}/requests", f"{tmp_path}/responses"
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        rows = []
        stream = live.live_matches(
            spark.readStream.schema(ask_schema).parquet(requests) if _made(spark, asked, ask_schema, requests) else None,
            kafka.read_files(spark, responses) if _made(spark, given, kafka.LOG_SCHEMA, responses) else None,
        )
        query = (
            stream.writeStream.outputMode("append")
            .option("checkpointLocation", f"{tmp_path}/c")
            .foreachBatch(lambda df, _: rows.extend(map(tuple, df.drop("requested_at").collect())))
            .start()
        )
        query.processAllAvailable()
        _made(spark, again, kafka.LOG_SCHEMA, responses)
        query.processAllAvailable()
        _made(spark, end, ask_schema, requests)
        _made(spark, last, kafka.LOG_SCHEMA, responses)
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    want = {
        ("a", "ok", 0.25, None),
        ("b", "error", None, "no model"),
        ("c", "timeout", None, None),
        ("d", "timeout", None, None),
        ("e", "ok", 0.75, None),
    }
    assert {r for r in rows if r[0] != "end"} == want and len([r for r in rows if r[0] != "end"]) == 5
    batch = match_responses(
        spark.createDataFrame(asked, ask_schema),
        read_responses(spark.createDataFrame(given + again, kafka.LOG_SCHEMA)),
    )
    assert {tuple(r) for r in batch.drop("requested_at").collect()} == want


def _made(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return True


def test_checkpoint_folders(spark, tmp_path):
    fresh = [kafka.checkpoint_location(spark, "p", str(tmp_path)) for _ in range(2)]
    assert fresh[0] != fresh[1]
    assert kafka.checkpoint_location(spark, "p", str(tmp_path), resume=True) == f"{tmp_path}/p"


def test_console_takes_the_typed_columns(spark, tmp_path):
    write_chunks(derived.prediction_log(spark, "/root/testdata/sf0.001"), f"{tmp_path}/in", 1)
    rows = read_predictions(kafka.read_files(spark, f"{tmp_path}/in")).select("session_key", "round", "prob_ct_win")
    query = kafka.writer(rows, "shown", mode="console", available_now=True, checkpoint_root=str(tmp_path)).start()
    assert query.awaitTermination(120)
    progress = query.lastProgress
    assert "Console" in progress["sink"]["description"] and progress["numInputRows"] == 1000


def test_one_stream_takes_files_of_bounded_rows_in_order(spark, sf_dir, tmp_path, monkeypatch):
    log = derived.telemetry(spark, sf_dir).withColumn("timestamp", F.when(F.col("offset") != 7, F.col("timestamp")))
    rows = log.count()
    monkeypatch.setattr(queries, "CHUNK_ROWS", rows // 6)
    placed, n = queries._by_position(log)
    queries._publish(placed, n, f"{tmp_path}/in")
    batches = []
    query = (
        spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        .writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c")
        .foreachBatch(lambda df, _: batches.append(df.agg(F.count("*"), F.min("timestamp"), F.max("timestamp"), F.count("timestamp")).first()))
        .start()
    )
    assert query.awaitTermination(300)
    assert n >= 6 and len(batches) == n and sum(b[0] for b in batches) == rows and max(b[0] for b in batches) <= 1.5 * rows / 6
    assert sum(b[3] for b in batches) == rows - 1  # the row without time is there
    assert all(a[2] <= b[1] for a, b in zip(batches, batches[1:]))
    assert compare(spark, sf_dir, "live_features") is None


def test_python_is_called_once_a_bucket(spark, sf_dir, tmp_path):
    """However many sessions a log has, the state has as many keys as buckets; results are those of the batch form."""
    raw = derived.telemetry(spark, sf_dir, True)
    assert raw.select("key").distinct().count() > 3
    write_chunks(raw, f"{tmp_path}/in", 3)
    closing(spark, raw, f"{tmp_path}/in")
    want = rows_of(rounds.tick_features(rounds.timeline(parse_events(raw))))
    files = lambda: kafka.read_files(spark, f"{tmp_path}/in", files_per_trigger=1)
    for name, stream, ticks in (
        ("plain", live_features(files(), ["arena"], 5, buckets=3), lambda df: df),
        ("ordered", live_features_in_order(files(), 60, hot=["arena"], salts=5, idle_ms=None, buckets=3), on_time),
    ):
        out, keys = f"{tmp_path}/{name}", []
        query = kafka.writer(stream, name, mode="parquet", path=out, available_now=True, checkpoint_root=f"{tmp_path}/checkpoints").start()
        assert query.awaitTermination(300)
        keys = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert keys and max(keys) <= 3
        assert rows_of(ticks(spark.read.schema(stream.schema).parquet(out))) == want
