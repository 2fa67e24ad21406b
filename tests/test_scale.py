"""Work is spread over the cores whatever the files of the input and the session's settings are."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchpulse.operators.events import parse_events, slim_timeline
from matchpulse.plans import queries
from matchpulse.sources import derived
from matchpulse.streaming import state
from tests.messages import event, log, player

START = datetime(2024, 1, 1)


@pytest.fixture
def events_dir(spark, tmp_path):
    rows = [(i, "signup" if i % 5 == 0 else "view", START + timedelta(seconds=(i * 37) % 4000)) for i in range(4000)]
    rows += [(None, None, None), (7, "view", None), (7, "view", None)]
    events = spark.createDataFrame(rows, "event_id bigint, event_type string, ts timestamp").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_messages_of_one_file_are_made_in_many_tasks(spark, events_dir, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    dealt = derived.telemetry(spark, events_dir)
    per_task = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 4003 and len(per_task) >= cores - 1 and max(per_task) < 2 * 4003 / cores
    monkeypatch.setattr(derived, "TASK_ROWS", 100)
    assert dealt.columns == derived.telemetry(spark, events_dir).columns
    many = derived.telemetry(spark, events_dir).groupBy(F.spark_partition_id()).count().count()
    assert many > 30
    assert derived.telemetry(spark, events_dir).exceptAll(dealt).isEmpty()


def test_a_place_comes_in_several_files_and_is_one_micro_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "FILE_ROWS", 50)
    rows = spark.range(1000).select(
        F.when(F.col("id") % 100 != 0, F.col("id")).alias("offset"), F.when(F.col("id") < 0, "").alias("key"), (F.col("id") % 5).alias("place")
    )
    # place 3 holds one row without any value, place 4 none at all
    one = spark.sql("select cast(null as bigint) offset, cast(null as string) key, 3L place")
    placed = rows.filter("place < 3").unionByName(one)
    files = queries._publish(placed, 5, f"{tmp_path}/in")
    assert 1 < files == min(200 // 50, spark.sparkContext.defaultParallelism)
    assert len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) == 5 * files
    stream = queries._read_published(spark, f"{tmp_path}/in", placed.drop("place").schema, files)
    assert stream.columns == ["offset", "key"]
    batches = []
    seen = lambda df, _: batches.append((df.count(), df.select(F.collect_set(F.col("offset") % 5)).first()[0]))
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").foreachBatch(seen).start()
    assert query.awaitTermination(300)
    assert batches == [(200, [0]), (200, [1]), (200, [2]), (1, []), (0, [])]


def test_state_partitions_follow_the_cores(spark, events_dir, monkeypatch):
    monkeypatch.setattr(queries, "STATE_TASKS", 1)
    cores = spark.sparkContext.defaultParallelism
    folders = []
    monkeypatch.setattr(queries.staging, "new_folder", lambda s, name, made=queries.staging.new_folder: folders.append(made(s, name)) or folders[-1])
    monkeypatch.setattr(queries, "CHUNKS", 2)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * cores))
    try:
        count = lambda raw: raw.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        updates = queries._through_stream(derived.prediction_log(spark, events_dir), count, "update")
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(3 * cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert updates.groupBy("key").agg(F.max("rows").alias("rows")).select(F.sum("rows")).first()[0] == 4003
    stores = [p for f in folders for p in Path(f).glob("run-*/state/0/*") if p.name.isdigit()]
    assert len(stores) == cores


def test_players_reach_the_state_as_text(spark):
    raw = log(spark, [event("freezetime", 1, {"a": player(kills=2)}), event("over", 1, {"a": player(kills=5, damage=40)}), event("live", 1, {"a": player()})])
    lines = state.dealt(slim_timeline(parse_events(raw)), [])
    assert dict(lines.dtypes)["players"] == "string"
    rows = state.in_order(lines.toPandas())
    history = {}
    sums, after = state.play(rows, 0, False, {}, history)
    assert history == {"a": [(3, 40)]} and after == (1, True) and sums.iloc[0].tolist() == [3, 40, 0, 0]


def test_the_living_reach_the_state_as_text_made_once(spark):
    """Control rows of a hot session go to all salts, but their text is made before that; odd names come back whole."""
    names = ['a"b', "c,d", "e\\u001ff", "[]"]
    raw = log(spark, [event("over", 1, {n: player(kills=1) for n in names}), event("live", 1, {n: player("T" if n == "[]" else "CT") for n in names})])
    lines = state.dealt(slim_timeline(parse_events(raw)), ["s1"], 7)
    assert {t for n, t in lines.dtypes if n in ("alive_ct", "alive_t", "players")} == {"string"}
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(CASE") < plan.index("AS alive_ct") < plan.index("explode(array(from_json")  # deeper is earlier
    rows = {r["kind"]: r for r in lines.collect()}
    assert json.loads(rows["tick"]["alive_ct"]) == names[:3] and json.loads(rows["tick"]["alive_t"]) == ["[]"]
    assert list(state._told(rows["control"]["players"])) == [(n, 1, 0) for n in names]
    assert rows["control"]["alive_ct"] is None and rows["tick"]["players"] is None


def test_messages_are_made_after_the_last_shuffle(spark, events_dir, tmp_path, monkeypatch):
    """Only the rows of events are written and dealt to files; the messages, a hundred times larger, are written once."""
    tables = []
    staged = lambda df, name, *by, write=queries.staging.staged: tables.append((name, df.columns)) or write(df, name, *by)
    monkeypatch.setattr(queries.staging, "staged", staged)
    monkeypatch.setattr(queries, "FILE_ROWS", 200)
    seen = queries._through_telemetry(spark, events_dir, lambda raw: raw)
    assert [name for name, _ in tables] == ["chunks"] and "value" not in tables[0][1]
    want = derived.telemetry(spark, events_dir)
    assert seen.columns == want.columns and seen.count() == 4003
    assert seen.exceptAll(want).isEmpty() and want.exceptAll(seen).isEmpty()


def test_messages_are_the_json_of_their_fields(spark, events_dir):
    """Written as text, they read as JSON without spaces, and null fields are left out."""
    for disordered in (False, True):
        values = [r["value"] for r in derived.telemetry(spark, events_dir, disordered).filter("value like '%allplayers%'").select("value").collect()]
        read = [json.loads(v) for v in values]
        assert len(values) > 3900 and [json.dumps(x, separators=(",", ":")) for x in read] == values
        assert not any("null" in v for v in values) and any("steamid" not in x["provider"] for x in read)
        assert any(len(x["allplayers"]) < 10 for x in read) and any("round" not in x.get("map", {}) for x in read)
        assert all(len(p["state"]) == 3 and len(p["match_stats"]) == 1 for x in read for p in x["allplayers"].values())
