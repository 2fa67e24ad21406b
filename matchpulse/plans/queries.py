"""The registered queries: every operator over the logs derived from the whole ``events`` table.

Whole numbers come out as bigint and probabilities as millionths, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from matchpulse import schemas
from matchpulse.operators import events as E
from matchpulse.operators import history as H
from matchpulse.operators import matching as J
from matchpulse.operators import pages
from matchpulse.operators import requests as Q
from matchpulse.operators import rounds as R
from matchpulse.operators import scoring as S
from matchpulse.operators.slices import cuts_of, place_of, value_grid
from matchpulse.plans.example_model import example_model
from matchpulse.sources import derived, kafka, staging
from matchpulse.streaming import cells, clears, live, state

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _plain(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(n).cast("bigint").alias(n) if t in ("int", "tinyint") else F.col(n) for n, t in df.dtypes]
    )


def millionths(column: str | Column) -> Column:
    return F.floor(F.col(column) * 1000000 + 0.5 if isinstance(column, str) else column * 1000000 + 0.5).cast("bigint")


def tenths() -> Column:
    seconds = F.col("remaining_time").cast("double")
    return F.when(F.isnan(seconds), -1).otherwise(F.floor(seconds * 10 + 0.5)).cast("bigint").alias("remaining_tenths")


def _features() -> list:
    return [tenths() if f == "remaining_time" else f for f in schemas.FEATURES]


def _events(spark: SparkSession, sf_dir: str, disordered: bool = False) -> DataFrame:
    return E.parse_events(derived.telemetry(spark, sf_dir, disordered))


def _timeline(spark: SparkSession, sf_dir: str, disordered: bool = False) -> DataFrame:
    raw = derived.telemetry(spark, sf_dir, disordered)
    return R.timeline(E.parse_events(raw), times=raw.select("timestamp"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = derived.telemetry(spark, sf_dir)
    return R.build_features(E.parse_events(raw), times=raw.select("timestamp"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.read_predictions(derived.prediction_log(spark, sf_dir))


def _prediction_columns(df: DataFrame) -> DataFrame:
    return _plain(
        df.select("session_key", "round", millionths("prob_ct_win").alias("prob_micro"), "timestamp_ms", "offset")
    )


# --- decoding


@query
def parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(
        _events(spark, sf_dir).select(
            "session_key",
            "round_num",
            "round_phase",
            "phase_ends_in",
            "bomb_phase",
            F.size("allplayers").alias("players"),
            F.col("event_timestamp").cast("bigint").alias("second"),
            "offset",
        )
    )


@query
def non_game_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = E.drop_non_game(E.decode_events(derived.telemetry(spark, sf_dir)))
    return kept.select("session_key", "offset")


def _long_players(df: DataFrame) -> DataFrame:
    return _plain(df.select("offset", "player", "team", "health", "kills", F.col("round_totaldmg").alias("damage")))


@query
def explode_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_players(E.explode_players(_events(spark, sf_dir)))


@query
def players_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_players(E.explode_players(E.players_from_json(E.players_json(_events(spark, sf_dir)))))


# --- row-local features


@query
def alive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(E.with_stateless_features(_events(spark, sf_dir)).select("offset", "ct_alive", "t_alive"))


@query
def team_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(E.with_stateless_features(_events(spark, sf_dir)).select("offset", "ct_total_hp", "t_total_hp"))


@query
def bomb_and_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(E.with_stateless_features(_events(spark, sf_dir)).select("offset", "bomb_planted", tenths()))


@query
def stateless_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stateless_columns(E.predictable(E.with_stateless_features(_events(spark, sf_dir))))


def _stateless_columns(featured: DataFrame) -> DataFrame:
    return _plain(
        featured.select(
            "session_key", "offset", "round_num", "ct_alive", "t_alive", "ct_total_hp", "t_total_hp", "bomb_planted", tenths()
        )
    )


# --- round history


def _transitions(spark: SparkSession, sf_dir: str, disordered: bool) -> DataFrame:
    steps = R.transitions(_timeline(spark, sf_dir, disordered))
    return _plain(steps.select("session", "step", "round_num", "second", "offset"))


@query
def round_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir, False)


@query
def round_transitions_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir, True)


@query
def round_transitions_by_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of each match of a session: a low round after higher ones begins a match."""
    steps = R.transitions(R.split_matches(_timeline(spark, sf_dir, True)))
    return _plain(steps.select(F.translate("session", "\x1f", "#").alias("session"), "step", "round_num", "second", "offset"))


@query
def kill_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = R.transitions(_timeline(spark, sf_dir))
    return _plain(R.kill_snapshots(steps).select("session", "round_num", "player", "kills"))


@query
def round_player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = R.staged_transitions(_timeline(spark, sf_dir, True))
    return _plain(R.round_player_stats(steps).select("session", "player", "round_num", "kills", "damage"))


@query
def prev3_player_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = R.staged_history(R.staged_transitions(_timeline(spark, sf_dir)))
    return _plain(history.select("session", "player", "round_num", "kills_prev3", "damage_prev3"))


def _prev3(spark: SparkSession, sf_dir: str, disordered: bool) -> DataFrame:
    return _plain(R.tick_features(_timeline(spark, sf_dir, disordered)).select("offset", *schemas.PREV3))


@query
def prev3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prev3(spark, sf_dir, False)


@query
def prev3_features_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prev3(spark, sf_dir, True)


@query
def prev3_features_by_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of the present match only; an ``over`` of the next round archives too."""
    line = R.split_matches(_timeline(spark, sf_dir, True))
    return _plain(R.tick_features(line, "equal_or_next").select("offset", *schemas.PREV3))


@query
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(
        _built(spark, sf_dir).select("session_key", "round_num", "event_timestamp", *_features())
    )


# --- scoring


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(_built(spark, sf_dir), example_model(spark))


@query
def win_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(
        _scored(spark, sf_dir).select(
            "session_key", "round_num", "event_timestamp", millionths("prob_ct_win").alias("prob_micro")
        )
    )


@query
def prediction_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = S.encode_predictions(_scored(spark, sf_dir))
    read = messages.select("key", F.from_json("value", schemas.PREDICTION).alias("m"))
    return _plain(
        read.select(
            "key",
            F.col("m.sessionKey").alias("session_key"),
            F.col("m.round").alias("round"),
            millionths(F.col("m.probCtWin")).alias("prob_micro"),
            F.col("m.timestamp").alias("timestamp_ms"),
        )
    )


# --- requests


@query
def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = Q.parse_requests(derived.request_log(spark, sf_dir)).select(
        *[F.col(name).alias(field) for name, field in schemas.FEATURES.items()], "timestamp", "partition", "offset"
    )
    sent = Q.make_requests(bodies, ["partition", "offset"])
    return _plain(sent.select("key", F.get_json_object("value", "$.correlationId").alias("correlation_id"), "offset"))


@query
def request_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(Q.parse_requests(derived.request_log(spark, sf_dir)).select("correlation_id", *_features()))


@query
def request_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.dead_letters(derived.request_log(spark, sf_dir)).select("offset")


@query
def request_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = Q.parse_requests(derived.request_log(spark, sf_dir))
    scored = Q.score_requests(requests, example_model(spark))
    return scored.select("correlation_id", millionths("prob_ct_win").alias("prob_micro"), "error")


@query
def response_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_responses(Q.answer_requests(derived.request_log(spark, sf_dir), example_model(spark)))


def _read_responses(messages: DataFrame) -> DataFrame:
    read = messages.select("key", F.from_json("value", schemas.RESPONSE).alias("m"))
    return read.select(
        "key",
        F.col("m.correlationId").alias("correlation_id"),
        millionths(F.col("m.probCtWin")).alias("prob_micro"),
        F.col("m.error").alias("error"),
    )


#: A log comes in this many micro-batches at least, and
CHUNKS = 3
#: about so many rows of it are in a micro-batch,
CHUNK_ROWS = 1_000_000
#: which comes in files of about so many, but not in more than there are cores.
FILE_ROWS = 25_000


def _in_chunks(rows: int) -> int:
    return max(CHUNKS, -(-rows // CHUNK_ROWS))


Messages = Callable[[DataFrame], DataFrame]


def _publish(placed: DataFrame, chunks: int, folder: str, messages: Messages = lambda rows: rows) -> int:
    """A log with the ``place`` of each row as files in that order; a micro-batch takes the files of one place.

    ``messages`` are made of its rows when they are put into files, so that only the rows are written and shuffled before.
    Returns the number of files, the same for every place. Above one each file begins with a ``filler`` row, so that none is left out.
    """
    written = staging.staged(placed, "chunks", "place")
    spark = written.sparkSession
    most = written.groupBy("place").count().agg(F.max("count")).first()[0] or 0
    files = max(1, min(spark.sparkContext.defaultParallelism, most // FILE_ROWS))
    fillers = spark.range(files).select(F.col("id").cast("int").alias("file"), F.lit(True).alias("filler"))
    for i in range(chunks):
        rows = written.filter(F.col("place") == i).drop("place")
        if files == 1:
            rows = rows.coalesce(1)
        else:
            own = F.pmod(F.xxhash64(*rows.columns), F.lit(files)).cast("int")
            every = rows.withColumn("file", own).unionByName(fillers, allowMissingColumns=True)
            rows = every.repartitionById(files, F.col("file")).drop("file")
        messages(rows).write.mode("append").parquet(folder)
    return files


def _read_published(spark: SparkSession, folder: str, schema: StructType, files: int) -> DataFrame:
    """The stream of a published log, a place a micro-batch."""
    reader = spark.readStream.schema(StructType([*schema.fields, StructField("filler", BooleanType())]))
    return reader.option("maxFilesPerTrigger", files).parquet(folder).filter(F.col("filler").isNull()).drop("filler")


def _by_position(log: DataFrame, at: str = "timestamp", least: int = CHUNKS, times: DataFrame | None = None) -> tuple[DataFrame, int]:
    """A log with the place of each row: ranges of time of about CHUNK_ROWS rows; rows without time come first.

    Only the ``times`` (those of the log) are read for the cuts, and the messages stay in the tasks they are made in.
    """
    moment = F.unix_micros(F.col(at)) if log.schema[at].dataType == TimestampType() else F.col(at)
    # rows without time count for the cuts as the first ones, so that the first place is no longer than the others for them
    rows, held = value_grid((log if times is None else times).select(F.coalesce(moment, F.lit(-(2**63))).alias("at")), "at")
    n = max(least, _in_chunks(rows))
    return log.withColumn("place", place_of(moment, cuts_of(held, n)).cast("int")), n


def _side_by_side(logs: dict[str, tuple[DataFrame, str]]) -> tuple[dict[str, DataFrame], int]:
    """Several logs with the places of their rows, cut at the same times."""
    tables = {name: log for name, (log, _) in logs.items()}
    second = {name: F.col(at).cast("bigint") for name, (_, at) in logs.items()}
    spans = [t.agg(F.count(F.lit(1)), F.min(second[n]), F.max(second[n])).first() for n, t in tables.items()]
    n = _in_chunks(max(s[0] for s in spans))
    low = min((s[1] for s in spans if s[1] is not None), default=0)
    high = max((s[2] for s in spans if s[2] is not None), default=0)
    place = {name: F.floor((x - F.lit(low)) * n / F.lit(high - low + 1)).cast("int") for name, x in second.items()}
    return {name: t.withColumn("place", F.coalesce(place[name], F.lit(0))) for name, t in tables.items()}, n


#: State partitions of a stream per core, at most.
STATE_TASKS = 2


def _one_stream(
    logs: dict[str, tuple[DataFrame, int]],
    job: Callable[..., DataFrame],
    output_mode: str = "append",
    without_data: bool = False,
    messages: Messages = lambda rows: rows,
) -> DataFrame:
    """Run one streaming job over the ``messages`` of logs (rows with ``place``, number of places), a place of each a micro-batch.

    Returns what it wrote; with output mode update each row has the number of its ``batch``. Micro-batches
    ``without_data`` let event-time timers fire; a processing-time timeout would ask for them for ever.
    """
    spark = next(iter(logs.values()))[0].sparkSession
    root = staging.new_folder(spark, "stream")
    streams = []
    for name, (placed, chunks) in logs.items():
        files = _publish(placed, chunks, f"{root}/{name}", messages)
        streams.append(_read_published(spark, f"{root}/{name}", messages(placed.drop("place")).schema, files))
    stream = job(*streams)
    run = kafka.writer(stream, "run", "parquet", path=f"{root}/out", available_now=True, checkpoint_root=root, output_mode=output_mode)
    schema = stream.schema
    if output_mode == "update":
        schema = stream.withColumn("batch", F.lit(0).cast("bigint")).schema
        run = run.foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/out"))
    # a session's partitions are meant for whole tables; here every micro-batch would pay for a task and a state store each
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_TASKS * spark.sparkContext.defaultParallelism)
    settings = {"spark.sql.streaming.noDataMicroBatches.enabled": str(without_data).lower(), "spark.sql.shuffle.partitions": str(tasks)}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        run.start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(schema).parquet(f"{root}/out")


def _through_stream(log: DataFrame, job: Callable[[DataFrame], DataFrame], output_mode: str = "append") -> DataFrame:
    return _one_stream({"log": _by_position(log)}, job, output_mode)


def _through_telemetry(spark: SparkSession, sf_dir: str, job: Callable[..., DataFrame], disordered: bool = False) -> DataFrame:
    """As :func:`_through_stream` over the telemetry of ``events``, whose rows are a hundredth of their messages."""
    placed = _by_position(derived.event_log(spark, sf_dir), times=derived.event_log(spark, sf_dir, False))
    return _one_stream({"log": placed}, job, messages=lambda rows: derived.telemetry_of(rows, disordered))


def _live_features(spark: SparkSession, sf_dir: str, job: Callable[..., DataFrame], disordered: bool = False) -> DataFrame:
    hot = state.hot_sessions(derived.event_log(spark, sf_dir, False))
    return _through_telemetry(spark, sf_dir, lambda raw: job(raw, hot), disordered)


@query
def live_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyed round state over a stream of telemetry; the hot session is dealt to several keys."""
    rows = _live_features(spark, sf_dir, lambda raw, hot: state.live_features(raw, hot))
    return _plain(rows.select("session_key", "round_num", "event_timestamp", *_features(), "offset"))


@query
def live_features_by_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round state in cells per player over the log with rounds out of order: each match anew, an ``over`` of the next round archives too."""
    rules = {"reset_on_new_match": True, "archive_rule": "equal_or_next"}
    with cells.rocksdb(spark):
        rows = _live_features(spark, sf_dir, lambda raw, hot: cells.live_features_in_cells(raw, hot, **rules), True)
    return _plain(rows.select("offset", *schemas.PREV3))


#: Rows of the disordered log come up to so many seconds late, in so many micro-batches.
LATE_SECONDS, LATE_CHUNKS = 6 * 3600, 8


@query
def live_features_disordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that arrive hours out of order over several micro-batches are played in event order; closing rows move the watermark."""
    late = F.pmod(F.xxhash64("partition", "offset"), F.lit(LATE_SECONDS))
    arrival = F.col("timestamp").cast("bigint") + late
    times = derived.event_log(spark, sf_dir, False).withColumn("arrival", arrival)
    placed, n = _by_position(derived.event_log(spark, sf_dir).withColumn("arrival", arrival), "arrival", LATE_CHUNKS, times)
    placed, table = placed.drop("arrival"), times.drop("arrival")
    end = staging.staged(table.agg(F.max("timestamp").alias("timestamp")), "end")
    none = {c: F.lit(None).cast(t).alias(c) for c, t in table.dtypes}
    for i in (1, 2, 3):
        later = (F.col("timestamp") + F.make_dt_interval(days=F.lit(i))).alias("timestamp")
        closing = end.select(*[later if c == "timestamp" else none[c] for c in table.columns], F.lit(n + i - 1).alias("place"))
        placed = placed.unionByName(closing)
    hot = state.hot_sessions(table)
    job = lambda raw: state.live_features_in_order(raw, LATE_SECONDS, hot=hot, idle_ms=None)
    rows = state.on_time(_one_stream({"log": (placed, n + 3)}, job, without_data=True, messages=derived.telemetry_of))
    return _plain(rows.select("session_key", "round_num", "event_timestamp", *_features(), "offset"))


@query
def live_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = example_model(spark)
    rows = _live_features(spark, sf_dir, lambda raw, hot: live.live_predictions(raw, model, hot))
    return _plain(rows.select("session_key", "round_num", "event_timestamp", millionths("prob_ct_win").alias("prob_micro")))


@query
def live_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and responses as streams; closing messages move the watermark past the last request."""
    asked = derived.request_log(spark, sf_dir).select(
        F.col("key").alias("correlation_id"), F.col("timestamp").alias("requested_at")
    )
    logs, n = _side_by_side({"requests": (asked, "requested_at"), "responses": (derived.response_log(spark, sf_dir), "timestamp")})
    requests, responses = logs["requests"], logs["responses"]
    last = staging.staged(requests.agg(F.max("requested_at").alias("at")), "last")
    for days in (1, 2, 3):
        at, place = F.col("at") + F.make_dt_interval(days=F.lit(days)), F.lit(n + days - 1).alias("place")
        requests = requests.unionByName(last.select(F.lit("end").alias("correlation_id"), at.alias("requested_at"), place))
        none = [F.lit("end").alias("key"), F.lit('{"correlationId":"end"}').alias("value"), at.alias("timestamp")]
        responses = responses.unionByName(last.select(*none, F.lit(0).alias("partition"), F.lit(days).cast("bigint").alias("offset"), place))
    matched = _one_stream({"requests": (requests, n + 3), "responses": (responses, n + 3)}, live.live_matches)
    return matched.filter("correlation_id <> 'end'").select(
        "correlation_id", "status", millionths("prob_ct_win").alias("prob_micro"), "error"
    )


@query
def live_round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded with the first chunk as history, then updated by the others."""
    placed, n = _by_position(derived.prediction_log(spark, sf_dir))
    table = staging.staged(placed, "log")
    seed = staging.staged(live.round_totals(H.read_predictions(table.filter("place = 0"))), "seed")
    rest = table.filter("place > 0").withColumn("place", F.col("place") - 1)
    updates = _one_stream({"log": (rest, n - 1)}, lambda raw: live.live_round_summary(raw, seed=seed), "update")
    shown = H.as_percentages(seed, ("round",)).withColumn("batch", F.lit(-1).cast("bigint")).unionByName(updates)
    return _plain(_last_updates(shown, ["round"]))


def _last_updates(updates: DataFrame, by: list[str]) -> DataFrame:
    """What a reader of the updates has seen last of each group."""
    values = [c for c in updates.columns if c not in (*by, "batch")]
    return updates.groupBy(*by).agg(*[F.max_by(c, "batch").alias(c) for c in values])


#: Clear markers are the events with this remainder.
CLEAR_EVERY, CLEAR_AT = 300, 217


@query
def live_round_summary_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round summary with clears in mid-stream, as its reader sees it at the end."""
    markers = derived.event_log(spark, sf_dir).filter(F.col("event_id") % CLEAR_EVERY == CLEAR_AT).select("timestamp", "partition", "offset")
    logs, n = _side_by_side({"log": (derived.prediction_log(spark, sf_dir), "timestamp"), "clears": (markers, "timestamp")})
    totals = _one_stream({name: (log, n) for name, log in logs.items()}, clears.live_totals)
    return _plain(clears.shown(totals))


@query
def live_latest_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _through_stream(derived.prediction_log(spark, sf_dir), live.live_latest_by_session, "update")
    return _prediction_columns(_last_updates(updates, ["session_key"]))


@query
def live_first_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _through_stream(derived.prediction_log(spark, sf_dir), live.live_first_ticks, "update")
    return _prediction_columns(_last_updates(updates, ["session_key", "round"]))


@query
def live_response_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = example_model(spark)
    return _read_responses(
        _through_stream(derived.request_log(spark, sf_dir), lambda raw: live.live_answers(raw, model))
    )


@query
def live_prediction_log_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(_through_stream(derived.prediction_log(spark, sf_dir), H.read_predictions))


@query
def live_stateless_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    def job(raw: DataFrame) -> DataFrame:
        return E.predictable(E.with_stateless_features(E.parse_events(raw)))

    return _stateless_columns(_through_telemetry(spark, sf_dir, job))


@query
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = Q.validate_requests(Q.parse_requests(derived.request_log(spark, sf_dir)))
    return checked.select("offset", F.explode("errors").alias("field", "message"))


@query
def round_start_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.event_log(spark, sf_dir)
    sparse = log.select(
        "event_id",
        *[
            F.when(F.col("event_id") % (i + 2) == 0, F.col("event_id") % 100).cast("int").alias(name)
            for i, name in enumerate(schemas.FEATURES)
        ],
    )
    return _plain(Q.round_start_defaults(sparse))


@query
def response_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived.request_log(spark, sf_dir).select(
        F.col("key").alias("correlation_id"), F.col("timestamp").alias("requested_at")
    )
    matched = J.match_responses(requests, J.read_responses(derived.response_log(spark, sf_dir)))
    return matched.select("correlation_id", "status", millionths("prob_ct_win").alias("prob_micro"), "error")


# --- prediction history


@query
def prediction_log_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(_predictions(spark, sf_dir))


@query
def unreadable_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(H.unreadable_predictions(derived.prediction_log(spark, sf_dir)))


def _listed() -> Column:
    """A page's ticks as text."""
    tick = lambda t: F.concat_ws(
        ":", t["tick"].cast("string"), t["seq"].cast("string"), millionths(t["prob_ct_win"]).cast("string"), t["timestamp_ms"].cast("string")
    )
    return F.array_join(F.transform("ticks", tick), ",").alias("ticks")


@query
def round_history_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = H.round_history_nested(_predictions(spark, sf_dir))
    return _plain(pages.select("session_key", "round", "page", _listed()))


def _arrivals(predictions: DataFrame, parts: int = 3) -> list[DataFrame]:
    """The history in stretches of arrival."""
    placed = staging.staged(predictions, "predictions").repartitionByRange(parts, "seq").withColumn("place", F.spark_partition_id())
    table = staging.staged(placed, "arrivals", "place")
    return [table.filter(F.col("place") == i).drop("place") for i in range(parts)]


@query
def round_history_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tick lists kept up by three appends, the second of which comes twice."""
    root = staging.new_folder(spark, "pages")
    first, second, third = _arrivals(_predictions(spark, sf_dir))
    for version, part in ((0, first), (1, second), (1, second), (2, third)):
        pages.append_ticks(part, root, version)
    return _plain(pages.pages(spark, root).select("session_key", "round", "page", _listed()))


@query
def retained_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-tier retention over three compactions: the newest 20 messages a session, a summary per round of the rest."""
    first, *later = _arrivals(_predictions(spark, sf_dir))
    kept, summaries = H.compacted(first.limit(0), None, first, 20)
    for part in later:
        kept, summaries = H.compacted(kept, staging.staged(summaries, "summaries"), part, 20)
    tiers = H.folded(kept).withColumn("tier", F.lit("kept")).unionByName(summaries.withColumn("tier", F.lit("folded")))
    values = ["ticks", "first_seq", "last_seq", "sum_micro"]
    micro = [millionths(c).alias(f"{c}_micro") for c in ("last_prob", "least", "greatest")]
    return _plain(tiers.select("tier", "session_key", "round", *values, *micro))


@query
def history_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written snapshot read again: the nested lists, next to the flat list's counts."""
    folder = staging.new_folder(spark, "snapshot")
    H.history_snapshot(staging.staged(_predictions(spark, sf_dir), "predictions"), folder)
    flat = spark.read.parquet(f"{folder}/predictions").groupBy("session_key", "round")
    counts = flat.agg(F.count(F.lit(1)).alias("predictions")).withColumnsRenamed({"session_key": "s", "round": "r"})
    nested = spark.read.parquet(f"{folder}/round_history").select("session_key", "round", "page", _listed())
    same = F.col("session_key").eqNullSafe(F.col("s")) & F.col("round").eqNullSafe(F.col("r"))
    return _plain(nested.join(counts, same).drop("s", "r"))


@query
def latest_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(H.latest_prediction(_predictions(spark, sf_dir)))


@query
def latest_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(H.latest_by_session(_predictions(spark, sf_dir)))


@query
def current_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(H.current_round(_predictions(spark, sf_dir)))


@query
def outcome_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(
        H.with_outcome(_predictions(spark, sf_dir)).select("offset", "outcome", "ct_percent", "session_label")
    )


@query
def session_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = H.session_series(_predictions(spark, sf_dir))
    return series.select("session_key", "session_label", "x", millionths("y").alias("y_micro"))


@query
def round_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(H.round_summary(_predictions(spark, sf_dir)))


@query
def round_summary_by_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(H.round_summary(_predictions(spark, sf_dir), ("session_key", "round")))


@query
def tick_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(H.tick_index(_predictions(spark, sf_dir)).select("session_key", "round", "offset", "tick"))


@query
def tick_index_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(H.tick_index(_predictions(spark, sf_dir), ("round",)).select("round", "offset", "tick"))


@query
def first_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(H.first_ticks(_predictions(spark, sf_dir)))


@query
def first_ticks_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(H.first_ticks(_predictions(spark, sf_dir), ("round",)))


@query
def since_last_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    clears = derived.event_log(spark, sf_dir).filter(F.col("event_id") % 4000 == 417)
    markers = clears.select(H.sequence())
    return _prediction_columns(H.since_last_clear(_predictions(spark, sf_dir), markers))


@query
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prediction_columns(H.last_n(_predictions(spark, sf_dir), 5))
