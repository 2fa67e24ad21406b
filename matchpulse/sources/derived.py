"""Message logs derived row by row from the ``events`` table, for queries, tests and the bench.

Each row of ``events`` becomes one message, and the work grows with the table. A message is some
hundred times its row, so the rows are dealt to tasks before messages are made: a table of few files or row
groups would make and decode them in few tasks. A third of all rows belong to the session ``arena`` and a
twelfth have no key, so every query meets a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Messages that one task makes, about.
TASK_ROWS = 100_000
EVENT_LOG = ("event_id", "event_type", "timestamp", "key", "rn", "partition", "offset")


def _div(column: Column, by: int) -> Column:
    return F.floor(column / by).cast("bigint")


def instant(ntz: Column) -> Column:
    """A zone-less UTC timestamp as an instant, whatever the session time zone."""
    return F.concat(ntz.cast("string"), F.lit("Z")).cast("timestamp")


def _dealt(events: DataFrame) -> DataFrame:
    """The rows in ranges of time, TASK_ROWS each and one per core at least."""
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // TASK_ROWS))
    return events.repartitionByRange(tasks, "ts", "event_id")


def event_log(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    """``events`` with the session each row plays in and its running number there (``rn``); ``dealt`` to tasks unless no messages are made of it."""
    E = F.col("event_id")
    hot, keyless = E % 3 == 0, E % 12 == 11
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    return (_dealt(events) if dealt else events).select(
        "event_id",
        "event_type",
        instant(F.col("ts")).alias("timestamp"),
        F.when(hot, F.lit("arena"))
        .when(~keyless, F.concat_ws("-", F.lit("m"), _div(E, 4800).cast("string"), (E % 12).cast("string")))
        .alias("key"),
        F.when(hot, _div(E, 3)).when(keyless, _div(E, 12)).otherwise(_div(E % 4800, 12)).alias("rn"),
        (_div(E, 5) % 2).cast("int").alias("partition"),
        E.alias("offset"),
    )


def _text(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _object(**fields: Column) -> Column:
    """A JSON object of values that are JSON text already, null ones left out. No string of the telemetry needs escaping."""
    named = [F.concat(F.lit(f'"{name}":'), value.cast("string")) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))


def _player(log_rn: Column, pid: Column) -> Column:
    """A player's entry as one text: an event that has a message has an id, so no number is null here."""
    E = F.col("event_id")
    kills = F.floor((log_rn % 4000) * (pid + 1) / 25) - F.when(E % 97 == 0, 3).otherwise(0)
    health = F.when((E * 7 + pid * 13) % 4 == 0, 0).otherwise((E * 11 + pid * 29) % 100 + 1)
    return F.concat(
        F.lit('"p'), pid.cast("string"),
        F.when(pid < 5, '":{"team":"CT","state":{"health":').otherwise('":{"team":"T","state":{"health":'), health.cast("string"),
        F.lit(',"round_kills":0,"round_totaldmg":'), (((log_rn % 20) * (pid + 1) * 3) % 150).cast("string"),
        F.lit('},"match_stats":{"kills":'), kills.cast("string"), F.lit("}}"),
    )


def telemetry(spark: SparkSession, sf_dir: str, disordered: bool = False) -> DataFrame:
    """Raw telemetry messages: key, JSON value, timestamp, partition, offset.

    ``disordered`` mixes up rounds and phases: regressions, round 0, negative rounds, repeated
    and missing starts and archives.
    """
    return telemetry_of(event_log(spark, sf_dir), disordered)


def telemetry_of(log: DataFrame, disordered: bool = False) -> DataFrame:
    """The telemetry messages of rows of :func:`event_log`; columns that these do not have stay beside."""
    E = F.col("event_id")
    rn, step = F.col("rn"), F.col("rn") % 20
    if disordered:
        round_num = _div(rn, 7) - _div(E, 5) % 3
        phase = (
            F.when(F.col("event_type") == "signup", "freezetime")
            .when(F.col("event_type") == "error", "over")
            .when(F.col("event_type") == "view", "bomb")
            .otherwise("live")
        )
        in_game = F.lit(True)
    else:
        round_num = _div(rn, 20) + 1
        phase = (
            F.when(step < 2, "freezetime").when(step < 14, "live").when(step < 17, "bomb").when(step < 19, "over")
        )
        in_game = step < 19
    tenths = E % 1150
    ends_in = F.when(E % 59 == 0, F.lit("soon")).when(
        E % 53 != 0, F.concat(_div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    )
    pids = F.filter(
        F.sequence(F.lit(0), F.lit(9)), lambda pid: ~((pid >= 7) & ((E + pid) % 5 == 0))
    )
    players = F.transform(pids, lambda pid: _player(rn, pid))
    body = _object(
        provider=_object(steamid=_text(F.col("key"))),
        map=F.when(
            in_game, _object(round=F.when(E % 227 != 9, round_num.cast("int")), phase=F.lit('"live"'))
        ),
        round=_object(phase=_text(phase)),
        phase_countdowns=_object(phase=_text(phase), phase_ends_in=_text(ends_in)),
        allplayers=F.concat(F.lit("{"), F.concat_ws(",", players), F.lit("}")),
    )
    value = F.when(E % 211 == 5, F.lit('{"map": {')).when(E % 223 != 7, body)
    beside = [c for c in log.columns if c not in EVENT_LOG]
    return log.select("key", value.alias("value"), "timestamp", "partition", "offset", *beside)


def probability() -> Column:
    """A probability with six decimals that JSON carries exactly enough to round back."""
    E = F.col("event_id")
    return (E * 7919 % 1000001) / F.lit(1000000.0)


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction messages with tombstones, unreadable and blank rows, numbers as text, old rows in seconds."""
    E = F.col("event_id")
    log = event_log(spark, sf_dir)
    seconds = F.unix_seconds("timestamp")
    body = F.to_json(
        F.struct(
            F.col("key").alias("sessionKey"),
            (_div(F.col("rn"), 20) % 30 + 1).cast("int").alias("round"),
            probability().alias("probCtWin"),
            F.when(E % 10 == 4, seconds).otherwise(seconds * 1000).alias("timestamp"),
        )
    )
    loose = F.concat(
        F.lit('{"sessionKey":"loose","round":3.0,"probCtWin":"'),
        probability().cast("decimal(7,6)").cast("string"),
        F.lit('","timestamp":1.7e12}'),
    )
    value = (
        F.when(E % 101 == 3, F.lit("not json"))
        .when(E % 109 == 7, F.lit("  "))
        .when(E % 113 == 9, loose)
        .when(E % 103 != 2, body)
    )
    return log.select("key", value.alias("value"), "timestamp", "partition", "offset")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests, one per event: some out of range, some incomplete, some unreadable."""
    E = F.col("event_id")
    log = event_log(spark, sf_dir)
    fields = {
        "ctAlive": F.when(E % 41 != 1, E % 6),
        "tAlive": _div(E, 6) % 6,
        "ctTotalHp": (E % 6) * (E % 100 + 1) + F.when(E % 37 == 2, 600).otherwise(0),
        "tTotalHp": (_div(E, 6) % 6) * (E % 100 + 1),
        "bombPlanted": E % 2,
        "remainingTime": (E % 1250) / F.lit(10.0),
        "ctAliveKillsPrev3": E % 17,
        "ctAliveDamagePrev3": E % 1500 * 2 + F.when(E % 43 == 3, 9000).otherwise(0),
        "tAliveKillsPrev3": E % 16 - F.when(E % 47 == 4, 20).otherwise(0),
        "tAliveDamagePrev3": E % 1100,
    }
    body = F.to_json(
        F.struct(
            F.when(E % 61 != 6, F.concat(F.lit("r"), E.cast("string"))).alias("correlationId"),
            *[column.alias(name) for name, column in fields.items()],
            F.lit("ignored").alias("note"),
        )
    )
    value = (
        F.when(E % 89 == 8, F.lit('{"correlationId": '))
        .when(E % 83 == 7, F.concat(F.lit('{"correlationId":"r'), E.cast("string"), F.lit('","remainingTime":"NaN"}')))
        .when(E % 79 == 5, F.concat(F.lit('{"correlationId":"r'), E.cast("string"), F.lit('","ctAlive":"many"}')))
        .otherwise(body)
    )
    return log.select(
        F.concat(F.lit("r"), E.cast("string")).alias("key"), value.alias("value"), "timestamp", "partition", "offset"
    )


def response_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to the requests: some missing, late, twice, failed or answering nobody."""
    E = F.col("event_id")
    log = event_log(spark, sf_dir)
    copies = F.when(E % 7 == 3, 0).when(E % 5 == 1, 2).otherwise(1)
    seconds = F.unix_seconds("timestamp")
    delay = E % 15 - F.when(E % 29 == 0, 5).otherwise(0) + F.col("copy")
    correlation_id = F.concat(F.when(E % 31 == 2, F.lit("x")).otherwise(F.lit("r")), E.cast("string"))
    body = F.to_json(
        F.struct(
            correlation_id.alias("correlationId"),
            F.when(E % 13 != 4, (E * 7919 + F.col("copy")) % 1000001 / F.lit(1000000.0)).alias("probCtWin"),
            F.when(E % 13 == 4, F.lit("model failed")).alias("error"),
        )
    )
    value = F.when(E % 107 == 6, F.lit("{")).when(E % 109 != 5, body)
    return (
        log.withColumn("copies", copies)
        .filter("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select(
            correlation_id.alias("key"),
            value.alias("value"),
            F.timestamp_seconds(seconds + delay).alias("timestamp"),
            "partition",
            (F.col("offset") * 2 + F.col("copy")).alias("offset"),
        )
    )
