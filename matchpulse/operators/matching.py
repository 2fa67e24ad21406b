"""Pair scoring requests with their responses by correlation id, within a time limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchpulse.functions import expressions as X

TIMEOUT_SECONDS = 10


def read_responses(raw: DataFrame) -> DataFrame:
    """Response messages decoded; null values and unreadable bodies are skipped."""
    body = F.from_json(
        F.col("value").cast("string"),
        "correlationId string, probCtWin double, error string, _corrupt string",
        {"columnNameOfCorruptRecord": "_corrupt"},
    )
    log = [c for c in ("partition", "offset") if c in raw.columns]
    return (
        raw.filter(F.col("value").isNotNull())
        .select(X.once(body).alias("body"), F.col("timestamp").alias("responded_at"), *log)
        .filter(F.col("body._corrupt").isNull() & F.col("body.correlationId").isNotNull())
        .select(
            F.col("body.correlationId").alias("correlation_id"),
            "responded_at",
            F.col("body.probCtWin").alias("prob_ct_win"),
            F.col("body.error").alias("error"),
            *log,
        )
    )


def _window(at: Column, seconds: int) -> Column:
    return F.floor(at.cast("double") / seconds).cast("bigint")


def match_responses(requests: DataFrame, responses: DataFrame, seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """Each request (correlation_id, requested_at) with its first response inside the limit.

    ``status`` is ok, error or timeout. Responses to nobody, before the request or after the
    limit count for nothing, and so do all but the first.

    Joined on (id, time window of the limit's length), a request standing in the two windows it
    can be answered in: copies of one id sent over a long time spread over windows and mostly
    meet no request. The first response is picked with a map-side minimum.
    """
    start = _window(F.col("requested_at"), seconds)
    asked = (
        requests.select("correlation_id", "requested_at", F.explode(F.array(start, start + 1)).alias("window"))
        .repartition("correlation_id", "window")  # the join's own partitioning, so dropping repeats costs no shuffle
        .distinct()
    )
    given = responses.select(
        "correlation_id",
        "responded_at",
        _window(F.col("responded_at"), seconds).alias("window"),
        arrival().alias("arrival"),
        F.struct("prob_ct_win", "error").alias("answer"),
    )
    in_time = (F.col("responded_at") >= F.col("requested_at")) & (
        F.col("responded_at") < F.col("requested_at") + F.make_dt_interval(secs=F.lit(seconds))
    )
    a, g = asked.alias("a"), given.alias("g")
    same = (F.col("a.correlation_id") == F.col("g.correlation_id")) & (F.col("a.window") == F.col("g.window"))
    return (
        a.join(g, same & in_time, "left")
        .groupBy("a.correlation_id", "requested_at")
        .agg(F.min_by("answer", "arrival").alias("answer"), F.min("arrival").alias("arrival"))
        .select("correlation_id", "requested_at", *outcome_columns(F.col("arrival").isNotNull()))
    )


def arrival() -> Column:
    return F.struct("responded_at", "partition", "offset")


def outcome_columns(answered: Column) -> list[Column]:
    failed = F.coalesce(F.col("answer.error"), F.lit("")) != ""
    return [
        F.when(~answered, "timeout").when(failed, "error").otherwise("ok").alias("status"),
        F.when(answered & ~failed, F.col("answer.prob_ct_win")).alias("prob_ct_win"),
        F.when(answered & failed, F.col("answer.error")).alias("error"),
    ]
