"""The streaming jobs: live predictions, request answering, response matching, live summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchpulse.operators.history import as_percentages, first_ticks, latest_by_session, read_predictions
from matchpulse.operators.matching import TIMEOUT_SECONDS, outcome_columns, read_responses
from matchpulse.operators.requests import answer_requests
from matchpulse.operators.scoring import encode_predictions, score
from matchpulse.streaming.state import live_features, packed, unpacked


def live_predictions(raw: DataFrame, model: PipelineModel, hot: list[str] | None = None) -> DataFrame:
    """The four typed columns, as the console shows them."""
    return score(live_features(raw, hot), model)


def live_prediction_messages(raw: DataFrame, model: PipelineModel, hot: list[str] | None = None) -> DataFrame:
    return encode_predictions(live_predictions(raw, model, hot))


def live_answers(raw_requests: DataFrame, model: PipelineModel) -> DataFrame:
    """A micro-batch of requests is scored in one transform."""
    return answer_requests(raw_requests, model)


BUCKETS = 64
_OUTCOMES = "correlation_id string, micros bigint, answered boolean, prob_ct_win double, error string"


def _decided(rows: pd.DataFrame, passed: int, limit: int) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
    """Requests that are answered or timed out once everything up to ``passed`` has come, the rows that go on waiting, the next moment to look.

    A first answer counts when the time has passed it, so no earlier one can come; a timeout when the limit has passed.
    """
    asked = rows[rows["asks"]].drop_duplicates(["correlation_id", "micros"])
    given = rows[~rows["asks"]]
    pairs = asked[["correlation_id", "micros"]].merge(given, on="correlation_id", suffixes=("", "_given"))
    in_time = (pairs["micros_given"] >= pairs["micros"]) & (pairs["micros_given"] < pairs["micros"] + limit)
    first = pairs[in_time].sort_values(["micros_given", "partition", "offset"]).drop_duplicates(["correlation_id", "micros"])
    found = asked[["correlation_id", "micros"]].merge(
        first[["correlation_id", "micros", "micros_given", "prob_ct_win", "error"]], on=["correlation_id", "micros"], how="left"
    )
    due = found["micros_given"].fillna(found["micros"] + limit).astype("int64")
    out = found[due <= passed].assign(answered=lambda x: x["micros_given"].notna())
    waiting = pd.concat([asked[(due > passed).to_numpy()], given[given["micros"] > passed]], ignore_index=True)
    moments = [due[due > passed].min(), given.loc[given["micros"] > passed, "micros"].max()]
    moments = [int(x) for x in moments if pd.notna(x)]
    return out[["correlation_id", "micros", "answered", "prob_ct_win", "error"]], waiting, min(moments, default=None)


def live_matches(requests: DataFrame, raw_responses: DataFrame, seconds: int = TIMEOUT_SECONDS, delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """Requests (correlation_id, requested_at) with their response, or a timeout, on event time.

    Ids are dealt to buckets. A bucket keeps its undecided requests and the responses that the watermark has not passed; an
    event-time timer wakes it when the next request is due, so an answer comes out as soon as the watermark passes it and a
    timeout as soon as it passes the limit. Both streams may be out of order by ``delay``. Of several responses inside the limit
    the first counts, by (responded_at, partition, offset), as in batch.
    """
    none = lambda t: F.lit(None).cast(t)
    bucket = F.pmod(F.xxhash64("correlation_id"), F.lit(buckets)).cast("int").alias("bucket")
    asked = requests.withWatermark("requested_at", delay).select(
        bucket, F.lit(True).alias("asks"), "correlation_id", F.col("requested_at").alias("at"), F.unix_micros("requested_at").alias("micros"),
        none("int").alias("partition"), none("bigint").alias("offset"), none("double").alias("prob_ct_win"), none("string").alias("error"),
    )
    given = read_responses(raw_responses.withWatermark("timestamp", delay)).select(
        bucket, F.lit(False).alias("asks"), "correlation_id", F.col("responded_at").alias("at"), F.unix_micros("responded_at").alias("micros"),
        "partition", "offset", "prob_ct_win", "error",
    )
    both = asked.unionByName(given)
    kept = to_arrow_schema(both.drop("at").schema)
    limit = seconds * 1_000_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        held = unpacked(state.get[0]) if state.exists else None
        parts = [x for x in (held, *(b.drop(columns="at") for b in batches)) if x is not None and len(x)]
        out, waiting, moment = _decided(pd.concat(parts or [kept.empty_table().to_pandas()], ignore_index=True), watermark * 1000, limit)
        if len(waiting):
            state.update((packed(waiting, kept),))
            state.setTimeoutTimestamp(max(watermark + 1, moment // 1000))
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    rows = both.groupBy("bucket").applyInPandasWithState(run, _OUTCOMES, "waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
    answer = F.struct("prob_ct_win", "error").alias("answer")
    return rows.select("correlation_id", F.timestamp_micros("micros").alias("requested_at"), "answered", answer).select(
        "correlation_id", "requested_at", *outcome_columns(F.col("answered"))
    )


def live_latest_by_session(raw_predictions: DataFrame) -> DataFrame:
    """The latest prediction of each session, as updates; one fixed-width state row per session."""
    return latest_by_session(read_predictions(raw_predictions))


def live_first_ticks(raw_predictions: DataFrame) -> DataFrame:
    """The tick that opened each round of a session, as updates: a round that shows up is a new round."""
    return first_ticks(read_predictions(raw_predictions))


def round_totals(predictions: DataFrame, by: tuple[str, ...] = ("round",)) -> DataFrame:
    """Last probability and number of ticks per group: what a live summary starts from."""
    return predictions.groupBy(*by).agg(F.max_by("prob_ct_win", "seq").alias("last_prob"), F.count(F.lit(1)).alias("ticks"))


def live_round_summary(
    raw_predictions: DataFrame,
    by: tuple[str, ...] = ("round",),
    seed: DataFrame | None = None,
    markers: DataFrame | None = None,
) -> DataFrame:
    """Running round summary; write with output mode update (or complete). One state row per group.

    ``seed`` (from :func:`round_totals` over the history before the stream) is added to what the stream
    brings. Predictions up to the last of the clear ``markers`` (seq) are left out; a clear while the
    stream runs is a new start with the new marker and no seed.
    """
    predictions = read_predictions(raw_predictions)
    if markers is not None and (last := markers.agg(F.max("seq")).first()[0]) is not None:
        predictions = predictions.filter(F.col("seq") > last)
    totals = round_totals(predictions, by)
    if seed is not None:
        before = seed.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("ticks").alias("_ticks"))
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
        ticks = F.col("ticks") + F.coalesce("_ticks", F.lit(0))
        totals = totals.join(before, same, "left").select(*by, "last_prob", ticks.alias("ticks"))
    return as_percentages(totals, by)
