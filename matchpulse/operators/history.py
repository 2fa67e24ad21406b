"""The prediction log: decoding it and summarising it by session and round.

Arrival order is (partition, offset) throughout, as one number ``seq``. Summaries keep one row per
group through map-side hash aggregates over fixed-width values; numbering, listing and taking the
newest rows need an order inside groups, and that runs on slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchpulse.functions import expressions as X
from matchpulse.operators.slices import cut_by, row_numbers
from matchpulse.sources import ledger
from matchpulse.sources.staging import staged

#: seq = partition * 2^48 + offset: room for 32,768 partitions.
OFFSET_BITS = 48
PAGE_TICKS = 4096
_MAX_INT = 2**31 - 1
HISTORY = (
    "session_key string, round int, prob_ct_win double, timestamp_ms bigint, arrived_at timestamp, partition int, offset bigint, seq bigint"
)
#: Up to so many newest rows of a session are taken by a limit inside tasks; more are counted over slices.
FEW = 10_000
#: The rows of a session are dealt to so many parts before the last limit.
LIMIT_PARTS = 64


def sequence() -> Column:
    """The place of a message in its log as one number."""
    return (F.col("partition").cast("bigint") * F.lit(1 << OFFSET_BITS) + F.col("offset")).alias("seq")


def _decoded(raw: DataFrame) -> DataFrame:
    """Values that are not null, with the body's fields as text; body is null or _corrupt set if unreadable."""
    body = F.from_json(
        F.col("value").cast("string"),
        "sessionKey string, round string, probCtWin string, timestamp string, _corrupt string",
        {"columnNameOfCorruptRecord": "_corrupt"},
    )
    return raw.filter(F.col("value").isNotNull()).select(
        X.once(body).alias("body"),
        F.col("timestamp").alias("arrived_at"),
        *[F.col(c) if c in raw.columns else F.lit(0).cast(t).alias(c) for c, t in (("partition", "int"), ("offset", "bigint"))],
    )


def _readable() -> Column:
    return F.col("body").isNotNull() & F.col("body._corrupt").isNull()


def _whole(field: str, most: int) -> Column:
    """A number given as 3, 3.0 or "3"; what is no number or too large counts as absent."""
    number = X.finite(F.col(f"body.{field}").try_cast("double"))
    return F.when(F.abs(number) <= most, number.cast("bigint"))


def read_predictions(raw: DataFrame) -> DataFrame:
    """Prediction messages as rows; tombstones, blank and unreadable values are skipped, seconds become ms.

    Numbers may come with a fraction, an exponent or as text.
    """
    return _as_predictions(_decoded(raw).filter(_readable()))


def _as_predictions(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        F.col("body.sessionKey").alias("session_key"),
        _whole("round", _MAX_INT).cast("int").alias("round"),
        F.col("body.probCtWin").try_cast("double").alias("prob_ct_win"),
        X.to_epoch_ms(_whole("timestamp", 1 << 52)).alias("timestamp_ms"),
        "arrived_at",
        "partition",
        "offset",
        sequence(),
    )


def unreadable_predictions(raw: DataFrame) -> DataFrame:
    """How many values of each partition could not be read."""
    bad = _decoded(raw).filter(~_readable())
    return bad.groupBy("partition").agg(F.count(F.lit(1)).alias("unreadable"))


def observed_predictions(raw: DataFrame, observation: Observation | str) -> DataFrame:
    """As :func:`read_predictions`, counting in the same pass: messages, unreadable and readable ones.

    With an ``Observation`` the counts are there after the first action; on a stream, where a name is given, they
    stand in the progress of every micro-batch.
    """
    counts = (
        F.count(F.lit(1)).alias("messages"),
        F.count_if(~_readable()).alias("unreadable"),
        F.count_if(_readable()).alias("readable"),
    )
    return _as_predictions(_decoded(raw).observe(observation, *counts).filter(_readable()))


def append_history(predictions: DataFrame, path: str) -> None:
    """Append to the history table; arrival columns keep the order."""
    predictions.write.mode("append").parquet(path)


def append_history_once(predictions: DataFrame, root: str, query: str, batch: int) -> bool:
    """Append a batch of a query to the history below ``root``; a batch that is there already changes nothing."""
    return ledger.publish(predictions, root, query, batch)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The history of :func:`append_history_once`, each message once."""
    return ledger.each_message_once(ledger.read(spark, root, HISTORY)).drop("query", "batch")


def round_history_nested(predictions: DataFrame, slices: int | None = None) -> DataFrame:
    """Tick lists per session and round, in arrival order.

    A list holds PAGE_TICKS ticks; a longer round goes on in further pages (page 1, 2, ...), so no list
    outgrows a task however many ticks a round has.
    """
    numbered = tick_index(predictions, slices=slices)
    return (
        numbered.withColumn("page", F.floor((F.col("tick") - 1) / PAGE_TICKS).cast("bigint"))
        .groupBy("session_key", "round", "page")
        .agg(F.sort_array(F.collect_list(F.struct("tick", "seq", "prob_ct_win", "timestamp_ms"))).alias("ticks"))
    )


def history_snapshot(predictions: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """The flat list and the nested view; written below ``path`` when one is given."""
    snapshot = {"predictions": predictions, "round_history": round_history_nested(predictions)}
    for name, df in snapshot.items() if path else ():
        df.write.parquet(f"{path}/{name}")
    return snapshot


def _picked(df: DataFrame, by: list[str], pick: str) -> DataFrame:
    """Each group's row of the least or greatest seq (``pick``: min or max).

    Fixed-width columns come along in the same hash aggregate; if there are others besides the
    keys, a second pass fetches the picked rows by seq.
    """
    by_seq, extreme = getattr(F, f"{pick}_by"), getattr(F, pick)
    others = [f for f in df.schema if f.name not in by and f.name != "seq"]
    if any(isinstance(f.dataType, T.StringType) for f in others):
        return df.join(df.groupBy(*by).agg(extreme("seq").alias("seq")).select("seq"), "seq", "left_semi")
    values = [by_seq(f.name, "seq").alias(f.name) for f in others]
    return df.groupBy(*by).agg(extreme("seq").alias("seq"), *values).select(df.columns)


def latest_prediction(predictions: DataFrame) -> DataFrame:
    last = predictions.select(F.max("seq")).scalar()
    return predictions.filter(F.col("seq") == last)


def latest_by_session(predictions: DataFrame) -> DataFrame:
    return _picked(predictions, ["session_key"], "max")


def current_round(predictions: DataFrame) -> DataFrame:
    return latest_prediction(predictions).select("round")


def with_outcome(predictions: DataFrame) -> DataFrame:
    """Add the favoured side, the whole percentage and the short session id."""
    return predictions.withColumns(
        {
            "outcome": X.outcome(F.col("prob_ct_win")),
            "ct_percent": X.whole_percent(F.col("prob_ct_win")),
            "session_label": X.short_session(F.col("session_key")),
        }
    )


def session_series(predictions: DataFrame) -> DataFrame:
    """Chart points, sorted by session and arrival; a range sort, so a hot session spreads out.

    The points are written first, so that sampling the ranges does not decode the log once more.
    """
    points = staged(
        predictions.select("session_key", "seq", F.col("timestamp_ms").alias("x"), F.col("prob_ct_win").alias("y")), "points"
    )
    label = X.short_session(F.col("session_key")).alias("session_label")
    return points.orderBy("session_key", "seq").select("session_key", label, "x", "y")


def round_summary(predictions: DataFrame, by: tuple[str, ...] = ("round",)) -> DataFrame:
    """Last probability as percentages and the number of ticks; also runs as a stream."""
    return as_percentages(
        predictions.groupBy(*by).agg(F.max_by("prob_ct_win", "seq").alias("last_prob"), F.count(F.lit(1)).alias("ticks")), by
    )


def as_percentages(summary: DataFrame, by: tuple[str, ...]) -> DataFrame:
    percent = X.whole_percent(F.col("last_prob"))
    return summary.select(*by, percent.alias("ct_percent"), (F.lit(100) - percent).alias("t_percent"), "ticks")


def tick_index(
    predictions: DataFrame, by: tuple[str, ...] = ("session_key", "round"), slices: int | None = None
) -> DataFrame:
    """Number the ticks of each round 1..N in arrival order."""
    cut = cut_by(predictions, "seq", "ticks", slices)
    return row_numbers(cut, list(by), ["seq"], "tick")


def first_ticks(predictions: DataFrame, by: tuple[str, ...] = ("session_key", "round")) -> DataFrame:
    """The tick that opened each round."""
    return _picked(predictions, list(by), "min")


def since_last_clear(predictions: DataFrame, markers: DataFrame) -> DataFrame:
    """What arrived after the latest clear marker (by seq); everything when there is none."""
    last = markers.select(F.max("seq")).scalar()
    return predictions.filter(last.isNull() | (F.col("seq") > last))


def last_n(predictions: DataFrame, n: int, slices: int | None = None) -> DataFrame:
    """The newest ``n`` of each session, whatever ``n``.

    A few are taken by a limit inside each task, then per part of a session, then per session, so that what meets is a
    multiple of ``n``. Many are counted from the end over slices. Both give the same rows.
    """
    if n > FEW or slices:
        cut = cut_by(predictions, "seq", "newest", slices)
        return row_numbers(cut, ["session_key"], ["seq"], "age", newest_first=True).filter(F.col("age") <= n).drop("age")
    newest = F.desc("seq")
    part = F.pmod(F.xxhash64("seq"), F.lit(LIMIT_PARTS))
    few = predictions.withColumn("part", part).withColumn("age", F.row_number().over(Window.partitionBy("session_key", "part").orderBy(newest)))
    few = few.filter(F.col("age") <= n).withColumn("age", F.row_number().over(Window.partitionBy("session_key").orderBy(newest)))
    return few.filter(F.col("age") <= n).drop("age", "part")


def folded(predictions: DataFrame) -> DataFrame:
    """One mergeable summary row per session and round: ticks, first and last seq, last probability, sum, least and greatest."""
    prob = F.col("prob_ct_win")
    return predictions.groupBy("session_key", "round").agg(
        F.count(F.lit(1)).alias("ticks"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.max_by(prob, "seq").alias("last_prob"),
        F.sum(F.round(prob * 1_000_000).cast("bigint")).alias("sum_micro"),
        F.min(prob).alias("least"),
        F.max(prob).alias("greatest"),
    )


def merged(*summaries: DataFrame) -> DataFrame:
    """Summaries of several stretches of the history as one."""
    rows = reduce(DataFrame.unionByName, summaries)
    return rows.groupBy("session_key", "round").agg(
        F.sum("ticks").alias("ticks"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.max_by("last_prob", "last_seq").alias("last_prob"),
        F.sum("sum_micro").alias("sum_micro"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
    )


def compacted(kept: DataFrame, summaries: DataFrame | None, new: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Two-tier retention after ``new`` has come: the newest ``n`` messages of each session, and one summary per round of the others.

    ``kept`` and ``summaries`` are what an earlier compaction left. Summary and kept rows together tell what the whole history does.
    """
    held = staged(kept.unionByName(new), "held")
    newest = staged(last_n(held, n), "kept")
    evicted = folded(held.join(newest.select("seq"), "seq", "left_anti"))
    return newest, evicted if summaries is None else merged(summaries, evicted)
