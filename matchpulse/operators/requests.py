"""Ad-hoc scoring requests: making, decoding, checking, scoring and answering them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchpulse import schemas
from matchpulse.functions import expressions as X
from matchpulse.operators.scoring import with_probability

_FIELDS = {"correlationId": "correlation_id"} | {field: name for name, field in schemas.FEATURES.items()}
# Numbers are decoded as text, so that "5" and 5.7 can count as 5 and bad ones can be told apart.
_TEXT_SCHEMA = ", ".join(f"{field} string" for field in _FIELDS) + ", _corrupt string"
_MAX_INT = 2**31 - 1
_LOG = ("timestamp", "partition", "offset")


def make_requests(bodies: DataFrame, unique: list[str]) -> DataFrame:
    """Request messages from rows with body fields as columns; all of them are sent.

    The id is made from the ``unique`` columns, so a task that runs again mints the same id. A
    ``correlationId`` in the body wins over the minted one inside the message.
    """
    minted = X.uuid_from(*[F.col(c) for c in unique])
    fields = [c for c in bodies.columns if c not in (*_LOG, "correlationId")]
    own = F.coalesce("correlationId", minted) if "correlationId" in bodies.columns else minted
    return bodies.select(
        minted.alias("key"),
        F.to_json(F.struct(own.alias("correlationId"), *fields)).alias("value"),
        *[c for c in _LOG if c in bodies.columns],
    )


def decode_requests(raw: DataFrame) -> DataFrame:
    """All requests with ``readable``: whether the body, every number and the id can be used.

    Absent or null numbers count as 0; whole-number fields drop a fraction; unknown fields are
    ignored. Log columns (timestamp, partition, offset) are kept.
    """
    body = F.from_json(
        F.col("value").cast("string"), _TEXT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}
    )
    log = [c for c in _LOG if c in raw.columns]
    text = raw.select(X.once(body).alias("body"), "value", *log)

    def number(field: str) -> Column:
        given = F.trim(F.col(f"body.{field}"))
        return F.when(F.coalesce(given, F.lit("")) == "", F.lit(0.0)).otherwise(given.try_cast("double"))

    numbers = text.select(
        "*", *[number(field).alias(name) for name, field in schemas.FEATURES.items()]
    )
    whole = [name for name in schemas.FEATURES if name != "remaining_time"]
    usable = F.col("remaining_time").isNotNull()
    for name in whole:
        usable &= F.coalesce(F.abs(X.finite(F.col(name))) <= _MAX_INT, F.lit(False))
    readable = (
        F.col("value").isNotNull()
        & F.col("body._corrupt").isNull()
        & F.col("body.correlationId").isNotNull()
        & usable
    )
    features = [
        F.col(name).cast("float").alias(name)
        if name == "remaining_time"
        else F.when(F.abs(X.finite(F.col(name))) <= _MAX_INT, F.col(name)).cast("int").alias(name)
        for name in schemas.FEATURES
    ]
    return numbers.select(
        F.col("body.correlationId").alias("correlation_id"), *features, readable.alias("readable"), "value", *log
    )


def parse_requests(raw: DataFrame) -> DataFrame:
    """Readable requests as feature columns."""
    return decode_requests(raw).filter("readable").drop("readable", "value")


def dead_letters(raw: DataFrame) -> DataFrame:
    """Requests that get no answer: nobody to answer to, or not a request."""
    return decode_requests(raw).filter(~F.col("readable")).drop("readable", *schemas.FEATURES)


def score_requests(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """All requests in one transform: ``prob_ct_win``, or ``error`` where the model cannot score.

    A request the model would fail on costs its own answer only: features that are null, NaN or
    infinite are replaced before the transform, and a probability that is no number is an error.
    """
    problems, sound = [], {}
    for name in schemas.FEATURES:
        usable = F.coalesce(X.finite(F.col(name).cast("double")).isNotNull(), F.lit(False))
        problems.append(F.when(~usable, F.lit(f"{name} is not a number")))
        sound[name] = F.when(usable, F.col(name)).otherwise(F.lit(0).cast(requests.schema[name].dataType))
    scored = with_probability(requests.withColumns({"error": F.coalesce(*problems), **sound}), model)
    odd = F.col("prob_ct_win").isNull() | F.isnan("prob_ct_win")
    failed = F.coalesce(F.col("error"), F.when(odd, F.lit("the model gave no probability")))
    return scored.withColumns({"error": failed, "prob_ct_win": F.when(failed.isNull(), F.col("prob_ct_win"))})


def encode_responses(scored: DataFrame) -> DataFrame:
    """Key and JSON value per answer: a probability or an error, never both."""
    return scored.select(
        F.col("correlation_id").alias("key"),
        F.to_json(
            F.struct(
                F.col("correlation_id").alias("correlationId"), F.col("prob_ct_win").alias("probCtWin"), "error"
            )
        ).alias("value"),
    )


def answer_requests(raw: DataFrame, model: PipelineModel) -> DataFrame:
    """Request messages -> response messages; works on a batch and on a stream."""
    return encode_responses(score_requests(parse_requests(raw), model))


# Limits and texts of the request form.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_ALIVE = "Enter a whole number from 0 to 5"
_NOBODY = "At least one side must have a player alive"
_HP = "Enter a non-negative whole number"
_KILLS = "0 – 15  (max 5 kills/round × 3 rounds)"
_DAMAGE = "0 – 3000"
_FUSE = "Bomb fuse: 0 – 40 s"
_TIMER = "Round timer: 0 – 115 s"
_ROUND_START = {
    "ct_alive": 5,
    "t_alive": 5,
    "ct_total_hp": 500,
    "t_total_hp": 500,
    "bomb_planted": 0,
    "remaining_time": 115,
    "ct_alive_kills_prev3_sum": 0,
    "ct_alive_damage_prev3_sum": 0,
    "t_alive_kills_prev3_sum": 0,
    "t_alive_damage_prev3_sum": 0,
}


def _hp_error(alive: Column, hp: Column, side: str) -> Column:
    least = F.concat(F.lit("Minimum "), alive.cast("string"), F.lit(" (at least 1 HP per alive player)"))
    most = F.concat(
        F.lit("Maximum "),
        (alive * 100).cast("string"),
        F.lit(" (100 HP per player × "),
        alive.cast("string"),
        F.lit(" alive)"),
    )
    return (
        F.when(hp.isNull() | (hp < 0), F.lit(_HP))
        .when((alive == 0) & (hp != 0), F.lit(f"Must be 0 — no {side} players are alive"))
        .when((alive > 0) & (hp < alive), least)
        .when(hp > alive * 100, most)
    )


def _outside(number: Column, low: int, high: int, text: Column) -> Column:
    return F.when(number.isNull() | (number < low) | (number > high), text)


def validate_requests(form: DataFrame) -> DataFrame:
    """Add ``errors``: map of field -> message, empty when the request may be sent.

    Fields may be text or numbers, named like the features. Health is checked only where that
    side's number of living players is fine.
    """
    numbers = {}
    for name in schemas.FEATURES:
        text = F.trim(F.col(name).cast("string"))
        numbers[f"_{name}"] = X.finite(F.when(text.rlike(_NUMBER), text.try_cast("double")))
    parsed = form.withColumns(numbers)
    whole = [n for n in schemas.FEATURES if n not in ("remaining_time", "bomb_planted")]
    parsed = parsed.withColumns(
        {f"_{n}": F.when(F.col(f"_{n}") == F.floor(f"_{n}"), F.col(f"_{n}")).cast("bigint") for n in whole}
    )
    ct, t = F.col("_ct_alive"), F.col("_t_alive")
    nobody = (ct == 0) & (t == 0)
    parsed = parsed.withColumns(
        {
            "_ct_error": F.when(nobody, F.lit(_NOBODY)).otherwise(_outside(ct, 0, 5, F.lit(_ALIVE))),
            "_t_error": _outside(t, 0, 5, F.lit(_ALIVE)),
            "_planted": F.coalesce(F.col("_bomb_planted") != 0, F.lit(False)),
        }
    )
    planted, time = F.col("_planted"), F.col("_remaining_time")
    errors = {
        "ct_alive": F.col("_ct_error"),
        "t_alive": F.col("_t_error"),
        "ct_total_hp": F.when(F.col("_ct_error").isNull(), _hp_error(ct, F.col("_ct_total_hp"), "CT")),
        "t_total_hp": F.when(F.col("_t_error").isNull(), _hp_error(t, F.col("_t_total_hp"), "T")),
        "remaining_time": F.when(planted, _outside(time, 0, 40, F.lit(_FUSE))).otherwise(
            _outside(time, 0, 115, F.lit(_TIMER))
        ),
    }
    for side in ("ct", "t"):
        kills, damage = f"{side}_alive_kills_prev3_sum", f"{side}_alive_damage_prev3_sum"
        errors[kills] = _outside(F.col(f"_{kills}"), 0, 15, F.lit(_KILLS))
        errors[damage] = _outside(F.col(f"_{damage}"), 0, 3000, F.lit(_DAMAGE))
    entries = [F.struct(F.lit(name).alias("key"), text.alias("value")) for name, text in errors.items()]
    found = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return parsed.select(*form.columns, X.once(F.map_from_entries(found)).alias("errors"))


def round_start_defaults(form: DataFrame) -> DataFrame:
    """Fill what is missing with the state at the start of a round."""
    return form.withColumns(
        {
            name: F.coalesce(F.col(name), F.lit(value).cast(form.schema[name].dataType))
            if name in form.columns
            else F.lit(value)
            for name, value in _ROUND_START.items()
        }
    )
