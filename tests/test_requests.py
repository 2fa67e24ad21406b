import json

import pytest
from pyspark.sql import functions as F

from matchpulse import schemas
from matchpulse.operators import requests as Q
from matchpulse.operators import scoring as S
from matchpulse.plans import example_model
from tests.messages import log

FULL = {field: 1 for field in schemas.FEATURES.values()} | {"correlationId": "r1", "remainingTime": 30.5}


def decoded(spark, body):
    return Q.decode_requests(log(spark, [body])).collect()[0]


def test_request_becomes_features(spark):
    row = decoded(spark, FULL | {"ctTotalHp": 321, "note": "x"})
    assert row.readable and row.correlation_id == "r1" and row.ct_total_hp == 321
    assert row.remaining_time == 30.5


def test_missing_and_null_numbers_are_zero(spark):
    row = decoded(spark, {"correlationId": "r1", "ctAlive": None, "tAlive": ""})
    assert row.readable and [row[f] for f in schemas.FEATURES] == [0] * 10


@pytest.mark.parametrize("value,want", [("5", 5), (5.7, 5), (-5.7, -5), (" 4 ", 4)])
def test_numbers_are_coerced(spark, value, want):
    assert decoded(spark, FULL | {"ctAlive": value}).ct_alive == want


@pytest.mark.parametrize(
    "body",
    [
        '{"correlationId": ',
        None,
        "[1]",
        {"ctAlive": 1},
        FULL | {"correlationId": None},
        FULL | {"ctAlive": "many"},
        FULL | {"ctAlive": True},
        FULL | {"ctAlive": 1e12},
        FULL | {"ctAlive": "NaN"},
        FULL | {"remainingTime": "soon"},
    ],
)
def test_unreadable_requests_get_no_answer(spark, body):
    raw = log(spark, [body])
    assert Q.parse_requests(raw).count() == 0 and Q.dead_letters(raw).count() == 1
    assert Q.answer_requests(raw, example_model.example_model(spark)).count() == 0


def test_answers(spark):
    raw = log(spark, [FULL, FULL | {"correlationId": "r2", "remainingTime": "NaN"}])
    answers = {r.key: json.loads(r.value) for r in Q.answer_requests(raw, example_model.example_model(spark)).collect()}
    assert set(answers["r1"]) == {"correlationId", "probCtWin"} and 0 < answers["r1"]["probCtWin"] < 1
    assert answers["r2"] == {"correlationId": "r2", "error": "remaining_time is not a number"}


GOOD = {
    "ct_alive": "3",
    "t_alive": "2",
    "ct_total_hp": "250",
    "t_total_hp": "180",
    "bomb_planted": "0",
    "remaining_time": "45.5",
    "ct_alive_kills_prev3_sum": "4",
    "ct_alive_damage_prev3_sum": "320",
    "t_alive_kills_prev3_sum": "2",
    "t_alive_damage_prev3_sum": "150",
}
HP = "Enter a non-negative whole number"
ALIVE = "Enter a whole number from 0 to 5"
VALIDATION = [
    ({}, {}),
    ({"ct_alive": " 3 "}, {}),
    ({"ct_alive": ""}, {"ct_alive": ALIVE}),
    ({"ct_alive": "2.5", "ct_total_hp": "-1"}, {"ct_alive": ALIVE}),
    ({"ct_alive": "6"}, {"ct_alive": ALIVE}),
    ({"ct_alive": "1f"}, {"ct_alive": ALIVE}),
    ({"t_alive": "-1", "t_total_hp": "x"}, {"t_alive": ALIVE}),
    (
        {"ct_alive": "0", "t_alive": "0", "ct_total_hp": "7", "t_total_hp": "7"},
        {
            "ct_alive": "At least one side must have a player alive",
            "t_total_hp": "Must be 0 — no T players are alive",
        },
    ),
    ({"ct_alive": "0", "ct_total_hp": "7"}, {"ct_total_hp": "Must be 0 — no CT players are alive"}),
    ({"ct_total_hp": "2"}, {"ct_total_hp": "Minimum 3 (at least 1 HP per alive player)"}),
    ({"t_total_hp": "201"}, {"t_total_hp": "Maximum 200 (100 HP per player × 2 alive)"}),
    ({"t_total_hp": "1.5"}, {"t_total_hp": HP}),
    ({"ct_total_hp": None}, {"ct_total_hp": HP}),
    ({"remaining_time": "116"}, {"remaining_time": "Round timer: 0 – 115 s"}),
    ({"remaining_time": "41", "bomb_planted": "1"}, {"remaining_time": "Bomb fuse: 0 – 40 s"}),
    ({"remaining_time": "Infinity"}, {"remaining_time": "Round timer: 0 – 115 s"}),
    (
        {"ct_alive_kills_prev3_sum": "16", "t_alive_damage_prev3_sum": "3001"},
        {
            "ct_alive_kills_prev3_sum": "0 – 15  (max 5 kills/round × 3 rounds)",
            "t_alive_damage_prev3_sum": "0 – 3000",
        },
    ),
]


def test_validation(spark):
    rows = [(i, *(GOOD | change).values()) for i, (change, _) in enumerate(VALIDATION)]
    form = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} string" for n in schemas.FEATURES))
    got = {r.i: r.errors for r in Q.validate_requests(form).collect()}
    assert got == {i: want for i, (_, want) in enumerate(VALIDATION)}
    assert Q.validate_requests(form).filter(F.size("errors") == 0).count() == 2


def test_round_start_defaults(spark):
    form = spark.createDataFrame([(None, 2.0)], "ct_alive int, remaining_time float")
    row = Q.round_start_defaults(form).collect()[0]
    assert (row.ct_alive, row.t_alive, row.ct_total_hp, row.remaining_time, row.bomb_planted) == (5, 5, 500, 2.0, 0)


def test_made_requests(spark):
    bodies = spark.createDataFrame([(1, None, 5, 2.5), (2, "mine", 4, 1.5)], "n int, correlationId string, ctAlive int, remainingTime double")
    rows = Q.make_requests(bodies, ["n"]).collect()
    assert rows == Q.make_requests(bodies, ["n"]).collect()
    first, second = (json.loads(r.value) for r in rows)
    assert first["correlationId"] == rows[0].key and len(rows[0].key) == 36
    assert second["correlationId"] == "mine" != rows[1].key
    assert first["ctAlive"] == 5 and first["remainingTime"] == 2.5


def test_model_is_saved_loaded_and_scores_by_formula(spark, tmp_path):
    import math

    model = example_model.example_model(spark)
    model.save(f"{tmp_path}/model")
    values = [3, 2, 250, 180, 1, 30.5, 4, 320, 2, 150]
    features = spark.createDataFrame(
        [("s", 1, 2, *values)],
        "session_key string, round_num int, event_timestamp bigint, "
        + ", ".join(f"{n} {'float' if n == 'remaining_time' else 'int'}" for n in schemas.FEATURES),
    )
    z = example_model.EXAMPLE_INTERCEPT + sum(
        w * (v - m) / s for w, v, m, s in zip(example_model.EXAMPLE_WEIGHTS, values, example_model.EXAMPLE_MEAN, example_model.EXAMPLE_STD)
    )
    for each in (model, S.load_model(f"{tmp_path}/model")):
        scored = S.score(features, each)
        assert scored.columns == S.PREDICTION_COLUMNS
        assert scored.collect()[0].prob_ct_win == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert json.loads(S.encode_predictions(S.score(features, model)).collect()[0].value)["timestamp"] == 2000


def test_a_row_the_model_cannot_score_costs_its_own_answer(spark):
    names = list(schemas.FEATURES)
    kinds = ", ".join(f"{n} {'float' if n == 'remaining_time' else 'int'}" for n in names)
    good = [1] * len(names)
    rows = [("a", *good), ("b", None, *good[1:]), ("c", *[float("inf") if n == "remaining_time" else 1 for n in names])]
    requests = spark.createDataFrame([(r[0], *[float(v) if n == "remaining_time" and v is not None else v for n, v in zip(names, r[1:])]) for r in rows], f"correlation_id string, {kinds}")
    found = {r.correlation_id: (r.prob_ct_win is None, r.error) for r in Q.score_requests(requests, example_model.example_model(spark)).collect()}
    assert found == {"a": (False, None), "b": (True, "ct_alive is not a number"), "c": (True, "remaining_time is not a number")}


def test_all_fields_of_a_body_are_sent(spark):
    bodies = spark.createDataFrame([(1, 5, "x")], "n int, ctAlive int, note string")
    body = json.loads(Q.make_requests(bodies, ["n"]).collect()[0].value)
    assert (body["n"], body["ctAlive"], body["note"]) == (1, 5, "x")
