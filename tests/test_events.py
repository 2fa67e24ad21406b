"""Decoding and the row-local features."""

import json

import pytest

from matchpulse.operators import events as E
from tests.messages import event, log, player


def parsed(spark, bodies, **kw):
    return {r.offset: r for r in E.parse_events(log(spark, bodies, **kw)).collect()}


def featured(spark, bodies):
    return {r.offset: r for r in E.with_stateless_features(E.parse_events(log(spark, bodies))).collect()}


def test_key_fields_are_extracted(spark):
    players = {"a": player(kills=6), "b": player("T", 43, 2, 57)}
    row = parsed(spark, [event("live", 11, players, "48.2")])[0]
    assert (row.session_key, row.round_num, row.round_phase, row.phase_ends_in) == ("s1", 11, "live", "48.2")
    assert set(row.allplayers) == {"a", "b"}
    assert row.allplayers["b"].state.round_totaldmg == 57


@pytest.mark.parametrize(
    "body",
    ['{"map": {', "", None, '{"round": {"phase": "live"}, "provider": {"steamid": "1"}}', '{"map": null}', "[]", "7"],
)
def test_non_game_messages_are_dropped(spark, body):
    assert parsed(spark, [body]) == {}


@pytest.mark.parametrize("number", [None, "x"])
def test_round_without_a_number_survives(spark, number):
    rows = parsed(spark, [event("live", number), '{"map": {}}'])
    assert rows[0].round_num is None and rows[1].round_num is None


def test_null_key_survives(spark):
    assert parsed(spark, [event("live", 1)], key=None)[0].session_key is None


def test_players_survive_the_json_round_trip(spark):
    bad = player()
    bad["state"]["health"] = "broken"
    events = E.parse_events(log(spark, [event("live", 1, {"a": bad, "b": player("T", 50)}), event("live", 1)]))
    texts = {r.offset: r.allplayers_json for r in E.players_json(events).collect()}
    assert "health" not in json.loads(texts[0])["a"]["state"] and texts[1] is None
    again = E.players_from_json(E.players_json(events))
    assert again.select(events.columns).collect() == events.collect()


def test_explode_players(spark):
    events = E.parse_events(log(spark, [event("live", 1, {"a": player(), "b": player("T", 7)}), event("live", 1)]))
    assert sorted((r.player, r.team, r.health) for r in E.explode_players(events).collect()) == [
        ("a", "CT", 100),
        ("b", "T", 7),
    ]
    assert E.explode_players(events, keep_empty=True).count() == 3


def test_living_players_and_health(spark):
    no_state = {"team": "CT"}
    bad_health = player("T")
    bad_health["state"]["health"] = 12.5
    players = {
        "a": player(health=40),
        "b": player(health=0),
        "c": player("T", 100),
        "d": player("T", 1),
        "e": player("SPEC", 100),
        "f": no_state,
        "g": bad_health,
        "h": {"state": {"health": 9}},
    }
    row = featured(spark, [event("live", 6, players)])[0]
    assert (row.ct_alive, row.t_alive, row.ct_total_hp, row.t_total_hp) == (1, 2, 40, 101)


def test_no_players_counts_zero(spark):
    rows = featured(spark, [event("live", 1), event("live", 1, {})])
    for row in rows.values():
        assert (row.ct_alive, row.t_alive, row.ct_total_hp, row.t_total_hp) == (0, 0, 0, 0)


@pytest.mark.parametrize(
    "text,seconds",
    [("93.7", 93.7), (" 12.5 ", 12.5), ("-3.0", -3.0), ("soon", 0), ("", 0), (None, 0), ("NaN", 0), ("Infinity", 0)],
)
def test_remaining_time(spark, text, seconds):
    row = featured(spark, [event("live", 1, {}, text)])[0]
    assert row.remaining_time == pytest.approx(seconds, abs=1e-5)


def test_bomb_flag(spark):
    rows = featured(spark, [event("bomb", 1), event("live", 1), event(None, 1)])
    assert [rows[i].bomb_planted for i in range(3)] == [1, 0, 0]


def test_full_payload_shape(spark):
    players = {f"c{i}": player() for i in range(5)} | {f"t{i}": player("T") for i in range(5)}
    row = featured(spark, [event("live", 6, players, "93.7")])[0]
    assert (row.ct_alive, row.t_alive, row.ct_total_hp, row.t_total_hp, row.bomb_planted) == (5, 5, 500, 500, 0)
    assert row.remaining_time == pytest.approx(93.7, abs=1e-5)


def test_json_is_decoded_once(spark):
    raw = log(spark, [event("live", 1)])
    plan = E.slim_timeline(E.parse_events(raw))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_slim_rows(spark):
    twice = '{"map":{"round":1},"round":{"phase":"live"},"allplayers":{"a":{"team":"CT","state":{"health":5}},"a":{"team":"CT","state":{"health":0}}}}'
    rows = {
        r.offset: r
        for r in E.slim_timeline(
            E.parse_events(log(spark, [event("over", 1, {"a": player(kills=2, damage=30), "b": {}}), event("warmup", 1), twice]))
        ).collect()
    }
    assert [tuple(p) for p in rows[0].players] == [("a", 2, 30), ("b", 0, 0)]
    assert rows[0].alive_ct is None and rows[0].kind == "control"
    assert 1 not in rows
    # of a repeated player the last entry holds for the history
    assert rows[2].alive_ct == [] and rows[2].ct_alive == 1
