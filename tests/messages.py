"""Small hand-made telemetry."""

import json
from datetime import datetime, timedelta, timezone

from matchpulse.sources.kafka import LOG_SCHEMA

START = datetime(2024, 5, 1, tzinfo=timezone.utc)


def player(team="CT", health=100, kills=0, damage=0):
    return {"team": team, "state": {"health": health, "round_kills": 0, "round_totaldmg": damage}, "match_stats": {"kills": kills}}


def event(phase, round_num, players=None, ends_in="90.0", **extra):
    body = {
        "provider": {"steamid": "s"},
        "map": {"round": round_num, "phase": "live"},
        "round": {"phase": phase},
        "phase_countdowns": {"phase": phase, "phase_ends_in": ends_in},
        "unused": {"weapons": [1, 2]},
    }
    if players is not None:
        body["allplayers"] = players
    return {**body, **extra}


def log(spark, bodies, key="s1", seconds=None):
    """One message a second (or at ``seconds``); a body may be a dict, a text or None."""
    rows = []
    for i, body in enumerate(bodies):
        value = body if body is None or isinstance(body, str) else json.dumps(body)
        at = START + timedelta(seconds=seconds[i] if seconds else i)
        rows.append((key, value, at, 0, i))
    return spark.createDataFrame(rows, LOG_SCHEMA)
