"""The registered queries once more as SQL, straight from the ``events`` columns.

Nothing here decodes JSON or knows of slices: the windows run over whole sessions, the as-of
lookup is an ASOF join, and the example model is its formula.
"""

from __future__ import annotations

from matchpulse import schemas
from matchpulse.plans import example_model as S

_LOG = """
log AS (
  SELECT event_id, event_type, ts, CAST(floor(epoch(ts)) AS BIGINT) AS second, (event_id // 5) % 2 AS partition,
    ((event_id // 5) % 2) * 281474976710656 + event_id AS seq,
    (CAST(floor(epoch(ts)) AS BIGINT) * 2 + (event_id // 5) % 2) * 1000000000 + event_id AS pos,
    CASE WHEN event_id % 3 = 0 THEN 'arena' WHEN event_id % 12 = 11 THEN NULL
         ELSE 'm-' || (event_id // 4800) || '-' || (event_id % 12) END AS key,
    CASE WHEN event_id % 3 = 0 THEN event_id // 3 WHEN event_id % 12 = 11 THEN event_id // 12
         ELSE (event_id % 4800) // 12 END AS rn
  FROM events)"""

_CLEAN = """
shaped AS (
  SELECT *, rn // 20 + 1 AS number,
    CASE WHEN rn % 20 < 2 THEN 'freezetime' WHEN rn % 20 < 14 THEN 'live'
         WHEN rn % 20 < 17 THEN 'bomb' WHEN rn % 20 < 19 THEN 'over' END AS phase
  FROM log WHERE rn % 20 < 19)"""

_DISORDERED = """
shaped AS (
  SELECT *, rn // 7 - (event_id // 5) % 3 AS number,
    CASE event_type WHEN 'signup' THEN 'freezetime' WHEN 'error' THEN 'over' WHEN 'view' THEN 'bomb'
         ELSE 'live' END AS phase
  FROM log)"""

_GAME = """
game AS (
  SELECT *, coalesce(key, '') AS session, CASE WHEN event_id % 227 <> 9 THEN number END AS round_num,
    coalesce(CASE WHEN event_id % 227 <> 9 THEN number END, 0) AS round_or_0,
    CASE WHEN event_id % 59 = 0 THEN 'soon' WHEN event_id % 53 = 0 THEN NULL
         ELSE ((event_id % 1150) // 10) || '.' || ((event_id % 1150) % 10) END AS ends_in,
    CASE WHEN event_id % 59 = 0 OR event_id % 53 = 0 THEN 0 ELSE event_id % 1150 END AS tenths
  FROM shaped WHERE event_id % 211 <> 5 AND event_id % 223 <> 7),
players AS (
  SELECT g.*, 'p' || pid AS player, CASE WHEN pid < 5 THEN 'CT' ELSE 'T' END AS team,
    CASE WHEN (event_id * 7 + pid * 13) % 4 = 0 THEN 0 ELSE (event_id * 11 + pid * 29) % 100 + 1 END AS health,
    (rn % 4000) * (pid + 1) // 25 - CASE WHEN event_id % 97 = 0 THEN 3 ELSE 0 END AS kills,
    (rn % 20) * (pid + 1) * 3 % 150 AS damage
  FROM game g, (SELECT range AS pid FROM range(10))
  WHERE NOT (pid >= 7 AND (event_id + pid) % 5 = 0)),
stateless AS (
  SELECT event_id,
    count(*) FILTER (team = 'CT' AND health > 0) AS ct_alive, count(*) FILTER (team = 'T' AND health > 0) AS t_alive,
    CAST(coalesce(sum(health) FILTER (team = 'CT'), 0) AS BIGINT) AS ct_total_hp,
    CAST(coalesce(sum(health) FILTER (team = 'T'), 0) AS BIGINT) AS t_total_hp
  FROM players GROUP BY event_id)"""

_ROUNDS = """
state AS (
  SELECT *, greatest(0, coalesce(max(CASE WHEN phase = 'freezetime' THEN round_or_0 END) OVER (
      PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS current_round
  FROM game),
steps AS (
  SELECT session, 'start' AS step, round_or_0 AS round_num, second, event_id, pos
  FROM state WHERE phase = 'freezetime' AND round_or_0 > current_round
  UNION ALL
  SELECT session, 'archive', round_or_0, second, event_id, pos
  FROM state WHERE phase = 'over' AND round_or_0 = current_round
  QUALIFY row_number() OVER (PARTITION BY session, current_round ORDER BY pos) = 1),
player_steps AS (
  SELECT s.*, p.player, p.kills, p.damage,
    last_value(CASE WHEN step = 'start' THEN p.kills END IGNORE NULLS) OVER (
      PARTITION BY s.session, p.player ORDER BY s.pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at_start
  FROM steps s JOIN players p USING (event_id)),
stats AS (
  SELECT session, player, round_num, pos, greatest(0, kills - coalesce(at_start, kills)) AS kills, damage
  FROM player_steps WHERE step = 'archive'),
history AS (
  SELECT session, player, round_num, pos,
    CAST(sum(kills) OVER last3 AS BIGINT) AS kills_prev3, CAST(sum(damage) OVER last3 AS BIGINT) AS damage_prev3
  FROM stats
  WINDOW last3 AS (PARTITION BY session, player ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
living AS (
  SELECT p.event_id, p.team, h.kills_prev3, h.damage_prev3
  FROM (SELECT * FROM players WHERE health > 0 AND phase IN ('live', 'bomb')) p
  ASOF JOIN history h ON p.session = h.session AND p.player = h.player AND p.pos > h.pos),
sums AS (
  SELECT event_id,
    sum(kills_prev3) FILTER (team = 'CT') AS ck, sum(damage_prev3) FILTER (team = 'CT') AS cd,
    sum(kills_prev3) FILTER (team = 'T') AS tk, sum(damage_prev3) FILTER (team = 'T') AS td
  FROM living GROUP BY event_id),
features AS (
  SELECT g.key AS session_key, g.round_or_0 AS round_num, g.second AS event_timestamp, g.event_id,
    ct_alive, t_alive, ct_total_hp, t_total_hp,
    CAST(g.phase = 'bomb' AS BIGINT) AS bomb_planted, g.tenths AS remaining_tenths,
    CAST(coalesce(ck, 0) AS BIGINT) AS ct_alive_kills_prev3_sum,
    CAST(coalesce(cd, 0) AS BIGINT) AS ct_alive_damage_prev3_sum,
    CAST(coalesce(tk, 0) AS BIGINT) AS t_alive_kills_prev3_sum,
    CAST(coalesce(td, 0) AS BIGINT) AS t_alive_damage_prev3_sum
  FROM game g LEFT JOIN stateless USING (event_id) LEFT JOIN sums USING (event_id)
  WHERE g.phase IN ('live', 'bomb'))"""

_REQUESTS = """
bodies AS (
  SELECT event_id, ts,
    CASE WHEN event_id % 89 = 8 THEN 'cut' WHEN event_id % 83 = 7 THEN 'nan'
         WHEN event_id % 79 = 5 THEN 'text' ELSE 'full' END AS shape
  FROM log),
requests AS (
  SELECT event_id, 'r' || event_id AS correlation_id, shape,
    CASE WHEN shape = 'nan' OR event_id % 41 = 1 THEN 0 ELSE event_id % 6 END AS ct_alive,
    CASE WHEN shape = 'nan' THEN 0 ELSE (event_id // 6) % 6 END AS t_alive,
    CASE WHEN shape = 'nan' THEN 0
         ELSE (event_id % 6) * (event_id % 100 + 1) + CASE WHEN event_id % 37 = 2 THEN 600 ELSE 0 END END AS ct_total_hp,
    CASE WHEN shape = 'nan' THEN 0 ELSE ((event_id // 6) % 6) * (event_id % 100 + 1) END AS t_total_hp,
    CASE WHEN shape = 'nan' THEN 0 ELSE event_id % 2 END AS bomb_planted,
    CASE WHEN shape = 'nan' THEN -1 ELSE event_id % 1250 END AS remaining_tenths,
    CASE WHEN shape = 'nan' THEN 0 ELSE event_id % 17 END AS ct_alive_kills_prev3_sum,
    CASE WHEN shape = 'nan' THEN 0
         ELSE event_id % 1500 * 2 + CASE WHEN event_id % 43 = 3 THEN 9000 ELSE 0 END END AS ct_alive_damage_prev3_sum,
    CASE WHEN shape = 'nan' THEN 0
         ELSE event_id % 16 - CASE WHEN event_id % 47 = 4 THEN 20 ELSE 0 END END AS t_alive_kills_prev3_sum,
    CASE WHEN shape = 'nan' THEN 0 ELSE event_id % 1100 END AS t_alive_damage_prev3_sum
  FROM bodies
  WHERE shape = 'nan' OR (shape = 'full' AND event_id % 61 <> 6))"""

_PREDICTIONS = """
predictions AS (
  SELECT event_id AS "offset", seq, CASE WHEN event_id % 113 = 9 THEN 'loose' ELSE key END AS session_key,
    CASE WHEN event_id % 113 = 9 THEN 3 ELSE (rn // 20) % 30 + 1 END AS round,
    (event_id * 7919 % 1000001) / 1e6 AS p, event_id * 7919 % 1000001 AS prob_micro,
    CASE WHEN event_id % 113 = 9 THEN 1700000000000 ELSE second * 1000 END AS timestamp_ms
  FROM log WHERE event_id % 101 <> 3 AND event_id % 109 <> 7 AND (event_id % 113 = 9 OR event_id % 103 <> 2)),
ticks AS (
  SELECT *, row_number() OVER (PARTITION BY session_key, round ORDER BY seq) AS tick FROM predictions)"""

_PERCENT = "CAST(floor(p * 100 + 0.5) AS BIGINT)"
_PREDICTION_COLUMNS = 'session_key, round, prob_micro, timestamp_ms, "offset"'


#: The games of single matches: a freezetime of round 1 or less after a higher one begins a match.
_MATCHES = """
fresh AS (
  SELECT *, CAST(phase = 'freezetime' AND round_or_0 <= 1 AND coalesce(last_value(CASE WHEN phase = 'freezetime' THEN round_or_0 END IGNORE NULLS) OVER (
      PARTITION BY session ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 1 AS INTEGER) AS begins
  FROM every_game),
game AS (
  SELECT * EXCLUDE (session, begins),
    session || '#' || sum(begins) OVER (PARTITION BY session ORDER BY pos ROWS UNBOUNDED PRECEDING) AS session
  FROM fresh),"""
_GAME_BY_MATCH = _GAME.replace("game AS (", "every_game AS (", 1).replace("players AS (", _MATCHES.lstrip() + "\nplayers AS (", 1)
_ROUNDS_OR_NEXT = _ROUNDS.replace("'archive', round_or_0, second", "'archive', current_round, second").replace(
    "round_or_0 = current_round\n", "round_or_0 - current_round IN (0, 1)\n"
)


def _probability() -> str:
    """The example model's probability in millionths, from feature columns."""
    terms = [f"{S.EXAMPLE_INTERCEPT}::DOUBLE"]
    for name, mean, std, weight in zip(schemas.FEATURES, S.EXAMPLE_MEAN, S.EXAMPLE_STD, S.EXAMPLE_WEIGHTS):
        value = "CAST(CAST(remaining_tenths / 10.0 AS FLOAT) AS DOUBLE)" if name == "remaining_time" else name
        terms.append(f"{weight}::DOUBLE * ({value} - {mean}::DOUBLE) / {std}::DOUBLE")
    return f"CAST(floor(1e6 / (1 + exp(-({' + '.join(terms)}))) + 0.5) AS BIGINT)"


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def oracle_sql() -> dict[str, str]:
    clean = _with(_LOG, _CLEAN, _GAME)
    rounds = _with(_LOG, _CLEAN, _GAME, _ROUNDS)
    disordered = _with(_LOG, _DISORDERED, _GAME, _ROUNDS)
    asked = _with(_LOG, _REQUESTS)
    log = _with(_LOG, _PREDICTIONS)
    feature_columns = ["remaining_tenths" if f == "remaining_time" else f for f in schemas.FEATURES]
    features = ", ".join(feature_columns)
    prev3 = ", ".join(schemas.PREV3)
    long_players = 'SELECT event_id AS "offset", player, team, health, kills, damage FROM players'
    transitions = 'SELECT session, step, round_num, second, event_id AS "offset" FROM steps'
    prob = _probability()
    listed = "string_agg(tick || ':' || seq || ':' || prob_micro || ':' || timestamp_ms, ',' ORDER BY tick)"
    scored_request = f"""
      CASE WHEN shape = 'full' THEN {prob} END AS prob_micro,
      CASE WHEN shape = 'nan' THEN 'remaining_time is not a number' END AS error FROM requests"""
    defaults = {"ct_alive": 5, "t_alive": 5, "ct_total_hp": 500, "t_total_hp": 500, "remaining_time": 115}
    sql = {
        "parse_events": clean
        + """SELECT key AS session_key, round_num, phase AS round_phase, ends_in AS phase_ends_in,
               phase AS bomb_phase, n AS players, second, event_id AS "offset"
             FROM game JOIN (SELECT event_id, count(*) AS n FROM players GROUP BY event_id) USING (event_id)""",
        "non_game_filter": clean + 'SELECT key AS session_key, event_id AS "offset" FROM game',
        "explode_players": clean + long_players,
        "players_json_roundtrip": clean + long_players,
        "alive_counts": clean + 'SELECT event_id AS "offset", ct_alive, t_alive FROM stateless',
        "team_hp": clean + 'SELECT event_id AS "offset", ct_total_hp, t_total_hp FROM stateless',
        "bomb_and_timer": clean
        + """SELECT event_id AS "offset", CAST(phase = 'bomb' AS BIGINT) AS bomb_planted,
               tenths AS remaining_tenths FROM game""",
        "stateless_features": clean
        + """SELECT key AS session_key, event_id AS "offset", round_num, ct_alive, t_alive, ct_total_hp, t_total_hp,
               CAST(phase = 'bomb' AS BIGINT) AS bomb_planted, tenths AS remaining_tenths
             FROM game JOIN stateless USING (event_id) WHERE phase IN ('live', 'bomb')""",
        "round_transitions": rounds + transitions,
        "round_transitions_disordered": disordered + transitions,
        "kill_snapshots": rounds
        + "SELECT session, round_num, player, kills FROM player_steps WHERE step = 'start'",
        "round_transitions_by_match": _with(_LOG, _DISORDERED, _GAME_BY_MATCH, _ROUNDS) + transitions,
        "prev3_features_by_match": _with(_LOG, _DISORDERED, _GAME_BY_MATCH, _ROUNDS_OR_NEXT) + f'SELECT event_id AS "offset", {prev3} FROM features',
        "round_player_stats": disordered + "SELECT session, player, round_num, kills, damage FROM stats",
        "prev3_player_history": rounds
        + "SELECT session, player, round_num, kills_prev3, damage_prev3 FROM history",
        "prev3_features": rounds + f'SELECT event_id AS "offset", {prev3} FROM features',
        "prev3_features_disordered": disordered + f'SELECT event_id AS "offset", {prev3} FROM features',
        "feature_rows": rounds + f"SELECT session_key, round_num, event_timestamp, {features} FROM features",
        "live_features": rounds
        + f'SELECT session_key, round_num, event_timestamp, event_id AS "offset", {features} FROM features',
        "win_probability": rounds
        + f"SELECT session_key, round_num, event_timestamp, {prob} AS prob_micro FROM features",
        "prediction_messages": rounds
        + f"""SELECT session_key AS key, session_key, round_num AS round, {prob} AS prob_micro,
                event_timestamp * 1000 AS timestamp_ms FROM features""",
        "request_messages": asked
        + """SELECT id AS key, id AS correlation_id, event_id AS "offset" FROM (
               SELECT event_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id
               FROM (SELECT event_id, md5('1:' || (event_id // 5) % 2 || '|' || length(CAST(event_id AS VARCHAR)) || ':' || event_id || '|') AS h
                     FROM requests))""",
        "request_features": asked + f"SELECT correlation_id, {features} FROM requests",
        "request_scores": asked + "SELECT correlation_id," + scored_request,
        "response_messages": asked + "SELECT correlation_id AS key, correlation_id," + scored_request,
        "request_validation": asked + _VALIDATION,
        "round_start_defaults": _with(_LOG)
        + "SELECT event_id, "
        + ", ".join(
            f"CAST(CASE WHEN event_id % {i + 2} = 0 THEN event_id % 100 ELSE {defaults.get(name, 0)} END AS BIGINT) AS {name}"
            for i, name in enumerate(schemas.FEATURES)
        )
        + " FROM log",
        "response_matching": _with(_LOG) + _MATCHING,
        "prediction_log_decode": log + f"SELECT {_PREDICTION_COLUMNS} FROM predictions",
        "unreadable_predictions": _with(_LOG)
        + "SELECT partition, count(*) AS unreadable FROM log WHERE event_id % 101 = 3 OR event_id % 109 = 7 GROUP BY partition",
        "round_history_nested": log
        + f"""SELECT session_key, round, (tick - 1) // 4096 AS page, {listed} AS ticks FROM ticks GROUP BY ALL""",
        "history_snapshot": log
        + f"""SELECT session_key, round, page, ticks, predictions FROM (
               SELECT session_key, round, (tick - 1) // 4096 AS page, {listed} AS ticks FROM ticks GROUP BY ALL) n
             JOIN (SELECT session_key AS s, round AS r, count(*) AS predictions FROM predictions GROUP BY ALL)
             ON session_key IS NOT DISTINCT FROM s AND round = r""",
        "retained_history": log
        + """, aged AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY seq DESC) AS age FROM predictions)
             SELECT CASE WHEN age <= 20 THEN 'kept' ELSE 'folded' END AS tier, session_key, round, count(*) AS ticks,
               min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(prob_micro) AS BIGINT) AS sum_micro,
               max_by(prob_micro, seq) AS last_prob_micro, min(prob_micro) AS least_micro, max(prob_micro) AS greatest_micro
             FROM aged GROUP BY ALL""",
        "live_round_summary_cleared": log
        + f"""SELECT round, pct AS ct_percent, 100 - pct AS t_percent, ticks FROM (
               SELECT round, max_by({_PERCENT}, "offset") AS pct, count(*) AS ticks FROM predictions
               WHERE "offset" > (SELECT coalesce(max(event_id), -1) FROM log WHERE event_id % 300 = 217) GROUP BY round)""",
        "latest_prediction": log
        + f'SELECT {_PREDICTION_COLUMNS} FROM predictions QUALIFY row_number() OVER (ORDER BY seq DESC) = 1',
        "latest_by_session": log
        + f"""SELECT {_PREDICTION_COLUMNS} FROM predictions
              QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY seq DESC) = 1""",
        "current_round": log
        + 'SELECT round FROM predictions QUALIFY row_number() OVER (ORDER BY seq DESC) = 1',
        "outcome_label": log
        + f"""SELECT "offset", CASE WHEN p >= 0.5::DOUBLE THEN 'CT Win' ELSE 'T Win' END AS outcome,
               {_PERCENT} AS ct_percent, '…' || right(session_key, 8) AS session_label FROM predictions""",
        "session_series": log
        + """SELECT session_key, '…' || right(session_key, 8) AS session_label, timestamp_ms AS x,
               prob_micro AS y_micro FROM predictions""",
        "round_summary": log
        + f"""SELECT round, pct AS ct_percent, 100 - pct AS t_percent, ticks FROM (
               SELECT round, max_by({_PERCENT}, seq) AS pct, count(*) AS ticks FROM predictions GROUP BY round)""",
        "round_summary_by_session": log
        + f"""SELECT session_key, round, pct AS ct_percent, 100 - pct AS t_percent, ticks FROM (
               SELECT session_key, round, max_by({_PERCENT}, seq) AS pct, count(*) AS ticks
               FROM predictions GROUP BY session_key, round)""",
        "tick_index": log
        + """SELECT session_key, round, "offset",
               row_number() OVER (PARTITION BY session_key, round ORDER BY seq) AS tick FROM predictions""",
        "tick_index_by_round": log
        + """SELECT round, "offset", row_number() OVER (PARTITION BY round ORDER BY seq) AS tick
             FROM predictions""",
        "first_ticks": log
        + f"""SELECT {_PREDICTION_COLUMNS} FROM predictions
              QUALIFY row_number() OVER (PARTITION BY session_key, round ORDER BY seq) = 1""",
        "first_ticks_by_round": log
        + f"""SELECT {_PREDICTION_COLUMNS} FROM predictions
              QUALIFY row_number() OVER (PARTITION BY round ORDER BY seq) = 1""",
        "since_last_clear": log
        + f"""SELECT {_PREDICTION_COLUMNS} FROM predictions
              WHERE seq > coalesce((SELECT max(seq) FROM log WHERE event_id % 4000 = 417), -1)""",
        "last_n": log
        + f"""SELECT {_PREDICTION_COLUMNS} FROM predictions
              QUALIFY row_number() OVER (PARTITION BY session_key ORDER BY seq DESC) <= 5""",
        "request_dead_letters": asked
        + """SELECT event_id AS "offset" FROM bodies
             WHERE shape IN ('cut', 'text') OR (shape = 'full' AND event_id % 61 = 6)""",
    }
    for name in ("response_messages", "prediction_log_decode", "stateless_features", "round_summary", "latest_by_session", "first_ticks"):
        sql[f"live_{name}"] = sql[name]
    sql["round_history_appended"] = sql["round_history_nested"]
    sql["live_features_disordered"] = sql["live_features"]
    sql["live_features_by_match"] = sql["prev3_features_by_match"]
    sql["live_predictions"] = sql["win_probability"]
    sql["live_matches"] = sql["response_matching"]
    return sql


_VALIDATION = """, checks AS (
  SELECT *, CASE WHEN ct_alive NOT BETWEEN 0 AND 5 THEN 'Enter a whole number from 0 to 5' END AS ct_range,
    CASE WHEN t_alive NOT BETWEEN 0 AND 5 THEN 'Enter a whole number from 0 to 5' END AS t_error
  FROM requests),
alive AS (
  SELECT *, CASE WHEN ct_range IS NULL AND t_error IS NULL AND ct_alive = 0 AND t_alive = 0
      THEN 'At least one side must have a player alive' ELSE ct_range END AS ct_error FROM checks),
messages AS (
  SELECT event_id, 'ct_alive' AS field, ct_error AS message FROM alive UNION ALL
  SELECT event_id, 't_alive', t_error FROM alive UNION ALL
  SELECT event_id, 'ct_total_hp', CASE WHEN ct_error IS NOT NULL THEN NULL
      WHEN ct_total_hp < 0 THEN 'Enter a non-negative whole number'
      WHEN ct_alive = 0 AND ct_total_hp <> 0 THEN 'Must be 0 — no CT players are alive'
      WHEN ct_alive > 0 AND ct_total_hp < ct_alive THEN 'Minimum ' || ct_alive || ' (at least 1 HP per alive player)'
      WHEN ct_total_hp > ct_alive * 100
      THEN 'Maximum ' || ct_alive * 100 || ' (100 HP per player × ' || ct_alive || ' alive)' END FROM alive UNION ALL
  SELECT event_id, 't_total_hp', CASE WHEN t_error IS NOT NULL THEN NULL
      WHEN t_total_hp < 0 THEN 'Enter a non-negative whole number'
      WHEN t_alive = 0 AND t_total_hp <> 0 THEN 'Must be 0 — no T players are alive'
      WHEN t_alive > 0 AND t_total_hp < t_alive THEN 'Minimum ' || t_alive || ' (at least 1 HP per alive player)'
      WHEN t_total_hp > t_alive * 100
      THEN 'Maximum ' || t_alive * 100 || ' (100 HP per player × ' || t_alive || ' alive)' END FROM alive UNION ALL
  SELECT event_id, 'remaining_time', CASE
      WHEN remaining_tenths BETWEEN 0 AND CASE WHEN bomb_planted <> 0 THEN 400 ELSE 1150 END THEN NULL
      WHEN bomb_planted <> 0 THEN 'Bomb fuse: 0 – 40 s' ELSE 'Round timer: 0 – 115 s' END FROM alive UNION ALL
  SELECT event_id, 'ct_alive_kills_prev3_sum', CASE WHEN ct_alive_kills_prev3_sum NOT BETWEEN 0 AND 15
      THEN '0 – 15  (max 5 kills/round × 3 rounds)' END FROM alive UNION ALL
  SELECT event_id, 't_alive_kills_prev3_sum', CASE WHEN t_alive_kills_prev3_sum NOT BETWEEN 0 AND 15
      THEN '0 – 15  (max 5 kills/round × 3 rounds)' END FROM alive UNION ALL
  SELECT event_id, 'ct_alive_damage_prev3_sum',
      CASE WHEN ct_alive_damage_prev3_sum NOT BETWEEN 0 AND 3000 THEN '0 – 3000' END FROM alive UNION ALL
  SELECT event_id, 't_alive_damage_prev3_sum',
      CASE WHEN t_alive_damage_prev3_sum NOT BETWEEN 0 AND 3000 THEN '0 – 3000' END FROM alive)
SELECT event_id AS "offset", field, message FROM messages WHERE message IS NOT NULL"""

_MATCHING = """, sent AS (
  SELECT event_id, copy, event_id * 2 + copy AS "offset",
    (second + event_id % 15 - CASE WHEN event_id % 29 = 0 THEN 5 ELSE 0 END + copy) * 1000000 AS responded_us
  FROM log, (SELECT range AS copy FROM range(2))
  WHERE event_id % 7 <> 3 AND copy < CASE WHEN event_id % 5 = 1 THEN 2 ELSE 1 END
    AND event_id % 31 <> 2 AND event_id % 107 <> 6 AND event_id % 109 <> 5),
first AS (
  SELECT l.event_id, s.copy
  FROM log l JOIN sent s ON s.event_id = l.event_id
    AND s.responded_us >= epoch_us(l.ts) AND s.responded_us < epoch_us(l.ts) + 10000000
  QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY s.responded_us, l.partition, s."offset") = 1)
SELECT 'r' || l.event_id AS correlation_id,
  CASE WHEN copy IS NULL THEN 'timeout' WHEN l.event_id % 13 = 4 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN copy IS NOT NULL AND l.event_id % 13 <> 4 THEN (l.event_id * 7919 + copy) % 1000001 END AS prob_micro,
  CASE WHEN copy IS NOT NULL AND l.event_id % 13 = 4 THEN 'model failed' END AS error
FROM log l LEFT JOIN first USING (event_id)"""
