"""Decode raw telemetry messages into flat event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchpulse import schemas
from matchpulse.functions import expressions as X


def decode_events(raw: DataFrame) -> DataFrame:
    """Message key and JSON body, decoded permissively: a bad body gives nulls, not an error."""
    body = F.from_json(F.col("value").cast("string"), schemas.EVENT)
    position = [c for c in ("partition", "offset") if c in raw.columns]
    return raw.select(
        F.col("key").cast("string").alias("session_key"),
        X.once(body).alias("event"),
        F.col("timestamp").alias("event_timestamp"),
        *position,
    )


def drop_non_game(decoded: DataFrame) -> DataFrame:
    """Menu and loading screens carry no map."""
    return decoded.filter(F.col("event.map").isNotNull())


def flatten_events(decoded: DataFrame) -> DataFrame:
    position = [c for c in ("partition", "offset") if c in decoded.columns]
    return decoded.select(
        "session_key",
        F.col("event.map.round").alias("round_num"),
        F.col("event.round.phase").alias("round_phase"),
        F.col("event.phase_countdowns.phase_ends_in").alias("phase_ends_in"),
        F.col("event.phase_countdowns.phase").alias("bomb_phase"),
        F.col("event.allplayers").alias("allplayers"),
        "event_timestamp",
        *position,
    )


def parse_events(raw: DataFrame) -> DataFrame:
    return flatten_events(drop_non_game(decode_events(raw)))


def players_json(events: DataFrame) -> DataFrame:
    """Player map as JSON text (null fields left out), for export."""
    return events.withColumn("allplayers_json", F.to_json("allplayers")).drop("allplayers")


def players_from_json(events: DataFrame) -> DataFrame:
    return events.withColumn("allplayers", F.from_json("allplayers_json", schemas.PLAYERS)).drop(
        "allplayers_json"
    )


def explode_players(events: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per event and player."""
    others = [c for c in events.columns if c != "allplayers"]
    unnest = F.explode_outer if keep_empty else F.explode
    return events.select(*others, unnest("allplayers").alias("player", "p")).select(
        *others,
        "player",
        F.col("p.team").alias("team"),
        F.col("p.state.health").alias("health"),
        F.col("p.state.round_kills").alias("round_kills"),
        F.col("p.state.round_totaldmg").alias("round_totaldmg"),
        F.col("p.match_stats.kills").alias("kills"),
    )


def with_stateless_features(events: DataFrame) -> DataFrame:
    """Add the six features that need nothing but the event itself."""
    staged = events.withColumns(
        {"_ct": X.living(F.col("allplayers"), "CT"), "_t": X.living(F.col("allplayers"), "T")}
    )
    return staged.withColumns(
        {
            "ct_alive": X.head_count(F.col("_ct")),
            "t_alive": X.head_count(F.col("_t")),
            "ct_total_hp": X.total_health(F.col("_ct")),
            "t_total_hp": X.total_health(F.col("_t")),
            "bomb_planted": F.when(F.col("round_phase") == "bomb", 1).otherwise(0),
            "remaining_time": X.seconds_left(F.col("phase_ends_in")),
        }
    ).drop("_ct", "_t")


def predictable(events: DataFrame) -> DataFrame:
    return events.filter(X.is_predictable(F.col("round_phase")))


def slim_timeline(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the round history needs of each event, and nothing more.

    Control rows (freezetime, over) move the round state and carry the players' totals; tick
    rows (live, bomb) are scored and carry the features and the ids of the living. All other
    phases neither move state nor emit. ``session`` is the state key (null keys share one),
    ``session_key`` the key as it arrived. ``keep`` names further columns.
    """
    for name, default in (("partition", "int"), ("offset", "bigint")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(0).cast(default))
    phase = F.col("round_phase")
    is_tick = X.is_predictable(phase)
    featured = with_stateless_features(
        events.filter(phase.isin("freezetime", "over", "live", "bomb"))
    ).withColumn("_entries", X.last_entry_per_player(F.col("allplayers")))
    on_tick = lambda c: F.when(is_tick, c)
    return featured.select(
        F.when(is_tick, "tick").otherwise("control").alias("kind"),
        F.coalesce("session_key", F.lit("")).alias("session"),
        "session_key",
        F.coalesce("round_num", F.lit(0)).alias("round_num"),
        F.col("event_timestamp").cast("bigint").alias("second"),
        F.col("partition").cast("int").alias("partition"),
        F.col("offset").cast("bigint").alias("offset"),
        "round_phase",
        *[on_tick(F.col(c)).alias(c) for c in schemas.STATELESS],
        on_tick(X.living_ids(F.col("_entries"), "CT")).alias("alive_ct"),
        on_tick(X.living_ids(F.col("_entries"), "T")).alias("alive_t"),
        F.when(~is_tick, X.round_totals(F.col("_entries"))).alias("players"),
        *keep,
    )
