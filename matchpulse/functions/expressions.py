"""Row-local column expressions: everything here stays inside one row and needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(column: Column) -> Column:
    """The column as a one-element explode, for costly values that are filtered on later.

    Catalyst pushes a filter below the projection that makes the value and computes the value
    once more per filter; it does not push below an explode.
    """
    return F.explode(F.array(column))


def is_predictable(phase: Column) -> Column:
    """Only live play and the post-plant phase are scored."""
    return phase.isin("live", "bomb")


def living(players: Column, team: str) -> Column:
    """Players of one side with health left, as an array of player structs."""
    alive = F.map_filter(players, lambda _, p: (p["team"] == team) & (p["state"]["health"] > 0))
    return F.map_values(alive)


def head_count(alive: Column) -> Column:
    return F.coalesce(F.array_size(alive), F.lit(0))


def total_health(alive: Column) -> Column:
    """Health of all, as a whole number; a sum beyond the type's range stops at its end."""
    total = F.aggregate(alive, F.lit(0).cast("bigint"), lambda acc, p: acc + p["state"]["health"])
    return whole(F.coalesce(total, F.lit(0)))


def whole(number: Column) -> Column:
    """A bigint as int, held at the ends of its range, so that absurd numbers fail no job."""
    return F.least(F.greatest(number, F.lit(-(2**31))), F.lit(2**31 - 1)).cast("int")


def finite(number: Column) -> Column:
    """The number, or null for NaN and the infinities."""
    infinity = F.lit(float("inf"))
    return F.when(~F.isnan(number) & (F.abs(number) < infinity), number)


def seconds_left(text: Column) -> Column:
    """Countdown text as float; absent, unreadable or non-finite text counts as 0."""
    return F.coalesce(finite(text.try_cast("float")), F.lit(0.0).cast("float"))


def last_entry_per_player(players: Column) -> Column:
    """Player map as entries; of a key repeated in the JSON only the last entry is kept."""
    entries = F.map_entries(players)
    keys = F.map_keys(players)
    unique = F.filter(
        entries,
        lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["key"]),
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(unique)


def living_ids(entries: Column, team: str) -> Column:
    chosen = F.filter(entries, lambda e: (e["value"]["team"] == team) & (e["value"]["state"]["health"] > 0))
    return F.coalesce(F.transform(chosen, lambda e: e["key"]), F.array().cast("array<string>"))


def round_totals(entries: Column) -> Column:
    """Each player's running kills and damage of the round, absent numbers as 0."""
    return F.coalesce(
        F.transform(
            entries,
            lambda e: F.struct(
                e["key"].alias("player"),
                F.coalesce(e["value"]["match_stats"]["kills"], F.lit(0)).alias("kills"),
                F.coalesce(e["value"]["state"]["round_totaldmg"], F.lit(0)).alias("damage"),
            ),
        ),
        F.array().cast("array<struct<player:string,kills:int,damage:int>>"),
    )


def to_epoch_ms(ts: Column) -> Column:
    """Older messages carry seconds: anything below 1e12 is one of those."""
    return F.when(ts < F.lit(10**12), ts * F.lit(1000)).otherwise(ts)


def whole_percent(prob: Column) -> Column:
    """Halves go up, as in the displayed percentages (SQL round would go away from zero)."""
    return F.floor(prob * 100 + F.lit(0.5)).cast("int")


def outcome(prob: Column) -> Column:
    return F.when(prob >= 0.5, F.lit("CT Win")).otherwise(F.lit("T Win"))


def short_session(key: Column) -> Column:
    """Ellipsis and the last eight characters."""
    return F.concat(F.lit("…"), F.right(key, F.lit(8)))


def uuid_from(*parts: Column) -> Column:
    """UUID-shaped id derived from the row, so that a recomputed task mints the same id.

    Each part goes in with its length, a null one as a bare dash, so that different rows differ.
    """
    marked = []
    for part in parts:
        text = part.cast("string")
        marked.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit("|")), F.lit("-|")))
    digest = F.md5(F.concat(*marked))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
