"""Round history of a session in batch: which rounds were started and archived, and what each
player did in the last three archived rounds as of every scored event.

Same results as the keyed stream in ``streaming.state``. All functions take the sliced timeline
of :func:`timeline` or tables made from it; ordered steps run per slice (see ``slices``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchpulse import schemas
from matchpulse.operators import events as E
from matchpulse.functions import expressions as X
from matchpulse.operators.slices import SLICE, cut_by, earlier, in_slice, running_total, with_carried
from matchpulse.schemas import ORDER
from matchpulse.sources.staging import staged

HISTORY_ROUNDS = 3
#: A freezetime that announces this round or a lower one, after higher ones, begins a match.
FIRST_ROUND = 1
#: Rounds that an ``over`` may name to archive the current one, as differences.
ARCHIVE_RULES = {"equal": (0,), "equal_or_next": (0, 1)}


def timeline(events: DataFrame, slices: int | None = None, times: DataFrame | None = None) -> DataFrame:
    """Parsed events -> written, sliced timeline of control and tick rows; a slice is a range of seconds.

    ``times`` (one column, the raw log's timestamps) spares a second decoding for the cuts.
    """
    return cut_by(E.slim_timeline(events), "second", "timeline", slices, partition_by="kind", values=times)


def control_rows(line: DataFrame) -> DataFrame:
    return line.filter(F.col("kind") == "control").select(
        "session", SLICE, *ORDER, "round_phase", "round_num", "players"
    )


def tick_rows(line: DataFrame) -> DataFrame:
    return line.filter(F.col("kind") == "tick").drop("kind", "players")


def split_matches(line: DataFrame) -> DataFrame:
    """A timeline whose sessions are the single matches of the sessions, so that each match starts with no history.

    ``session`` becomes the session, a unit separator and the number of the match. A match begins at a freezetime of FIRST_ROUND
    or less when the freezetime before it announced a higher round.
    """
    freezes = control_rows(line).filter(F.col("round_phase") == "freezetime").drop("players", "round_phase")
    every = F.lit(True)
    before = F.last("round_num").over(earlier(freezes, ["session"], ORDER))
    begins = (
        with_carried(freezes, ["session"], ORDER, ["round_num"], every, every)
        .withColumn("before", before)
        .filter(~F.col("brought") & (F.col("round_num") <= FIRST_ROUND) & (F.col("before") > FIRST_ROUND))
    )
    numbered = running_total(line, ["session"], ORDER, begins, "match")
    name = F.concat("session", F.lit("\x1f"), F.col("match").cast("string"))
    return staged(numbered.withColumn("session", name).drop("match"), "matches", "kind")


def round_state(control: DataFrame) -> DataFrame:
    """Add ``current_round``: the highest round a freezetime announced before this row, at least 0."""
    announced = F.when(F.col("brought") | (F.col("round_phase") == "freezetime"), F.col("round_num"))
    return (
        with_carried(
            control,
            by=["session"],
            key=["round_num", *ORDER],
            keep=[],
            source=F.col("round_phase") == "freezetime",
            target=F.lit(True),
        )
        .withColumn("current_round", F.greatest(F.lit(0), F.max(announced).over(earlier(control, ["session"], ORDER))))
        .filter("not brought")
        .drop("brought")
    )


def transitions(line: DataFrame, archive_rule: str = "equal") -> DataFrame:
    """Start and archive rows of all sessions: at most one each per session and round.

    A freezetime that announces a higher round than any before starts it; others change nothing.
    The first ``over`` of the current round archives it; by the rule ``equal_or_next`` that of the next round does too, for
    logs whose counter moves on before the round's end is told. The first is picked with a map-side
    minimum, so a flood of ``over`` rows in one round does not meet in one task.
    """
    state = round_state(control_rows(line))
    freeze, number, current = F.col("round_phase") == "freezetime", F.col("round_num"), F.col("current_round")
    ends = (number - current).isin(*ARCHIVE_RULES[archive_rule])
    step = F.when(freeze & (number > current), "start").when(~freeze & ends, "archive")
    return (
        state.withColumn("step", step)
        .filter("step is not null")
        .withColumn("round_num", F.when(freeze, number).otherwise(current))
        .groupBy("session", "round_num", "step")
        .agg(F.min_by(F.struct(SLICE, *ORDER, "players"), F.struct(*ORDER)).alias("first"))
        .select("session", "first.*", "round_num", "step")
    )


def kill_snapshots(steps: DataFrame) -> DataFrame:
    """Each present player's running kills at the start of a round."""
    return (
        steps.filter(F.col("step") == "start")
        .select("session", *ORDER, "round_num", F.inline("players"))
        .drop("damage")
    )


def round_player_stats(steps: DataFrame) -> DataFrame:
    """Kills and damage per player and archived round.

    Kills are counted from the player's latest snapshot; without one the round counts 0 kills.
    """
    by = ["session", "player"]
    present = steps.select("session", SLICE, *ORDER, "round_num", "step", F.inline("players"))
    start, archive = F.col("step") == "start", F.col("step") == "archive"
    snapshot = F.last(F.when(F.col("brought") | start, F.col("kills")), ignorenulls=True)
    return (
        with_carried(present, by, ORDER, ["kills"], source=start, target=archive)
        .withColumn("at_start", snapshot.over(earlier(present, by, ORDER)))
        .filter(archive)
        .select(
            *by,
            SLICE,
            *ORDER,
            "round_num",
            X.whole(F.greatest(F.lit(0), F.col("kills").cast("bigint") - F.coalesce("at_start", "kills"))).alias("kills"),
            "damage",
        )
    )


def player_history(stats: DataFrame) -> DataFrame:
    """Sums over each player's last three archived rounds, this one included.

    Three of the player's own rounds: a round the player missed adds nothing and takes no place.
    """
    by = ["session", "player"]
    every = F.lit(True)
    last_three = in_slice(stats, by).orderBy(*ORDER).rowsBetween(1 - HISTORY_ROUNDS, Window.currentRow)
    return (
        with_carried(stats, by, ORDER, ["kills", "damage"], every, every, depth=HISTORY_ROUNDS - 1)
        .withColumns(
            {
                "kills_prev3": X.whole(F.sum("kills").over(last_three)),
                "damage_prev3": X.whole(F.sum("damage").over(last_three)),
            }
        )
        .filter("not brought")
        .drop("brought")
    )


def placed_ticks(line: DataFrame, archives: DataFrame) -> DataFrame:
    """Ticks with a number of their own and the archive in force before them: its slice and round."""
    ticks = tick_rows(line).withColumn("tick", F.monotonically_increasing_id())
    at = archives.select("session", SLICE, *ORDER, F.struct(F.col(SLICE).alias("home"), "round_num").alias("archive"))
    # the ticks themselves stay out of the carrying: their slices are all it needs
    marks = ticks.select("session", SLICE).distinct()
    known = F.col("archive").isNotNull()
    seen = with_carried(
        at.unionByName(marks, allowMissingColumns=True), ["session"], ORDER, ["archive"], source=known, target=~known
    )
    latest = F.last("archive", ignorenulls=True).over(earlier(ticks, ["session"], ORDER))
    return (
        ticks.unionByName(seen.filter(known).select("session", SLICE, *ORDER, "archive"), allowMissingColumns=True)
        .withColumn("archive", latest)
        .filter("tick is not null")
    )


def asked_players(placed: DataFrame) -> DataFrame:
    """Per slice, each archive some tick looks back to, with every player alive in such a tick."""
    return (
        placed.filter("archive is not null")
        .select("session", SLICE, "archive.*", F.explode(F.concat("alive_ct", "alive_t")).alias("player"))
        .distinct()
    )


def sums_in_force(asked: DataFrame, history: DataFrame) -> DataFrame:
    """The last-three sums of the asked players as of the archive, for each slice that asks."""
    by = ["session", "player"]
    question = asked.select(*by, F.col("home").alias(SLICE), "round_num").distinct()
    known = history.select(*by, SLICE, "round_num", F.struct("kills_prev3", "damage_prev3").alias("sums"))
    rows = known.withColumn("asks", F.lit(False)).unionByName(
        question.withColumn("asks", F.lit(True)), allowMissingColumns=True
    )
    # rounds grow with positions, so they order a player's rows; an answer includes its own round
    as_of = (
        in_slice(history, by)
        .orderBy("round_num", F.coalesce("asks", F.lit(False)))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    answers = (
        with_carried(rows, by, ["round_num"], ["sums"], source=~F.col("asks"), target=F.col("asks"))
        .withColumn("sums", F.last("sums", ignorenulls=True).over(as_of))
        .filter(F.col("asks") & F.col("sums").isNotNull())
        .select(*by, "round_num", "sums")
    )
    return asked.join(answers, [*by, "round_num"]).select("session", SLICE, "round_num", "player", "sums.*")


def with_prev3(placed: DataFrame, sums: DataFrame) -> DataFrame:
    """Add the four last-three-rounds sums over the living of each side.

    Ticks and sums go to the tasks of their slices in one shuffle. There each tick is spread over its
    living players, who meet their sums by (round of the archive, player), and is put together again.
    """
    side = lambda alive, name: F.transform(alive, lambda p: F.struct(F.lit(name).alias("side"), p.alias("player")))
    columns = [c for c in placed.columns if c not in ("archive", "alive_ct", "alive_t")]
    ticks = placed.select(
        *columns,
        F.col("archive.round_num").alias("as_of"),
        F.concat(side("alive_ct", "ct"), side("alive_t", "t")).alias("living"),
    )
    known = sums.select(
        "session",
        SLICE,
        F.col("round_num").alias("as_of"),
        F.array(F.struct(F.lit(None).cast("string").alias("side"), "player")).alias("living"),
        "kills_prev3",
        "damage_prev3",
    )
    own = Window.partitionBy("session", SLICE, "as_of", "one.player")
    spread = (
        ticks.unionByName(known, allowMissingColumns=True)
        .repartition("session", SLICE)
        .select(*columns, "as_of", "kills_prev3", "damage_prev3", F.explode_outer("living").alias("one"))
        .withColumns({"kills": F.max("kills_prev3").over(own), "damage": F.max("damage_prev3").over(own)})
        .filter("tick is not null")
    )
    totals = [
        X.whole(F.coalesce(F.sum(F.when(F.col("one.side") == name, F.col(value))), F.lit(0))).alias(feature)
        for feature, (name, value) in zip(
            schemas.PREV3, (("ct", "kills"), ("ct", "damage"), ("t", "kills"), ("t", "damage"))
        )
    ]
    return spread.groupBy(*columns).agg(*totals)


def staged_transitions(line: DataFrame, archive_rule: str = "equal") -> DataFrame:
    return staged(transitions(line, archive_rule), "transitions")


def staged_history(steps: DataFrame) -> DataFrame:
    return staged(player_history(round_player_stats(steps)), "history")


def tick_features(line: DataFrame, archive_rule: str = "equal") -> DataFrame:
    """Feature rows with their log position (partition, offset), from a staged timeline."""
    steps = staged_transitions(line, archive_rule)
    archives = steps.filter(F.col("step") == "archive").select("session", SLICE, *ORDER, "round_num")
    # the history of the players and the places of the ticks need nothing of each other, so their jobs run side by side
    with ThreadPoolExecutor(1) as beside:
        spark = line.sparkSession
        told = beside.submit(inheritable_thread_target(spark)(lambda: staged_history(steps)))
        placed = staged(placed_ticks(line, archives), "ticks")
        asked = staged(asked_players(placed), "asked")
        history = told.result()
    return with_prev3(placed, sums_in_force(asked, history)).select(
        "session_key",
        "round_num",
        F.col("second").alias("event_timestamp"),
        *schemas.FEATURES,
        "partition",
        "offset",
    )


def build_features(
    events: DataFrame,
    slices: int | None = None,
    times: DataFrame | None = None,
    reset_on_new_match: bool = False,
    archive_rule: str = "equal",
) -> DataFrame:
    """Parsed events -> one feature row per scored event (the 13 contract columns)."""
    line = timeline(events, slices, times)
    return tick_features(split_matches(line) if reset_on_new_match else line, archive_rule).select(*schemas.FEATURE_ROW.fieldNames())
