import pytest
from pyspark.sql import functions as F

from matchpulse import schemas
from matchpulse.operators import rounds
from matchpulse.operators.events import parse_events
from matchpulse.sources import derived
from tests.model import sequential_features


def check(spark, raw, slices, reset=False, rule="equal"):
    raw_rows = [
        dict(key=r.key, value=r.value, second=r.second, partition=r.partition, offset=r.offset)
        for r in raw.withColumn("second", F.col("timestamp").cast("bigint")).collect()
    ]
    want = sequential_features(raw_rows, reset, rounds.ARCHIVE_RULES[rule])
    line = rounds.timeline(parse_events(raw), slices)
    line = rounds.split_matches(line) if reset else line
    got = {
        (r.partition, r.offset): (r.round_num, *[r[c] for c in schemas.PREV3])
        for r in rounds.tick_features(line, rule).collect()
    }
    assert got == want
    return got


@pytest.mark.parametrize("disordered,slices", [(False, 7), (True, 1), (True, 7), (True, 40)])
def test_batch_equals_sequential_model(spark, sf_dir, disordered, slices):
    got = check(spark, derived.telemetry(spark, sf_dir, disordered), slices)
    assert sum(any(v[1:]) for v in got.values()) > len(got) / 3


@pytest.mark.parametrize("slices", [1, 7, 40])
def test_matches_of_a_session_and_the_lenient_rule(spark, sf_dir, slices):
    """Rounds run up and begin anew several times in a session."""
    raw = derived.telemetry(spark, sf_dir, True)
    number = F.regexp_extract("value", r'"round":(-?\d+)', 1).try_cast("int")
    again = F.regexp_replace("value", r'"round":-?\d+', F.concat(F.lit('"round":'), (F.pmod(number, F.lit(9)) - 1).cast("string")))
    raw = raw.withColumn("value", F.when(number.isNotNull(), again).otherwise(F.col("value")))
    both = check(spark, raw, slices, True, "equal_or_next")
    assert both != check(spark, raw, slices) and sum(any(v[1:]) for v in both.values()) > len(both) / 5


def test_a_session_of_100_000_players(spark):
    """New players every round of one keyless session: each tick sees its own players' sums only."""
    number = F.floor(F.col("id") / 3)
    phase = F.element_at(F.array(F.lit("freezetime"), F.lit("over"), F.lit("live")), (F.col("id") % 3 + 1).cast("int"))
    done = F.when(phase == "freezetime", 0).otherwise(1)
    entry = lambda j: F.struct(
        F.concat(F.lit("p"), (number * 10 + j).cast("string")),
        F.struct(
            F.when(j < 5, F.lit("CT")).otherwise(F.lit("T")).alias("team"),
            F.struct(F.lit(100).alias("health"), (done * 7).alias("round_totaldmg")).alias("state"),
            F.struct((done * 2).alias("kills")).alias("match_stats"),
        ),
    )
    players = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(9)), entry))
    body = F.struct(
        F.struct((number + 1).alias("round")).alias("map"), F.struct(phase.alias("phase")).alias("round"), players.alias("allplayers")
    )
    raw = spark.range(30_000).select(
        F.lit(None).cast("string").alias("key"),
        F.to_json(body).alias("value"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"),
        F.lit(0).alias("partition"),
        F.col("id").alias("offset"),
    )
    found = rounds.build_features(parse_events(raw)).groupBy(*schemas.PREV3).count().collect()
    assert [tuple(r) for r in found] == [(10, 35, 10, 35, 10_000)]
