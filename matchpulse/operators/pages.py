"""Tick lists kept up by appends instead of rebuilt from the whole log.

Numbering goes on from the stored sizes of the groups, and new ticks are put into the last page of their group; full
pages and pages of other groups are neither read nor written. An append publishes a version of what it changed:
sizes of the groups it met, and the pages it filled. Readers take the latest version of each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchpulse.operators.history import PAGE_TICKS
from matchpulse.operators.slices import row_numbers, sliced
from matchpulse.sources import ledger
from matchpulse.sources.staging import staged

BY = ["session_key", "round"]
GROUP = "session_key string, round int"
TICKS = "array<struct<tick:bigint,seq:bigint,prob_ct_win:double,timestamp_ms:bigint>>"
PAGES = f"{GROUP}, page bigint, ticks {TICKS}"


def _same(left: str, right: str):
    return (F.col(f"{left}.session_key").eqNullSafe(F.col(f"{right}.session_key"))) & (F.col(f"{left}.round").eqNullSafe(F.col(f"{right}.round")))


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """Ticks of each group so far; sizes only grow, so the greatest is the latest."""
    return ledger.read(spark, f"{root}/sizes", f"{GROUP}, size bigint").groupBy(*BY).agg(F.max("size").alias("size"))


def pages(spark: SparkSession, root: str) -> DataFrame:
    """The latest version of each page."""
    held = ledger.read(spark, f"{root}/pages", PAGES)
    latest = held.groupBy(*BY, "page").agg(F.max("batch").alias("batch"))
    same = _same("h", "l") & (F.col("h.page") == F.col("l.page")) & (F.col("h.batch") == F.col("l.batch"))
    return held.alias("h").join(latest.alias("l"), same, "left_semi").select(*BY, "page", "ticks")


def append_ticks(predictions: DataFrame, root: str, version: int) -> bool:
    """Number and page new predictions (later than all before in seq); whether this version was new.

    ``version`` is the number of the batch; a version that came already changes nothing.
    """
    spark = predictions.sparkSession
    if ledger.published(spark, f"{root}/sizes", "append", version):
        return False
    cut = sliced(predictions.select(*BY, "seq", "prob_ct_win", "timestamp_ms"), [*BY, "seq"], "new-ticks")
    new = row_numbers(cut, BY, ["seq"], "tick")
    met = new.groupBy(*BY).agg(F.max("tick").alias("new"))
    before = staged(
        met.alias("m").join(sizes(spark, root).alias("s"), _same("m", "s"), "left").select("m.*", F.coalesce("s.size", F.lit(0)).alias("size")),
        "sizes-before",
    )
    numbered = new.alias("n").join(before.alias("b"), _same("n", "b")).select("n.*", "b.size").withColumn("tick", F.col("tick") + F.col("size"))
    page = F.floor((F.col("tick") - 1) / PAGE_TICKS).cast("bigint")
    fresh = numbered.select(*BY, page.alias("page"), F.struct("tick", "seq", "prob_ct_win", "timestamp_ms").alias("t"))
    # of the pages there only the last, unfilled one of a group that grows is read
    unfilled = before.filter(F.col("size") % PAGE_TICKS > 0).select(*BY, F.floor(F.col("size") / PAGE_TICKS).cast("bigint").alias("page"))
    same = _same("p", "u") & (F.col("p.page") == F.col("u.page"))
    old = pages(spark, root).alias("p").join(unfilled.alias("u"), same, "left_semi").select(*BY, "page", F.explode("ticks").alias("t"))
    filled = fresh.unionByName(old).groupBy(*BY, "page").agg(F.sort_array(F.collect_list("t")).cast(TICKS).alias("ticks"))
    ledger.publish(filled, f"{root}/pages", "append", version)
    # the sizes publish last: until they are there the version can run again over the same pages
    return ledger.publish(before.select(*BY, (F.col("size") + F.col("new")).alias("size")), f"{root}/sizes", "append", version)
