"""Ordered work on groups of any size: contiguous slices, and rows carried into a slice.

A window over a whole session would put the session in one task, and one session may hold a
third of all rows. Tables are therefore range-partitioned by (group, order): Spark samples the
keys, so a hot group is cut into as many slices as its size asks for. Windows then run per
(group, slice), and what a slice must know of the earlier ones arrives as a few carried rows.
Slices are contiguous, so a carried row sorts before the rows of the slice by itself. Windows
that span slices see one row per slice, never the rows themselves.

Every table is cut, small ones too: there is one plan for all sizes. Groups may have null keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchpulse.sources.staging import staged

SLICE = "slice"
#: Rows a slice should hold: a slice is a task and a file.
SLICE_ROWS = 500_000
#: Slices of a table of any size.
LEAST_SLICES = 8
#: Slices of a table cut by ranges of one number.
MOST_SLICES = 1024
#: So many cuts are looked at in one step.
STEP = 32


def sliced(
    df: DataFrame,
    order: list[str],
    name: str,
    slices: int | None = None,
    partition_by: str | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` as a written table with a slice column, cut into slices of about ``slice_rows`` (or into ``slices``).

    Written twice: first so that what is behind ``df`` runs once (counting the rows and
    sampling the cuts are passes of their own), then to fix the sampled cuts for all readers.
    """
    table = staged(df, f"{name}-rows", partition_by)
    count = slices or max(LEAST_SLICES, math.ceil(table.count() / slice_rows))
    cuts = table.repartitionByRange(count, *order).withColumn(SLICE, F.spark_partition_id())
    return staged(cuts, name, partition_by)


def place_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts lie below a value, 0 for null; found in two steps, so a row looks at few cuts."""
    below = lambda held: F.size(F.filter(held, lambda cut: cut < value))
    whole = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    if len(cuts) <= STEP:
        return below(whole) if cuts else F.lit(0)
    steps = below(F.array(*[F.lit(c).cast("bigint") for c in cuts[::STEP]]))
    return F.when(steps == 0, 0).otherwise((steps - 1) * STEP + below(F.slice(whole, (steps - 1) * STEP + 1, F.lit(STEP))))


def value_grid(values: DataFrame, at: str) -> tuple[int, list[int]]:
    """The number of rows and MOST_SLICES - 1 approximate quantiles of a whole number, none if it is always null."""
    grid = [i / MOST_SLICES for i in range(1, MOST_SLICES)]
    known = values.select(F.col(at).cast("bigint").alias("at"))
    rows, found = known.agg(F.count(F.lit(1)), F.percentile_approx("at", grid, 20 * MOST_SLICES)).first()
    return rows, list(found or [])


def cuts_of(grid: list[int], count: int) -> list[int]:
    """The values that part a grid of quantiles into ``count`` ranges, fewer if values repeat."""
    count = min(count, MOST_SLICES)
    return sorted({grid[i * MOST_SLICES // count - 1] for i in range(1, count)}) if grid else []


def cut_by(
    df: DataFrame,
    at: str,
    name: str,
    slices: int | None = None,
    partition_by: str | None = None,
    values: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` as a table, written once, with a slice column: ranges of the whole number ``at``, which grows with the order.

    For all groups the cuts are the same, so a group has rows in as many slices as it lasts. They come from the number
    and the approximate quantiles of ``values`` (one column, as cheap as it may be; else of ``df`` itself). Rows of one
    value stay together; null belongs to the first slice. More than MOST_SLICES slices are not made, they grow instead.
    """
    rows, found = value_grid(*((df, at) if values is None else (values, values.columns[0])))
    count = min(MOST_SLICES, slices or max(LEAST_SLICES, math.ceil(rows / slice_rows)))
    cuts = cuts_of(found, count)
    return staged(df.withColumn(SLICE, place_of(F.col(at), cuts).cast("int")), name, partition_by)


def with_carried(
    df: DataFrame, by: list[str], key: list[str], keep: list[str], source: Column, target: Column, depth: int = 1
) -> DataFrame:
    """``df`` and, for every (by, slice) with a ``target`` row, the last ``source`` rows of the earlier slices.

    Carried rows have ``brought`` = true, the columns by, key and keep, and nulls elsewhere. They
    are the ``depth`` greatest by ``key``; above depth 1 the key must grow with the slices, as
    positions do.
    """
    row, rank = F.struct(*key, *keep), F.struct(*key)
    wanted = df.groupBy(*by, SLICE).agg(F.max(target).alias("wanted"))
    slices_before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    if depth == 1:
        greatest = F.max_by(F.when(source, row), F.when(source, rank))
        per_slice = df.groupBy(*by, SLICE).agg(greatest.alias("tail"), F.max(target).alias("wanted"))
        # the running greatest, so the key need not grow with the slices
        running = F.array(F.max("tail").over(slices_before))
    else:
        # only the last rows of each slice leave it; a mark per slice tells where they are wanted
        newest = in_slice(df, by).orderBy(*[F.desc(c) for c in key])
        tails = (
            df.filter(source)
            .withColumn("age", F.row_number().over(newest))
            .filter(F.col("age") <= depth)
            .groupBy(*by, SLICE)
            .agg(F.sort_array(F.collect_list(row), asc=False).alias("tail"))
        )
        per_slice = (
            tails.unionByName(wanted, allowMissingColumns=True)
            .groupBy(*by, SLICE)
            .agg(F.first("tail", ignorenulls=True).alias("tail"), F.max("wanted").alias("wanted"))
            .withColumn("filled", F.col("tail").isNotNull())
        )
        with_previous = Window.partitionBy(*by, "filled").orderBy(SLICE).rowsBetween(1 - depth, 0)
        latest = F.sort_array(F.flatten(F.collect_list("tail").over(with_previous)), asc=False)
        per_slice = per_slice.withColumn("tail", F.when(F.col("filled"), F.slice(latest, 1, depth)))
        running = F.last("tail", ignorenulls=True).over(slices_before)
    brought = (
        per_slice.withColumn("tail", running)
        .filter("wanted")
        .select(*by, SLICE, F.explode("tail").alias("row"))
        .filter("row is not null")
        .select(*by, SLICE, "row.*", F.lit(True).alias("brought"))
    )
    return df.withColumn("brought", F.lit(False)).unionByName(brought, allowMissingColumns=True)


def in_slice(df: DataFrame, by: list[str]):
    """Window over the group's rows of one slice."""
    return Window.partitionBy(*by, SLICE)


def earlier(df: DataFrame, by: list[str], order: list[str]):
    """Window over the rows of the slice that precede the current one."""
    return in_slice(df, by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str, newest_first: bool = False) -> DataFrame:
    """1..N inside each group over a table from :func:`sliced`, from the first row or from the last.

    The number of rows in the slices before comes as a carried row, so null keys need no join. The
    columns of ``df`` without the slice, then ``name``.
    """
    ordered = [F.desc(c) if newest_first else F.col(c) for c in order]
    passed = Window.partitionBy(*by).orderBy(F.desc(SLICE) if newest_first else F.col(SLICE))
    sizes = df.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(passed.rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.select(*by, SLICE, F.coalesce(before, F.lit(0)).alias("_step"), F.lit(0).alias("_own"))
    steps = df.withColumns({"_step": F.lit(1).cast("bigint"), "_own": F.lit(1)})
    place = in_slice(df, by).orderBy("_own", *ordered).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        steps.unionByName(carried, allowMissingColumns=True)
        .withColumn(name, F.sum("_step").over(place))
        .filter("_own = 1")
        .select(*[c for c in df.columns if c != SLICE], name)
    )


def running_total(df: DataFrame, by: list[str], order: list[str], steps: DataFrame, name: str) -> DataFrame:
    """Rows of a sliced table with the number of ``steps`` (by, slice, order) of their group that are not after them.

    A step at a row's own place counts for it. Steps of earlier slices come as one carried row per slice.
    """
    marked = steps.select(*by, SLICE, *order, F.lit(1).cast("bigint").alias("_step"), F.lit(1).alias("_own"))
    there = df.select(*by, SLICE).distinct().withColumn("_step", F.lit(0).cast("bigint"))
    per_slice = marked.select(*by, SLICE, "_step").unionByName(there).groupBy(*by, SLICE).agg(F.sum("_step").alias("steps"))
    before = F.sum("steps").over(Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1))
    carried = per_slice.select(*by, SLICE, F.coalesce(before, F.lit(0)).alias("_step"), F.lit(0).alias("_own"))
    rows = df.withColumns({"_step": F.lit(0).cast("bigint"), "_own": F.lit(2)})
    # what is carried comes first, then by place, a step before the rows of its place
    place = in_slice(df, by).orderBy(F.col("_own") > 0, *order, "_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.unionByName(marked, allowMissingColumns=True)
        .unionByName(carried, allowMissingColumns=True)
        .withColumn(name, F.sum("_step").over(place))
        .filter("_own = 2")
        .drop("_step", "_own")
    )
