"""Gap-free ids for a batch of new rows, without sorting the batch in one task."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.sources.scratch import written


def dense_ids(batch: DataFrame, order: str, first: int, slices: int | None = None, id_col: str = "id") -> DataFrame:
    """Number the rows ``first``, ``first + 1``, … in the order of a unique numeric column.

    The batch is computed once, into the shared folder. The order column is cut
    into slices at approximate quantiles. Counting per slice gives every slice
    its starting number, and rows are numbered inside their slice. Where the
    cuts fall only affects balance, never the numbers. Beyond the batch itself
    only ``slices`` numbers and counts are handled, by default as many as there
    are shuffle partitions.
    """
    slices = slices or max(8, int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    batch = written(batch, "batch")
    shares = [i / slices for i in range(1, slices)]
    bounds = batch.agg(F.percentile_approx(order, shares, 10000)).first()[0] or []
    in_slice = batch.withColumn("_slice", cuts_below(F.col(order), sorted(set(bounds))))
    sizes = in_slice.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy(order))
    # one row per slice: at most ``slices`` rows are broadcast
    return (
        in_slice.join(F.broadcast(starts), "_slice")
        .withColumn(id_col, F.lit(first).cast("bigint") + F.col("_start") + place - 1)
        .drop("_slice", "_start")
    )


def cuts_below(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are below a value, in about twice the square root of their number of steps."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts) - 1) + 1
    parts = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    part = F.greatest(F.size(F.filter(F.lit([p[0] for p in parts]), lambda cut: cut < value)), F.lit(1))
    inside = F.element_at(F.array(*[F.lit(p) for p in parts]), part)
    return (part - 1) * step + F.size(F.filter(inside, lambda cut: cut < value))


def next_id(table: DataFrame) -> int:
    """One more than the highest id in use; 1 for an empty table."""
    highest = table.agg(F.max("id")).first()[0]
    return 1 if highest is None else highest + 1
