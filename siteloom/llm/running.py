"""Running totals inside groups of any size, without one task for a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_total_before(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows that come before a row in its group.

    Rows come in the order of a hash of ``order``, then of ``order``. Each group is cut by that hash into as many parts
    as there are shuffle partitions; a window runs inside a part, and one row for each part of a group gives the offset.
    ``rows`` are read twice: pass a written table.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumns({"_part": F.pmod(F.xxhash64(*order), F.lit(parts)), "_value": value})
    sums = rows.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_part"]
    renamed = [F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]
    offsets = sums.select(*renamed, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)])
    kept = [c for c in rows.columns if c not in ("_part", "_value", "_inside")]
    return rows.join(offsets, same, "left").select(*kept, (F.col("_inside") + F.col("_offset")).alias(name))
