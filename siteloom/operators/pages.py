"""Pages of an ordered register that is stored in ranges of its order.

The register is cut into ranges once, each a folder with its rows in order, and
the rows of each range are counted. A page is found by those counts: it reads the
one or two ranges that hold its rows, however far down it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siteloom.sources.scratch import written

RANGE = "fetta"
ORDER = "_ordine"


@dataclass(frozen=True)
class Register:
    """An ordered register in a folder; ``before`` has the rows ahead of each range, and those of all at the end."""

    path: str
    before: tuple[int, ...]
    schema: StructType

    @property
    def rows(self) -> int:
        return self.before[-1]

    def slice(self, spark: SparkSession, first: int, count: int) -> DataFrame:
        """Rows ``first`` (from 0) to ``first + count`` in order."""
        hit = [k for k, (a, b) in enumerate(zip(self.before, self.before[1:], strict=False)) if a < first + count and b > first]
        if not hit:
            return spark.createDataFrame([], self.schema)
        held = spark.read.parquet(self.path).where(F.col(RANGE).isin(hit))
        skip = max(first - self.before[hit[0]], 0)
        count = max(min(count, self.rows - first), 0)
        # the ranges' rows in order: as many as the page and what is ahead of it there
        return held.orderBy(ORDER).limit(skip + count).offset(skip).select(*self.schema.names)

    def page(self, spark: SparkSession, number: int, size: int) -> DataFrame:
        """Page ``number``, from 1."""
        return self.slice(spark, (number - 1) * size, size)


def store_register(rows: DataFrame, order: list[Column], path: str, ranges: int) -> Register:
    """Write rows in ranges of their order (which has to tell all rows apart) to a folder that must not exist.

    The order is one global range sort; a place in it is kept with each row as (partition, place), so that nothing is
    numbered across partitions.
    """
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the upper bits are the partition, the lower ones the place in it
    placed = written(ordered.withColumn(ORDER, F.monotonically_increasing_id()), "register")
    placed.withColumn(RANGE, F.shiftright(ORDER, 33).cast("int")).write.partitionBy(RANGE).mode("errorifexists").parquet(path)
    counts = placed.groupBy(F.shiftright(ORDER, 33).cast("int").alias(RANGE)).agg(F.count(F.lit(1)).alias("n"))
    sizes = [0] * ranges
    for r in counts.collect():  # one row for each range
        sizes[r[RANGE]] = r["n"]
    before = [0]
    for n in sizes:
        before.append(before[-1] + n)
    return Register(path, tuple(before), rows.schema)
