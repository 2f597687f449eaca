"""Joins of rows with what is known of their keys, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a key that holds this part of all rows or more (there are at most as many) meets its rows in several places
PARTS = 1000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int, salt: Column) -> DataFrame:
    """The rows with the other columns of ``facts``, which has one row for each ``key`` and tells in ``count`` its rows.

    Rows of a large key are dealt over several places by ``salt``, and the key's facts go to each of them; a place holds
    about a thousandth of the ``total`` of rows. Rows without facts go, and so do rows without key. ``facts`` is read
    twice, so it should be a written table.
    """
    sized = facts.withColumn("_places", F.greatest(F.ceil(F.col(count) * PARTS / max(total, 1)), F.lit(1)).cast("long"))
    # at most PARTS rows, as counts add up to the total
    large = F.broadcast(sized.where("_places > 1").select(F.col(key).alias("_large"), F.col("_places").alias("_spread")))
    dealt = rows.where(F.col(key).isNotNull()).join(large, F.col(key) == F.col("_large"), "left")
    dealt = dealt.withColumn("_place", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_spread")), F.lit(0).cast("long"))).drop("_large", "_spread")
    copies = sized.withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_places") - 1))).drop("_places", count)
    return dealt.join(copies, [key, "_place"]).drop("_place")
