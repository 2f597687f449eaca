"""Rows that travel whole beside derived columns, so that no name of theirs can clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col(f"`{name}`")


def whole_row(docs: DataFrame) -> Column:
    """All columns of a row as one, named ``row``."""
    return F.struct(*[column(c) for c in docs.columns]).alias("row")


def row_schema(docs: DataFrame, added: dict[str, str]) -> StructType:
    """The schema of ``row`` and of the added columns."""
    fields = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items())).fields
    return StructType([StructField("row", docs.schema), *fields])


def unpacked(rows: DataFrame, docs: DataFrame, added: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` and the added ones; an added column takes the place of one with its name."""
    added = added or {}
    taken = {name.lower() for name in added}
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in taken]
    return rows.select(*own, *[value.alias(name) for name, value in added.items()])
