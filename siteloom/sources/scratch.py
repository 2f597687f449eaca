"""Where written results go when the caller names no path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path nobody has used yet."""
    return f"{shared_folder(spark)}/siteloom/{purpose}-{uuid.uuid4().hex}"


def written(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, computed once into the shared folder and read back: lineage ends here and survives lost executors."""
    spark = rows.sparkSession
    path = new_folder(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
