"""Small records that are replaced as a whole: every state is a numbered folder with one file, and the highest counts.

A state is written by moving one file into place, so a crash leaves either the old state or the new one. States are for
bounded records (a manifest, a marker); one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

NUMBER = "versione"


def latest(spark: SparkSession, path: str, schema: str) -> tuple[int, list[Row]]:
    """Number and rows of the state that counts; 0 and no rows where there is none yet."""
    try:
        states = spark.read.schema(f"{schema}, {NUMBER} int").parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    highest = states.agg(F.max(NUMBER)).first()[0]
    if highest is None:
        return 0, []
    return highest, states.where(F.col(NUMBER) == highest).drop(NUMBER).collect()


def publish(spark: SparkSession, path: str, schema: str, rows: list[tuple], number: int) -> None:
    """Make ``rows`` the state ``number``; what a crash left of an earlier try is replaced."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{NUMBER}={number}")
