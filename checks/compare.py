"""Run queries and their SQL twins over the same files and compare every value."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, bool) or value is None or isinstance(value, (int, str, dt.date)):
        return value
    return f"{type(value).__name__}:{value}"


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def _kind(value: object) -> str:
    return type(value).__name__


# engine type names of equal types
TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, folder: str, name: str) -> str | None:
    """None when equal, else what differs."""
    result = QUERIES[name](spark, folder)
    mine = _rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    theirs = _rows(names, cursor.fetchall())
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(set(result.columns) ^ set(names))}"
    their_types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    if dict(result.dtypes) != their_types:
        return f"types {sorted(set(result.dtypes) ^ set(their_types.items()))}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [_kind(x) for x in a] != [_kind(x) for x in b]:
            return f"first difference\n  {a}\n  {b}"
    return None


def main(folder: str, prefixes: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if name not in ORACLES:
            print(f"{name}: no twin", flush=True)
            continue
        started = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"\n{name} {time.time() - started:.1f}s {'ok' if problem is None else problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
