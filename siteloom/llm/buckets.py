"""Records of fixed width that travel as packed byte strings, one for each task's share of a bucket.

A shuffle of a hundred million (hash, id) pairs as rows costs more than the pairs: packed, each bucket of each task is
one row. The number of buckets follows the size of the input, so that one bucket always fits a task; records of one key
meet in one bucket, after the tasks have merged what they hold of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: text bytes whose records share a bucket
BUCKET_BYTES = 16 << 20
#: records a task holds before it packs them
HELD = 1 << 20

SCHEMA = "bucket long, records binary"


def bucket_count(rows: DataFrame, column: str = "text", size: int = BUCKET_BYTES) -> int:
    """How many buckets a table's text needs, from its bytes; at least one for each shuffle partition."""
    total = rows.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(total // size, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def pack(records: np.ndarray, keys: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that has records."""
    if not len(records):
        return
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(bucket[cuts[:-1]]),
            pa.array([records[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
        ],
        ["bucket", "records"],
    )


def packed(parts: Iterable[np.ndarray], key: str, n_buckets: int, merge: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Hold records until there are many, merge what a key has among them, and pack them by bucket."""
    held: list[np.ndarray] = []
    count = 0
    for part in parts:
        held.append(part)
        count += len(part)
        if count >= HELD:
            merged = merge(np.concatenate(held))
            yield from pack(merged, merged[key], n_buckets)
            held, count = [], 0
    if count:
        merged = merge(np.concatenate(held))
        yield from pack(merged, merged[key], n_buckets)


def gathered(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Bring the rows of a bucket together, one bucket after the other."""
    return rows.repartition(n_buckets, "bucket").sortWithinPartitions("bucket")


def parts(batches: Iterable[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, records) of each task that had some, the parts of a bucket after one another."""
    for batch in batches:
        for bucket, records in zip(batch.column("bucket").to_pylist(), batch.column("records"), strict=True):
            yield bucket, np.frombuffer(records.as_buffer(), kind)


def by_bucket(batches: Iterable[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each bucket, from batches sorted by bucket."""
    for bucket, own in groupby(parts(batches, kind), key=lambda x: x[0]):
        yield bucket, np.concatenate([records for _, records in own])
