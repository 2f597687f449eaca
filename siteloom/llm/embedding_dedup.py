"""Near-duplicate embeddings by cross-polytope hashing, with probes and verified pairs.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is the axis with the largest
component and that component's sign. A table's bucket joins ``hashes`` such values, so that a bucket holds few vectors that
aren't near; their number follows the number of vectors. A vector stands in its own bucket and is also looked for in the
``probes`` next ones, where one component nearly won.

More hashes and longer vectors part near ones more often, so tables are added until ``RECALL`` of drawn pairs whose cosine
is exactly the bound meet (``plan``). If ``MOST_TABLES`` are too few for that, the buckets get a hash less.

Equal vectors are one node. Buckets with one node end there; vectors are shuffled for the others only. A large bucket is
cut into blocks, and each pair of blocks is a group of its own, compared by one matrix product in double precision. Pairs
are never written: a pair is counted in the first table where it meets, and a block gives link counts and the links of a
spanning forest. Every candidate pair is verified, so no link is below the bound; which ones are found is a matter of the
tables (``tests/llm`` measures recall against brute force).

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
different length don't link; equal vectors and repeated rows link with each other; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import mix, ranges, run_starts
from siteloom.llm.components import Forest, components
from siteloom.sources.scratch import written

LEAST_COSINE = 0.9
#: tables at least and at most
TABLES = 12
MOST_TABLES = 96
PROBES = 6
#: share of pairs at the bound that meet in some table, at every size
RECALL = 0.997
#: pairs that are drawn to see that
PAIRS = 4000
#: axes of a rotation that may take part in a probe
AXES = 4
#: nodes of a block
BLOCK = 512
#: rows of whole groups that a task compares together, and the most rows of a group whose product is made with others'
TOGETHER, SMALL_GROUP = 4096, 32
#: a bucket's number: 32 bits of the key, these for the table, and the vectors' length
TABLE_BITS = 8


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row (its length a power of 2), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and the transform."""
    for turn in range(3):
        bits = mix(np.arange(x.shape[1], dtype=np.uint64) + np.uint64((seed * 3 + turn) << 32))
        x = hadamard(x * np.where(bits & np.uint64(1), 1.0, -1.0))
    return x


def width_of(d: int) -> int:
    """Components that vectors of length d are filled up to."""
    return max(4, 1 << (d - 1).bit_length())


def bucket_keys(x: np.ndarray, tables: int, hashes: int, probes: int, skipped: int = 0) -> np.ndarray:
    """For unit rows, by table: the own bucket's key of 32 bits first, then those of the nearest others (probes)."""
    n, d = x.shape
    width = width_of(d)
    x = np.pad(x, ((0, 0), (0, width - d)))
    out = np.empty((n, tables, probes + 1), np.uint32)
    choices = np.array([c for c in np.ndindex(*[AXES] * hashes) if sum(map(bool, c)) <= 2])
    for at, table in enumerate(range(skipped, skipped + tables)):
        codes, losses = [], []
        for k in range(hashes):
            y = rotated(x, table * hashes + k)
            top = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :AXES]
            value = np.take_along_axis(y, top, axis=1)
            codes.append((2 * top + (value < 0)).astype(np.uint64))
            losses.append(np.square(np.abs(value[:, :1]) - np.abs(value)))
        loss = sum(losses[k][:, choices[:, k]] for k in range(hashes))
        best = np.argsort(loss, axis=1, kind="stable")[:, : probes + 1]
        key = np.full((n, len(choices)), table * 1000 + d, np.uint64)
        for k in range(hashes):
            key = mix(key) + codes[k][:, choices[:, k]]
        found = np.take_along_axis(key, best, axis=1)
        out[:, at, : found.shape[1]] = mix(found) >> np.uint64(32)
        out[:, at, found.shape[1] :] = out[:, at, :1]
    return out


def tables_for(d: int, hashes: int, probes: int, least: float) -> int | None:
    """Tables in which ``RECALL`` of drawn pairs with the cosine ``least`` meet; None if ``MOST_TABLES`` are too few."""
    n = max(500, min(PAIRS, (1 << 19) // d))
    draw = np.random.default_rng(d)
    x, y = draw.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = least * x + np.sqrt(max(0.0, 1 - least**2)) * y
    for table in range(MOST_TABLES):
        a, b = (bucket_keys(v, 1, hashes, probes, table)[:, 0] for v in (x, y))
        apart = ~((a[:, :1] == b) | (b[:, :1] == a)).any(axis=1)
        x, y = x[apart], y[apart]
        if len(x) <= (1 - RECALL) * n:
            return table + 1
    return None


def plan(counts: dict[int, int], probes: int, least: float, tables: int | None = None, hashes: int | None = None) -> tuple[int, dict[int, int]]:
    """The number of tables, and the hashes of a bucket for vectors of each width, of which there are ``counts``."""
    needed, chosen = TABLES, {}
    for width, n in counts.items():
        wanted = chosen[width] = hashes or max(1, ceil(log(max(n, 2)) / log(2 * width) + 0.3))
        if tables:
            continue
        own = MOST_TABLES
        for k in [hashes] if hashes else range(1, wanted + 1):
            found = tables_for(width, k, probes, least)
            if found is None:
                break
            own = found
        chosen[width] = k if found or k == 1 or hashes else k - 1
        needed = max(needed, own)
    return tables or needed, chosen


def _rows_of_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values in a row, and where each begins (one more entry than values)."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def _same_length(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Vectors ``at`` of one length, from their bytes."""
    letters = raw[starts[at]]
    out = np.zeros((len(at), 0))
    for letter in np.unique(letters):
        kind = np.dtype(chr(letter))
        own = np.flatnonzero(letters == letter)
        width = int(sizes[at[own[0]]]) - 1
        part = raw[starts[at[own], None] + 1 + np.arange(width)].view(kind).astype(np.float64)
        if not out.shape[1]:
            out = np.zeros((len(at), part.shape[1]))
        out[own] = part
    return out


def _dims(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many components each vector has."""
    return (np.diff(bounds) - 1) // np.where(raw[bounds[:-1]] == ord("f"), 4, 8)


def _unit(x: np.ndarray) -> np.ndarray:
    # divide by the largest component first: its square may overflow
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors in bytes behind the letter of their type, single precision where that is exact; null if they can't link."""
    for batch in batches:
        out = []
        for value in batch.column("vector").to_pylist():
            x = None if not value or None in value else np.array(value, np.float64) + 0.0
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            with np.errstate(over="ignore"):
                single = x.astype(np.float32)
            out.append(b"f" + single.tobytes() if (single == x).all() else b"d" + x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vector"])


def _sign(batches: Iterable[pa.RecordBatch], tables: int, hashes: dict[int, int], probes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        raw, bounds = _rows_of_bytes(batch.column("vector"))
        keys = np.zeros((len(batch), tables, probes + 1), np.uint32)
        sizes = _dims(raw, bounds)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            for part in np.array_split(own, len(own) // 2000 + 1):
                x = _unit(_same_length(raw, bounds[:-1], np.diff(bounds), part))
                keys[part] = bucket_keys(x, tables, hashes[width_of(int(d))], probes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sizes.astype(np.int32)), pa.array([k.tobytes() for k in keys], pa.binary())], ["node", "length", "keys"]
        )


def _keys(column: pa.Array, tables: int) -> np.ndarray:
    raw, bounds = _rows_of_bytes(column)
    return raw[bounds[0] : bounds[-1]].view(np.uint32).reshape(len(column), tables, -1)


def _list_keys(batches: Iterable[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    """(bucket, node, whether it is the node's own), each bucket once; a bucket is a vector's length, a table and a key."""
    for batch in batches:
        if not len(batch):
            continue
        keys = _keys(batch.column("keys"), tables)
        wide = keys.astype(np.int64) | (np.arange(tables, dtype=np.int64) << 32)[None, :, None]
        # keys of different lengths may be equal by chance
        wide |= (batch.column("length").to_numpy().astype(np.int64) << TABLE_BITS + 32)[:, None, None]
        own = np.zeros(wide.shape, bool)
        own[:, :, 0] = True
        nodes = np.broadcast_to(np.arange(len(batch))[:, None, None], wide.shape)
        order = np.lexsort((~own.ravel(), wide.ravel(), nodes.ravel()))
        node, bucket, own = nodes.ravel()[order], wide.ravel()[order], own.ravel()[order]
        first = run_starts(node, bucket)
        named = batch.column("node").take(pa.array(node[first]))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), named, pa.array(own[first])], ["bucket", "node", "own"])


def _compare(batches: Iterable[pa.RecordBatch], least: float, tables: int) -> Iterator[pa.RecordBatch]:
    """Verify the pairs of each (bucket, i, j): rows of block i with rows of block j. Whole groups are held until they have
    ``TOGETHER`` rows; a group has 2 * ``BLOCK`` or so."""
    held: list[pa.RecordBatch] = []
    last, count = None, 0
    for batch in batches:
        if not len(batch):
            continue
        group = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
        starts = run_starts(*group.T)
        # a group may go on in the next batch, so what is held ends where a new one begins
        begin = 0
        for a in starts.tolist():
            if count + a - begin >= TOGETHER and (a or tuple(group[0]) != last):
                held.append(batch.slice(begin, a - begin))
                yield from _compare_groups(held, least, tables)
                held, count, begin = [], 0, a
        held.append(batch.slice(begin))
        count += len(batch) - begin
        last = tuple(group[-1])
    if held:
        yield from _compare_groups(held, least, tables)


def _near_pairs(x: np.ndarray, i: np.ndarray, j: np.ndarray, block: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group with a cosine of ``least`` or more: of block i the one, of block j the other."""
    one, other = [], []
    small = np.flatnonzero(sizes <= SMALL_GROUP)
    # groups of one size have their products at once
    for n in np.unique(sizes[small]):
        own = first[small[sizes[small] == n]]
        for part in np.array_split(own, len(own) * n // TOGETHER + 1):
            rows = x[part[:, None] + np.arange(n)]
            group, a, b = np.nonzero(rows @ rows.transpose(0, 2, 1) >= least)
            one.append(part[group] + a)
            other.append(part[group] + b)
    for k in np.flatnonzero(sizes > SMALL_GROUP):
        rows = x[first[k] : first[k] + sizes[k]]
        a, b = np.nonzero(rows @ rows.T >= least)
        one.append(first[k] + a)
        other.append(first[k] + b)
    a, b = np.concatenate(one), np.concatenate(other)
    wanted = (block[a] == i[a]) & (block[b] == j[b]) & ((i[a] != j[a]) | (a < b))
    return a[wanted], b[wanted]


def _compare_groups(parts: list[pa.RecordBatch], least: float, tables: int) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(parts)
    bucket, i, j, nodes, block, copies = (rows.column(c).to_numpy() for c in ("bucket", "i", "j", "node", "block", "copies"))
    first = run_starts(bucket, i, j)
    sizes = np.diff(np.append(first, len(rows)))
    vectors = rows.column("vector").combine_chunks()
    raw, bounds = _rows_of_bytes(vectors)
    dims = _dims(raw, bounds)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    # a group's vectors have one length
    for d in np.unique(dims[first]):
        own = np.flatnonzero((dims[first] == d) & (sizes > 1))
        if not len(own):
            continue
        at = ranges(first[own], sizes[own])
        x = _unit(_same_length(raw, bounds[:-1], np.diff(bounds), at))
        begin = np.cumsum(sizes[own]) - sizes[own]
        a, b = _near_pairs(x, i[at], j[at], block[at], begin, sizes[own], least)
        pairs.append((at[a], at[b]))
    if not pairs:
        return
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    if not len(a):
        return
    keys = _keys(rows.column("keys").combine_chunks(), tables)
    counted = np.zeros(len(a), bool)
    open_pairs = np.ones(len(a), bool)
    here = bucket[a]
    own_table = here >> 32 & (1 << TABLE_BITS) - 1
    top = np.int64(1) << 32
    for table in range(tables):
        mine, theirs = keys[a, table], keys[b, table]
        one = (mine[:, :1] == theirs).any(axis=1)
        other = (theirs[:, :1] == mine).any(axis=1)
        met = open_pairs & (one | other)
        # they may meet in the own buckets of both: the smaller key counts
        where = np.minimum(np.where(one, mine[:, 0].astype(np.int64), top), np.where(other, theirs[:, 0].astype(np.int64), top))
        counted |= met & (own_table == table) & (where == here & 0xFFFFFFFF)
        open_pairs &= ~met & (own_table > table)
    a, b = a[counted], b[counted]
    if not len(a):
        return
    links = np.bincount(a, weights=copies[b], minlength=len(nodes)) + np.bincount(b, weights=copies[a], minlength=len(nodes))
    forest = Forest(len(nodes))
    while True:
        root = forest.roots()
        apart = root[a] != root[b]
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        # one new link for each root at a time, so that a hot block needs few steps in Python
        _, at = np.unique(root[a], return_index=True)
        for k in at:
            forest.join(int(a[k]), int(b[k]))
    root = forest.roots()
    some = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes[some]), pa.array(nodes[root[some]]), pa.array(links[some].astype(np.int64))], ["node", "other", "links"]
    )


def link_embeddings(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    least: float = LEAST_COSINE,
    tables: int | None = None,
    probes: int = PROBES,
    hashes: int | None = None,
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = written(rows.mapInArrow(_clean, "vec_id long, vector binary"), "vectors")
    equal = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    nodes = written(equal.withColumn("node", F.xxhash64("vector")), "nodes")
    length = F.expr("(length(vector) - 1) div if(substr(vector, 1, 1) = X'66', 4, 8)")
    sizes = nodes.groupBy(F.length(F.bin(length - 1)).alias("bits")).agg(F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    for r in sizes:
        counts[max(4, 1 << r["bits"])] = counts.get(max(4, 1 << r["bits"]), 0) + r["n"]
    tables, chosen = plan(counts, probes, least, tables, hashes)
    sign = partial(_sign, tables=tables, hashes=chosen, probes=probes)
    signed = written(nodes.select("node", "vector").mapInArrow(sign, "node long, length int, keys binary"), "signatures")
    standing = signed.mapInArrow(partial(_list_keys, tables=tables), "bucket long, node long, own boolean")
    # pairs meet where one of them stands itself
    full = standing.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("standing")).where("n > 1 and standing > 0")
    full = full.select(F.col("bucket").alias("_bucket"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    members = standing.join(full, F.col("bucket") == F.col("_bucket")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = members.withColumn("pair", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    members = members.select("bucket", F.least("block", "pair").alias("i"), F.greatest("block", "pair").alias("j"), "block", F.col("node").alias("_node"))
    told = nodes.join(signed.select(F.col("node").alias("_signed"), "keys"), F.col("node") == F.col("_signed"))
    told = told.select("node", "copies", "vector", "keys")
    groups = members.join(told, F.col("_node") == F.col("node")).drop("_node")
    groups = groups.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    compare = partial(_compare, least=least, tables=tables)
    found = written(groups.mapInArrow(compare, "node long, other long, links long"), "found")
    linked = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked_to = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(linked, "node", "left").join(linked_to, "node", "left").select("vector", "node", "least_id", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    smallest = known.groupBy(F.col("component").alias("_component")).agg(F.min("least_id").alias("smallest"))
    known = known.join(smallest, F.col("component") == F.col("_component"))
    known = known.select(F.col("vector").alias("_vector"), (F.col("links") + F.col("copies") - 1).alias("links"), "smallest")
    result = rows.join(known, F.col("vector") == F.col("_vector"), "left")
    component = F.coalesce("smallest", "vec_id")
    return result.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
