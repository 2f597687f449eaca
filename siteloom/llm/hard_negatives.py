"""Hard negatives by lists that clusters of anchors share (MAXIMUS): sorted once by angular bound, walked until certified.

Anchors are clustered by direction. For a cluster with a centre and a widest angle to its members, a candidate's inner
product with any member is at most the member's length times

    bound = length of the candidate * cos(max(0, its angle to the centre - the widest angle)).

The candidates in falling order of that bound are the cluster's list. Every member walks it and stops as soon as what it has
found can't be beaten by any bound that is left: first for its positives, then for the negatives of each positive.

On Spark a list is a histogram of bounds, which one pass over the rows counts for all clusters, and stretches of it. A round
sends the next stretch of the lists that still have members walking (each ``GROWTH`` times as long as the one before) to
the members. Members meet it in blocks of at most about ``MEMBERS`` by ``CHUNK``, walk each chunk in list order, and leave
it when certified; their best are merged, and whoever is certified against the rest of the list is out of the next round.
Certain bounds make the result exact; clusters, stretches and chunks only decide the work.

Centres are fitted on at most ``SAMPLE`` anchors, and there are at most ``CLUSTERS`` for each length of vectors. Every other
number here is computed over all rows.

Defined results: rows with a null id or label, a null or empty vector, or any null or non-finite component take no part;
rows are compared with rows of their vector's length; repeated rows are rows of their own, ties between them in any order;
zero vectors take part; an empty table gives none. Other columns don't matter. Scores are exact below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.arrays import mix, run_starts
from siteloom.llm.carried import column
from siteloom.sources.scratch import written

POSITIVES = 5
NEGATIVES = 5
#: anchors that centres are fitted on, centres for each length of vectors, anchors for a centre, rounds of fitting
SAMPLE, CLUSTERS, EACH, FITS = 4096, 64, 64, 8
#: steps of a bound in the histogram of a list
BINS = 256
#: candidates of a list's first stretch, and how much longer each further one is
HEAD, GROWTH = 50_000, 8
#: members and candidates that meet in one task at a time, and candidates of one matrix product
MEMBERS, CHUNK, STEP = 512, 8192, 1024
#: what rounding may take from a bound
SLACK = 1e-7

VECTOR = "dim int, vector binary, norm double"


# --- vectors -----------------------------------------------------------------
def _packed(vector: np.ndarray) -> bytes:
    """Whole numbers as briefly as they go."""
    return vector.astype("<i2" if np.abs(vector).max(initial=0) < 1 << 15 else "<f8").tobytes()


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    out = np.empty((len(vectors), dim))
    for i, packed in enumerate(vectors):
        data = packed.as_buffer()
        out[i] = np.frombuffer(data, "<i2" if data.size == 2 * dim else "<f8")
    return out


def _clean(batches: Iterable[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("vector")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(lists.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(counts) - counts
        bad = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=~np.isfinite(flat), minlength=len(counts)) > 0
        good = np.flatnonzero((counts > 0) & ~bad)
        flat = np.floor(scale * flat)
        vectors = [flat[starts[i] : starts[i] + counts[i]] for i in good]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c).take(pa.array(good)) for c in ("id", "label", "anchor")],
                pa.array(counts[good].astype(np.int32)),
                pa.array([_packed(v) for v in vectors], pa.binary()),
                pa.array([float(np.sqrt(v @ v)) for v in vectors], pa.float64()),
            ],
            ["id", "label", "anchor", "dim", "vector", "norm"],
        )


def fit_centres(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Unit vectors in the middle of directions that belong together."""
    lengths = np.linalg.norm(vectors, axis=1)
    units = vectors[lengths > 0] / lengths[lengths > 0, None]
    if not len(units):
        return np.eye(1, vectors.shape[1])
    centres = units[np.linspace(0, len(units) - 1, min(clusters, len(units))).astype(int)]
    for _ in range(FITS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def _angles(vectors: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T / np.maximum(norms, 1e-300)[:, None], -1, 1))


@dataclass
class Lists:
    """What tasks need to know of all lists: a bounded number of centres, and the stretch that is walked now."""

    centres: dict[int, np.ndarray]
    #: (dim, cluster) -> widest angle of a member
    widest: dict[tuple[int, int], float] = field(default_factory=dict)
    longest: float = 1.0
    #: (dim, cluster) -> (lowest bin, highest bin, least bound that somebody asks for, chunks, blocks of members)
    stretch: dict[tuple[int, int], tuple[int, int, float, int, int]] = field(default_factory=dict)

    def centres_of(self, dim: int) -> np.ndarray:
        """Any direction is right where none was fitted."""
        return self.centres.get(dim, np.eye(1, dim))

    def bounds(self, dim: int, cluster: int, angles: np.ndarray, norms: np.ndarray) -> np.ndarray:
        apart = np.maximum(0.0, angles[:, cluster] - self.widest[dim, cluster] - SLACK)
        return norms * np.cos(apart)

    def bins(self, bounds: np.ndarray) -> np.ndarray:
        return np.clip((bounds / self.longest + 1) / 2 * BINS, 0, BINS - 1).astype(np.int64)

    def top_of(self, highest: int) -> float:
        """No bound in this bin or below is larger."""
        return ((highest + 1) * 2 / BINS - 1) * self.longest if highest < BINS - 1 else np.inf


def _by_dim(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            own = batch.take(pa.array(np.flatnonzero(dims == dim)))
            yield dim, own, _matrix(own.column("vector"), dim), own.column("norm").to_numpy(zero_copy_only=False)


def _assign(batches: Iterable[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    for dim, batch, vectors, norms in _by_dim(batches):
        angles = _angles(vectors, norms, lists.centres_of(dim))
        nearest = angles.argmin(axis=1)
        angle = np.where(norms > 0, angles.min(axis=1), 0.0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "cluster", "angle"]
        )


def _count_bins(batches: Iterable[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], np.ndarray] = {}
    for dim, _, vectors, norms in _by_dim(batches):
        angles = _angles(vectors, norms, lists.centres_of(dim))
        for key in lists.widest:
            if key[0] == dim:
                own = np.bincount(lists.bins(lists.bounds(*key, angles, norms)), minlength=BINS)
                counts[key] = counts.get(key, 0) + own
    for (dim, cluster), own in counts.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), dim, np.int32)), pa.array(np.full(len(some), cluster, np.int32)), pa.array(some.astype(np.int32)), pa.array(own[some])],
            ["dim", "cluster", "bin", "n"],
        )


def _send(batches: Iterable[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    """The candidates of the stretches that are walked now, once for each block of members."""
    for dim, batch, vectors, norms in _by_dim(batches):
        angles = _angles(vectors, norms, lists.centres_of(dim))
        rows = mix(batch.column("row").to_numpy(zero_copy_only=False).astype(np.uint64))
        for (d, cluster), (low, high, least, chunks, blocks) in lists.stretch.items():
            if d != dim:
                continue
            bounds = lists.bounds(dim, cluster, angles, norms)
            bins = lists.bins(bounds)
            wanted = np.flatnonzero((bins >= low) & (bins <= high) & (bounds + SLACK * lists.longest >= least))
            if not len(wanted):
                continue
            own = batch.take(pa.array(wanted))
            chunk = (rows[wanted] % np.uint64(chunks)).astype(np.int32)
            for block in range(blocks):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(wanted), cluster, np.int32)),
                        pa.array(np.full(len(wanted), block, np.int32)),
                        pa.array(chunk),
                        *[own.column(c) for c in ("row", "id", "label_key", "dim", "vector")],
                        pa.array(bounds[wanted]),
                    ],
                    ["cluster", "block", "chunk", "row", "id", "label_key", "dim", "vector", "bound"],
                )


# --- walking -----------------------------------------------------------------
def _walk(members: pa.Table, candidates: pa.Table, count: int, least_percent: int) -> pa.Table:
    """The best of one chunk for one block of members: member row, slot, score, candidate's id and row.

    Without targets a member looks for its best rows of the same label; with them, for each target's best rows of another
    label whose score is between ``least_percent`` of the target and the target.
    """
    names = ["member", "slot", "score", "id", "other"]
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
    nothing = pa.table([pa.array([], k) for k in kinds], names=names)
    if not len(members) or not len(candidates):
        return nothing
    candidates = candidates.combine_chunks().sort_by([("bound", "descending")])
    members = members.combine_chunks()
    dim = members.column("dim")[0].as_py()
    bounds, ids, rows = (candidates.column(c).to_numpy() for c in ("bound", "id", "row"))
    labels = candidates.column("label_key").to_numpy()
    own_rows, own_labels, norms = (members.column(c).to_numpy() for c in ("row", "label_key", "norm"))
    vectors = _matrix(members.column("vector"), dim)
    targets = members.column("targets").to_pylist()
    fifths = members.column("least").to_pylist()
    looking = [(m, s) for m in range(len(members)) for s in range(len(targets[m]) if targets[m] is not None else 1)]
    of, slot = (np.array(x, np.int64) for x in zip(*looking, strict=True)) if looking else (np.zeros(0, np.int64),) * 2
    target = np.array([np.inf if targets[m] is None else float(targets[m][s]) for m, s in looking])
    same = np.array([targets[m] is None for m, _ in looking], bool)
    # a score below this is of no use
    known = [fifths[m][s] if fifths[m] is not None and s < len(fifths[m]) else None for m, s in looking]
    least = np.array([-np.inf if k is None else float(k) for k in known])
    low = np.where(same, -np.inf, np.where(np.isfinite(target), target, 0) * least_percent)
    kept = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    for a in range(0, len(candidates), STEP):
        reach = (bounds[a] + SLACK * abs(bounds[a])) * norms[of] + SLACK
        walking = np.flatnonzero((reach >= least) & (100 * reach >= low))
        if not len(walking):
            break
        part = slice(a, a + STEP)
        who, back = np.unique(of[walking], return_inverse=True)
        scores = (vectors[who] @ _matrix(candidates.column("vector")[part], dim).T)[back]
        w = of[walking]
        fits = (own_labels[w][:, None] == labels[part][None, :]) == same[walking][:, None]
        fits &= own_rows[w][:, None] != rows[part][None, :]
        fits &= (scores <= target[walking][:, None]) & (100 * scores >= low[walking][:, None]) & (scores >= least[walking][:, None])
        if scores.shape[1] > count:
            masked = np.where(fits, scores, -np.inf)
            fits &= scores >= np.partition(masked, -count, axis=1)[:, -count][:, None]
        x, y = np.nonzero(fits)
        looker = np.concatenate([kept[0], walking[x]])
        place = np.concatenate([kept[1], y + a])
        score = np.concatenate([kept[2], scores[x, y]])
        order = np.lexsort((ids[place], -score, looker))
        looker, place, score = looker[order], place[order], score[order]
        first = run_starts(looker)
        size = np.diff(np.append(first, len(looker)))
        rank = np.arange(len(looker)) - np.repeat(first, size)
        full = size >= count
        least[looker[first[full]]] = np.maximum(least[looker[first[full]]], score[first[full] + count - 1])
        best = rank < count
        kept = [looker[best], place[best], score[best]]
    looker, place, score = kept
    return pa.table(
        [pa.array(v, k) for v, k in zip((own_rows[of[looker]], slot[looker].astype(np.int32), score, ids[place], rows[place]), kinds, strict=True)], names=names
    )


FOUND = "member long, slot int, score double, id long, other long"


def _best(found: DataFrame, count: int) -> DataFrame:
    """The first ``count`` of each member and slot."""
    order = Window.partitionBy("member", "slot").orderBy(F.col("score").desc(), "id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _walk_lists(rows: DataFrame, members: DataFrame, lists: Lists, histogram: dict[tuple[int, int], np.ndarray], count: int, least_percent: int) -> DataFrame:
    """All rounds: for each member and slot its first ``count`` (member, slot, score, id, other, rank).

    ``members``: row, label_key, dim, cluster, block, norm, vector, targets.
    """
    spark = rows.sparkSession
    found = written(_best(spark.createDataFrame([], FOUND), count), "best")
    head = HEAD
    below = {key: BINS - 1 for key in histogram}
    walking = members.withColumn("least", F.lit(None).cast("array<double>"))
    while True:
        lowest = F.array_min(F.col("targets")) * (least_percent / 100) / F.nullif("norm", F.lit(0.0))
        # a list's members, and the least bound that any of them can use
        active = walking.groupBy("dim", "cluster").agg((F.max("block") + 1).alias("blocks"), F.min(F.coalesce(lowest, F.lit(float("-inf")))).alias("least")).collect()
        lists.stretch = {}
        for r in active:
            key = (r["dim"], r["cluster"])
            high = below.get(key, -1)
            if high < 0 or not histogram[key][: high + 1].any():
                continue
            below_high = np.cumsum(histogram[key][: high + 1][::-1])
            low = high - min(int(np.searchsorted(below_high, head)), high)
            size = int(histogram[key][low : high + 1].sum())
            lists.stretch[key] = (low, high, float(r["least"]), max(-(-size // CHUNK), 1), r["blocks"])
            below[key] = low - 1
        if not lists.stretch:
            return found
        sent = rows.mapInArrow(
            partial(_send, lists=lists), "cluster int, block int, chunk int, row long, id long, label_key long, dim int, vector binary, bound double"
        )
        chunks = [(d, c, n) for (d, c), (_, _, _, n, _) in lists.stretch.items()]
        asked = walking.join(F.broadcast(spark.createDataFrame(chunks, "dim int, cluster int, chunks int")), ["dim", "cluster"])
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        keys = ["dim", "cluster", "block", "chunk"]
        walk = partial(_walk, count=count, least_percent=least_percent)
        # the function itself is what Spark asks for its arguments
        new = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(lambda left, right: walk(left, right), FOUND)
        found = written(_best(found.drop("rank").unionByName(new), count), "best")
        # whoever may still find something below the stretch walks on
        full = found.where(F.col("rank") == count).groupBy(F.col("member").alias("row")).agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_fifth")
        )
        slots = F.sequence(F.lit(0), F.coalesce(F.size("targets"), F.lit(1)) - 1)
        left = [(d, c, float(lists.top_of(below[d, c])) if below[d, c] >= 0 else None) for d, c in histogram]
        rest = F.broadcast(spark.createDataFrame(left, "dim int, cluster int, reach double"))
        reach = F.col("reach") * F.col("norm") + SLACK * (F.abs("reach") * F.col("norm") + 1)
        again = members.join(rest, ["dim", "cluster"]).where("reach is not null").join(full, "row", "left")
        again = again.withColumn("least", F.transform(slots, lambda s: F.element_at(F.col("_fifth"), s)))
        open_slot = F.exists(F.coalesce("least", F.array(F.lit(None).cast("double"))), lambda x: x.isNull() | (reach >= x))
        useful = F.col("targets").isNull() | (100 * reach >= F.array_min(F.col("targets")) * least_percent)
        walking = written(again.where(open_slot & useful).select(*members.columns, "least"), "walking")
        head *= GROWTH


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str | Column = "label",
    scale: float = 256,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = 80,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the inner product with the anchor, higher ones first, ties by id. An
    anchor's positives are its first other rows of its label; a positive's negatives are the first rows of other labels
    whose score is between ``least_percent`` of the positive's and the positive's.
    """
    label = column(label_column) if isinstance(label_column, str) else label_column
    rows = vectors.select(
        column(id_column).cast("long").alias("id"),
        label.alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        column(vector_column).cast("array<double>").alias("vector"),
    ).where("id is not null and label is not null and vector is not null")
    kind = rows.schema["label"].dataType.simpleString()
    rows = rows.mapInArrow(partial(_clean, scale=scale), f"id long, label {kind}, anchor boolean, {VECTOR}")
    # equal labels are told by a hash of 64 bits
    rows = written(rows.select("id", F.xxhash64("label").alias("label_key"), "anchor", "dim", "vector", "norm", F.monotonically_increasing_id().alias("row")), "vectors")
    anchors = rows.where("anchor")
    sizes = rows.groupBy("dim").agg(F.count_if("anchor").alias("n"), F.max("norm").alias("longest")).where("n > 0").collect()
    sample = anchors.orderBy(F.xxhash64("id"), "row").limit(SAMPLE).select("dim", "vector").collect()
    centres = {}
    for r in sizes:
        own = [s["vector"] for s in sample if s["dim"] == r["dim"]]
        if own:
            centres[r["dim"]] = fit_centres(_matrix(pa.array([bytes(v) for v in own], pa.binary()), r["dim"]), min(CLUSTERS, -(-r["n"] // EACH)))
    lists = Lists(centres, longest=max([r["longest"] for r in sizes if r["longest"]], default=1.0))
    assigned = anchors.mapInArrow(partial(_assign, lists=lists), f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, cluster int, angle double")
    assigned = written(assigned, "anchors")
    clusters = assigned.groupBy("dim", "cluster").agg(F.max("angle").alias("widest"), F.count("*").alias("n")).collect()
    lists.widest = {(r["dim"], r["cluster"]): r["widest"] for r in clusters}
    if not clusters:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks = F.broadcast(rows.sparkSession.createDataFrame([(r["dim"], r["cluster"], -(-r["n"] // MEMBERS)) for r in clusters], "dim int, cluster int, blocks int"))
    counted = rows.mapInArrow(partial(_count_bins, lists=lists), "dim int, cluster int, bin int, n long").groupBy("dim", "cluster", "bin").agg(F.sum("n").alias("n"))
    histogram = {key: np.zeros(BINS, np.int64) for key in lists.widest}
    for r in counted.collect():
        histogram[r["dim"], r["cluster"]][r["bin"]] = r["n"]
    members = assigned.join(blocks, ["dim", "cluster"]).select(
        "row", "label_key", "dim", "cluster", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), "norm", "vector"
    )
    best = _walk_lists(rows, members.withColumn("targets", F.lit(None).cast("array<double>")), lists, histogram, positives, least_percent)
    ranked = best.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("_own"))
    asking = members.join(ranked, F.col("row") == F.col("member")).select(*members.columns, F.col("_own.score").alias("targets"))
    mined = _walk_lists(rows, written(asking, "asking"), lists, histogram, negatives, least_percent)
    pairs = best.select("member", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("_positive"))
    named = assigned.select(F.col("row").alias("member"), F.col("id").alias("anchor_id"))
    out = mined.join(pairs, ["member", "slot"]).join(named, "member")
    return out.select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("_positive").cast("long").alias("positive_score"),
        F.col("score").cast("long").alias("negative_score"),
    )
