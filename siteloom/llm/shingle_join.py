"""N-gram Jaccard join with parity sketches.

A document is the set of its five-word shingles. Two sets link when their Jaccard similarity is 0.8 or more, that is when
their symmetric difference has at most a ninth of the sum of their sizes. The XOR of the hashes of a set's members tells
sets apart by their difference alone, which gives two bounds:

- Pigeonhole: the shingle hashes are cut into k blocks, k above the largest difference d of a size band, and each block's
  hashes are XORed. At least k - d blocks of two linking sets are the same, so the sets meet in a key (band, block, XOR).
  A block without shingles says nothing; a set with too many of those is cut anew by another hash, and a set that links
  with it through such blocks only has as many, so both do.
- Hamming: each shingle flips one bit of a sketch with at least as many bits as the set has members. Sketches differ in no
  more bits than the sets do; the longer of two is folded by XOR to the length of the other.

A set stands in its own band and in the one below, which holds the smaller sets it may link with. Sets that meet in a key
are told by the key's first set; all sets told by the same one are compared by sketch, in blocks when they are many. What
the sketches leave is connected into small candidate groups, and within these every pair that isn't connected already is
verified on the shingles of the whole texts. No candidate is dropped and no link is lost; equal sets are one node, and
pairs are never written, only spanning forests.

Defined results: texts without words (null, empty) have no shingles and link with nothing; with fewer than five words the
whole sequence is the one shingle; repeated rows link; sizes count distinct shingles; ids keep their type, may repeat and
may be null (a component's smallest id is null only if all of its ids are); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm import buckets
from siteloom.llm.arrays import Sequences, find_words, mix, ranges, run_starts, text_bytes, text_slices
from siteloom.llm.carried import column, unpacked, whole_row
from siteloom.llm.components import Forest, components
from siteloom.llm.hot import join_facts
from siteloom.sources.scratch import written

WIDTH = 5
LEAST_BITS = 256
#: hashes that cut a set before its empty blocks become keys
CUTS = 4
#: sets of a block that are compared by sketch, and shingles of a block that is verified
SKETCH_BLOCK = 2048
VERIFY_BLOCK = 300_000

# size bands: the sets that link with one of band b and aren't smaller are in b or b + 1
LOWEST = [1]
while LOWEST[-1] < 1 << 40:
    LOWEST.append(LOWEST[-1] * 5 // 4 + 1)
LOWEST = np.array(LOWEST)
#: by band, the largest difference of linking sets whose smaller one is in it: a ninth of (a + 5/4 a)
DIFFERENCE = (LOWEST[1:] - 1) // 4
BLOCKS = DIFFERENCE + 1 + -(-DIFFERENCE // 10)

#: records that a bucket's task looks up at a time
TOGETHER = 1 << 18


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash), sorted, each once."""
    words = find_words(*text_bytes(column), lower=True)
    counts = words.counts
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = ranges(words.first[:-1], n)
    of = np.repeat(np.arange(len(n)), n)
    values = Sequences(words.hashes).hashes(starts, starts + np.minimum(counts, width)[of])
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    once = run_starts(of, values)
    return of[once], values[once]


def _xor_by(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.bitwise_xor.at(out, of, values)
    return out


def nodes_of(of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each text's set, and a hash of the set."""
    sizes = np.bincount(of, minlength=n)
    return sizes, mix(_xor_by(of, mix(values), n) + sizes.astype(np.uint64)).astype(np.int64)


def sketch_words(sizes: np.ndarray) -> np.ndarray:
    """How many numbers of 64 bits the sketch of a set has: a power of 2."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(sizes, LEAST_BITS) / 64)).astype(np.int64)


def sketches_of(of: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketches of all sets in a row, and where each begins (one more entry than sets)."""
    bit = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    words = sketch_words(sizes)
    bounds = np.append(0, np.cumsum(words))
    cell = bounds[of] + ((bit >> np.uint64(8)) & (words[of] - 1).astype(np.uint64)).astype(np.int64)
    return _xor_by(cell, np.uint64(1) << (bit & np.uint64(63)), int(bounds[-1])), bounds


class Sketches:
    """Sketches of some sets, by length, and folded once: linking sets differ by one fold at most."""

    def __init__(self, joined: np.ndarray, bounds: np.ndarray) -> None:
        self.words = np.diff(bounds)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.words).tolist():
            own, longer = np.flatnonzero(self.words == n), np.flatnonzero(self.words == 2 * n)
            rows = [joined[bounds[own][:, None] + np.arange(n)]]
            if len(longer):
                twice = joined[bounds[longer][:, None] + np.arange(2 * n)]
                rows.append(twice[:, :n] ^ twice[:, n:])
            place = np.full(len(self.words), -1)
            place[np.concatenate([own, longer])] = np.arange(len(own) + len(longer))
            self.levels[n] = np.concatenate(rows), place

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many bits the sketches of each pair of rows differ."""
        out = np.zeros(len(a), np.int64)
        shorter = np.minimum(self.words[a], self.words[b])
        for n in np.unique(shorter).tolist():
            rows, place = self.levels[n]
            for part in np.array_split(np.flatnonzero(shorter == n), 1 + int((shorter == n).sum()) * n // (1 << 20)):
                out[part] = np.bitwise_count(rows[place[a[part]]] ^ rows[place[b[part]]]).sum(axis=1, dtype=np.int64)
        return out


def block_keys(of: np.ndarray, values: np.ndarray, sizes: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) for the blocks of each text's set, cut for a size band."""
    texts, keys = [], []
    left = (sizes > 0) & (bands >= 0)
    for cut in range(CUTS):
        pick = left[of]
        if not pick.any():
            break
        of, values = of[pick], values[pick]
        k = np.where(left, BLOCKS[bands], 0)
        base = np.cumsum(k) - k
        spread = mix(values + np.uint64(cut + 1))
        block = ((spread >> np.uint64(32)) * k[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell = base[of] + block
        n = int(k.sum())
        sums, filled = _xor_by(cell, spread, n), np.zeros(n, bool)
        filled[cell] = True
        owner = np.repeat(np.arange(len(k)), k)
        place = np.arange(n) - base[owner]
        label = mix((bands[owner] * CUTS + cut).astype(np.uint64) << np.uint64(40) | place.astype(np.uint64))
        key = mix(sums + label)
        empty = k - np.bincount(owner[filled], minlength=len(k))
        left = left & (empty >= k - DIFFERENCE[bands])
        keep = filled | left[owner] if cut == CUTS - 1 else filled
        texts.append(owner[keep])
        keys.append(key[keep])
    return (np.concatenate(texts), np.concatenate(keys)) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        n = len(batch)
        of, values = shingle_sets(batch.column("text"))
        sizes, nodes = nodes_of(of, values, n)
        joined, bounds = sketches_of(of, values, sizes)
        sketches = [joined[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes), pa.array(nodes), pa.array(sketches, pa.binary())],
            ["doc_id", "text_key", "n", "node", "sketch"],
        )


def _slice_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(node, key) of a slice's sets."""
    of, values = shingle_sets(batch.column("text"))
    sizes, nodes = nodes_of(of, values, len(batch))
    # equal sets have the same keys
    _, first = np.unique(nodes, return_index=True)
    alone = np.zeros(len(nodes), bool)
    alone[first] = True
    sizes = np.where(alone, sizes, 0)
    band = np.searchsorted(LOWEST, sizes, side="right") - 1
    found = [block_keys(of, values, sizes, b) for b in (band, band - 1)]
    texts, keys = (np.concatenate(x) for x in zip(*found, strict=True))
    return nodes[texts], keys


def _pack_keys(nodes: np.ndarray, keys: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: how many nodes, the nodes, how many keys each has there, and the keys' upper halves.

    Half a key is enough inside a bucket: keys that agree by chance are a meeting more to look at.
    """
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    half = (keys >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((half, nodes, bucket))
    bucket, nodes, half = bucket[order], nodes[order], half[order]
    once = run_starts(bucket, nodes, half)
    bucket, nodes, half = bucket[once], nodes[once], half[once]
    own = run_starts(bucket, nodes)
    counts = np.diff(np.append(own, len(nodes))).astype(np.uint32)
    first = run_starts(bucket)
    last = np.append(first[1:], len(bucket))
    lead, trail = np.searchsorted(own, first), np.searchsorted(own, last)
    blobs = [
        np.int64(d - c).tobytes() + nodes[own[c:d]].tobytes() + counts[c:d].tobytes() + half[a:b].tobytes()
        for a, b, c, d in zip(first, last, lead, trail, strict=True)
    ]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blobs, pa.binary())], ["bucket", "records"])


def _unpack_keys(blob: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    raw = blob.as_buffer()
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    nodes = np.frombuffer(raw, np.int64, n, 8)
    counts = np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
    return np.repeat(nodes, counts), np.frombuffer(raw, np.uint32, offset=8 + 12 * n)


def _keys(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in text_slices(batches):
        held.append(_slice_keys(batch))
        count += len(held[-1][0])
        if count >= buckets.HELD:
            yield from _pack_keys(*map(np.concatenate, zip(*held, strict=True)), n_buckets)
            held, count = [], 0
    if count:
        yield from _pack_keys(*map(np.concatenate, zip(*held, strict=True)), n_buckets)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, nodes, keys), some records at a time."""
    current, held, count = None, [], 0
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("records"), strict=True):
            if held and (bucket != current or count >= TOGETHER):
                yield current, *map(np.concatenate, zip(*held, strict=True))
                held, count = [], 0
            current = bucket
            held.append(_unpack_keys(blob))
            count += len(held[-1][0])
    if held:
        yield current, *map(np.concatenate, zip(*held, strict=True))


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(first, node): the sets that share a key with an earlier one of its bucket. Holds one set for each key."""
    current, known, firsts = None, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for bucket, nodes, keys in _parts(batches):
        if bucket != current:
            current, known, firsts = bucket, np.zeros(0, np.uint32), np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        nodes, keys = nodes[order], keys[order]
        own = run_starts(keys)
        at = np.searchsorted(known, keys[own])
        old = at < len(known)
        old[old] = known[at[old]] == keys[own][old]
        first = nodes[own].copy()
        first[old] = firsts[at[old]]
        first = np.repeat(first, np.diff(np.append(own, len(keys))))
        met = first != nodes
        if met.any():
            pairs = np.unique(np.stack([first[met], nodes[met]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["first", "node"])
        new = own[~old]
        known, firsts = np.insert(known, at[~old], keys[new]), np.insert(firsts, at[~old], nodes[new])


def _whole_groups(batches: Iterable[pa.RecordBatch], columns: list[str], least: int = 4000) -> Iterator[pa.Table]:
    """Tables of at least some rows, cut between groups."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        last = run_starts(*[table.column(c).to_numpy() for c in columns])[-1]
        if last:
            yield table.slice(0, last)
        held = table.slice(last).to_batches()
        rows = len(table) - int(last)
        least = max(4000, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _close_pairs(table: pa.Table, sizes: np.ndarray, sketches: Sketches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group (of its two blocks) whose sizes and sketches allow a link."""
    i, j, block = (table.column(c).to_numpy() for c in ("i", "j", "block"))
    group = np.cumsum(np.isin(np.arange(len(i)), run_starts(table.column("group").to_numpy(), i, j)))
    a = np.arange(len(group))
    step = 0
    while True:
        step += 1
        a = a[a + step < len(group)]
        a = a[group[a] == group[a + step]]
        if not len(a):
            return
        across = a[(i[a] == j[a]) | (block[a] != block[a + step])]
        b = across + step
        total = sizes[across] + sizes[b]
        fits = 9 * np.abs(sizes[across] - sizes[b]) <= total
        across, b, total = across[fits], b[fits], total[fits]
        close = 9 * sketches.apart(across, b) <= total
        if close.any():
            yield across[close], b[close]


def _sketches(table: pa.Table) -> Sketches:
    rows = table.column("sketch").to_pylist()
    return Sketches(np.frombuffer(b"".join(rows), np.uint64), np.append(0, np.cumsum([len(r) // 8 for r in rows])))


def _forest(nodes: np.ndarray, forest: Forest) -> Iterator[pa.RecordBatch]:
    root = forest.roots()
    some = np.flatnonzero(root != np.arange(len(root)))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["a", "b"])


def _screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Connect the sets of a group that their sketches don't tell apart."""
    for table in _whole_groups(batches, ["group", "i", "j"]):
        forest = Forest(len(table))
        for a, b in _close_pairs(table, table.column("n").to_numpy(), _sketches(table)):
            root = forest.roots()
            for k in np.flatnonzero(root[a] != root[b]).tolist():
                forest.join(int(a[k]), int(b[k]))
        yield from _forest(table.column("node").to_numpy(), forest)


def _verify(batches: Iterable[pa.RecordBatch], numerator: int, denominator: int) -> Iterator[pa.RecordBatch]:
    """Connect the sets of a group that link, by their shingles."""
    for table in _whole_groups(batches, ["group", "i", "j"], 400):
        of, values = _sets(table.column("text"))
        sizes, nodes = nodes_of(of, values, len(table))
        sketches = Sketches(*sketches_of(of, values, sizes))
        first = np.searchsorted(of, np.arange(len(table) + 1))
        # an id that stands for several texts brings all of them
        right = nodes == table.column("node").to_numpy()
        forest = Forest(len(table))
        for a, b in _close_pairs(table, sizes, sketches):
            root = forest.roots()
            for k in np.flatnonzero((root[a] != root[b]) & right[a] & right[b]).tolist():
                x, y = int(a[k]), int(b[k])
                if forest.find(x) == forest.find(y):
                    continue
                both = np.intersect1d(values[first[x] : first[x + 1]], values[first[y] : first[y + 1]], assume_unique=True).size
                if denominator * both >= numerator * (sizes[x] + sizes[y] - both):
                    forest.join(x, y)
        yield from _forest(nodes, forest)


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of a long column, slice by slice."""
    of, values, done = [], [], 0
    for part in text_slices(pa.table({"text": column}).to_batches()):
        o, v = shingle_sets(part.column("text"))
        of.append(o + done)
        values.append(v)
        done += len(part)
    return np.concatenate(of), np.concatenate(values)


def _in_blocks(members: DataFrame, weight: str, most: int, total: int) -> DataFrame:
    """Members of groups (group, node, ...; ``total`` rows), each group cut into blocks of about ``most`` and given out by
    pairs of blocks."""
    totals = written(members.groupBy("group").agg(F.ceil(F.sum(weight) / most).alias("blocks"), F.count("*").alias("n_members")), "blocks")
    rows = join_facts(members, totals, "group", "n_members", total, F.col("node")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")})
    return rows.drop("blocks", "_other")


def shingle_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest id that links reach)."""
    placed = written(_placed(docs, id_column, text_column), "placed")
    found = _with_component(placed, _smallest_ids(placed)).unionByName(placed.where("component is null"), allowMissingColumns=True)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def _smallest_ids(placed: DataFrame) -> DataFrame:
    ids = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("members"))
    return written(ids, "smallest")


def _with_component(placed: DataFrame, known: DataFrame) -> DataFrame:
    """The rows that are in a component, with what is known of it."""
    return join_facts(placed, known, "component", "members", placed.count(), F.xxhash64("doc_id", "text_key"))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Ids of any type, and a hash of the text: a row is known by both, as ids may repeat or be null."""
    text = column(text_column)
    return docs.select(column(id_column).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _placed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row for each document: doc_id, text_key, n (shingles), component (of its set; null without shingles)."""
    rows = _rows(docs, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    profiles = written(rows.mapInArrow(_profile, f"doc_id {kind}, text_key long, n long, node long, sketch binary"), "profiles")
    # a set's texts are looked up in one of its rows
    key = F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key")
    nodes = profiles.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), key, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("members"))
    nodes = written(nodes, "sets")
    n_buckets = buckets.bucket_count(rows)
    keys = rows.mapInArrow(partial(_keys, n_buckets=n_buckets), buckets.SCHEMA)
    met = buckets.gathered(keys, n_buckets).mapInArrow(_meet, "first long, node long").distinct()
    met = written(met, "meetings")
    told = met.union(met.select("first", "first").distinct()).select(F.col("first").alias("group"), F.col("node").alias("_node"))
    told = written(told, "told")
    sketched = told.join(nodes.select("node", "n", "sketch"), F.col("_node") == F.col("node")).drop("_node")
    groups = _in_blocks(sketched.withColumn("one", F.lit(1)), "one", SKETCH_BLOCK, told.count()).select("group", "i", "j", "block", "node", "n", "sketch")
    groups = groups.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    candidates = components(groups.mapInArrow(_screen, "a long, b long"))
    linked = components(_verified(rows, nodes, written(candidates, "candidates")))
    known = nodes.select("node", "members").join(linked, "node", "left")
    known = written(known.select("node", "members", F.coalesce("component", "node").alias("component")), "known")
    own = profiles.where("n > 0").select("doc_id", "text_key", "n", "node")
    own = join_facts(own, known, "node", "members", profiles.count(), F.xxhash64("doc_id", "text_key"))
    return own.drop("node").unionByName(profiles.where("n = 0").select("doc_id", "text_key", "n"), allowMissingColumns=True)


def _verified(rows: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links of a spanning forest of each candidate group, verified on the texts of one document of each set."""
    members = candidates.select(F.col("component").alias("group"), F.col("node").alias("_node"))
    chosen = nodes.select("node", "n", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    members = members.join(chosen, F.col("_node") == F.col("node")).drop("_node")
    texts = members.join(rows, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).select("group", "node", "n", "text")
    groups = _in_blocks(texts, "n", VERIFY_BLOCK, candidates.count()).select("group", "i", "j", "block", "node", "text")
    groups = groups.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return groups.mapInArrow(partial(_verify, numerator=80, denominator=100), "a long, b long")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component, and all that link with nothing, with their own columns.

    The one with the smallest id stays (null ids last), of texts with that id the one with the smallest hash, of rows that
    repeat id and text any one. Texts without words link with nothing and stay.
    """
    placed = written(_placed(docs, id_column, text_column).where("n > 0"), "placed")
    smallest = _smallest_ids(placed)
    of_id = _with_component(placed, smallest).where(F.col("doc_id").eqNullSafe(F.col("smallest")))
    stays = of_id.groupBy("component").agg(F.min("smallest").alias("smallest"), F.min("text_key").alias("least_key"))
    stays = written(stays.join(smallest.select("component", "members"), "component"), "stays")
    others = ~(F.col("doc_id").eqNullSafe(F.col("smallest")) & (F.col("text_key") == F.col("least_key")))
    gone = _with_component(placed, stays).where(others)
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct()
    rows = docs.select(whole_row(docs), column(id_column).alias("_id"), F.xxhash64(column(text_column)).alias("_key"))
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    again = placed.groupBy(F.col("doc_id").alias("_again"), F.col("text_key").alias("_again_key")).count().where("count > 1").drop("count")
    again = written(again, "repeated")
    if not again.isEmpty():
        same = F.col("_id").eqNullSafe(F.col("_again")) & (F.col("_key") == F.col("_again_key"))
        once = Window.partitionBy("_id", "_key").orderBy("_key")
        repeated = rows.join(again, same, "left_semi").withColumn("_turn", F.row_number().over(once)).where("_turn = 1").drop("_turn")
        rows = rows.join(again, same, "left_anti").unionByName(repeated)
    return unpacked(rows, docs)
