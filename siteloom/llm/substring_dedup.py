"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

A window is ``WINDOW`` consecutive words of a document; a word goes if a window that holds it also starts elsewhere.

Reference blocks. Each window points to its anchor, the leftmost smallest hash among its runs of ``ANCHOR`` words, so equal
windows point to equal anchors at equal places. The windows that point to one anchor form a block, the stretch of words
they cover, and every document is a row of overlapping blocks. All blocks of all documents are indexed by their anchor.

Factors. A document is parsed against that index. A block whose whole stretch is indexed elsewhere is a factor as it is.
A block whose anchor is indexed elsewhere in other stretches is parsed greedily from left to right: at each place the
longest match with any other block of its anchor is taken, found beside it among those with the same words to the left of
the anchor, sorted by the words to the right. A match of ``WINDOW`` words or more is a factor, and the parse goes on with
the first window over the factor's boundary; a shorter match moves it one word on. So each window either lies in a factor
or was looked up and starts nowhere else. Factors that overlap grow together. A block whose anchor is found nowhere else
ends the search there.

Crowded anchors. A passage that a large part of all documents hold in different surroundings gives one anchor as many
blocks. The blocks of an anchor with more than ``GROUP`` of them do not meet in one task: their windows are looked up one by
one, dealt by window instead of by anchor, which finds the same words.

What one task holds of an anchor or window is merged before the shuffle: a stretch that a third of all documents share
leaves one record for each task, and the rest is settled there.

Defined results: null and empty texts have no words; documents shorter than a window keep all; repeated rows are
documents, so their windows start elsewhere; ids may repeat (a row is known by id and text); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm import buckets
from siteloom.llm.arrays import Sequences, Words, find_words, mix, ranges, run_starts, text_bytes, text_slices
from siteloom.sources.scratch import written

WINDOW = 35
ANCHOR = 12

#: a block: its anchor, its stretch, the row it is in, its first window, how many windows, and whether it stands for other
#: stretches with the anchor
BLOCK = np.dtype([("anchor", "<u8"), ("stretch", "<u8"), ("row", "<i8"), ("start", "<i8"), ("windows", "<i4"), ("mixed", "?")])
SEEN = np.dtype([("window", "<u8"), ("row", "<i8"), ("start", "<i8")])

#: the most words of a window on one side of its anchor
SIDE = WINDOW - ANCHOR
#: a block to be parsed and matched: its anchor, the row it is in, its first window, how many windows, the words left of the
#: anchor, and the hashes of the words before and behind the anchor, outwards, 0 beyond the block
REFERENCE = np.dtype(
    [("anchor", "<u8"), ("row", "<i8"), ("start", "<i8"), ("windows", "<i4"), ("left", "<i4"), ("before", "<u8", (SIDE,)), ("behind", "<u8", (SIDE,))]
)
#: blocks of one anchor that are parsed in one task; those of an anchor with more are looked up window by window
GROUP = 1 << 15
#: crowded anchors that are sent to all blocks (8 bytes each); more are joined by anchor
FEW_CROWDED = 1 << 18
#: references a task holds before it packs them, and how many it parses at a time
HELD = PARSED = 1 << 15

#: (factor or doubtful block, row, first word, end, anchor): factors in words and without an anchor, doubtful blocks in windows
SPANS = "doubtful boolean, row long, start long, stop long, anchor long"
#: what travels in the second look-up: references, factors that a task found itself, windows of crowded anchors
REFERENCES, FOUND, WINDOWS = 0, 1, 2


def _words(column: pa.Array) -> Words:
    return find_words(*text_bytes(column))


def blocks_of(words: Words, rows: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The blocks of some texts."""
    n = len(words.hashes)
    reach = window - anchor + 1
    if n < window:
        return np.zeros(0, BLOCK)
    grams = Sequences(words.hashes).hashes(np.arange(n - anchor + 1), np.arange(n - anchor + 1) + anchor)
    # the leftmost smallest hash of ``reach`` neighbours, from minima over 1, 2, 4, ... of them
    least, place, size = mix(grams), np.arange(len(grams)), 1
    while size < reach:
        step = min(size, reach - size)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        size += step
    counts = np.maximum(words.counts - window + 1, 0)
    starts = ranges(words.first[:-1], counts)
    if not len(starts):
        return np.zeros(0, BLOCK)
    of = np.repeat(np.arange(len(counts)), counts)
    at = place[starts]
    first = run_starts(of, at)
    length = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    out = np.zeros(len(first), BLOCK)
    out["anchor"] = grams[at[first]]
    whole = Sequences(words.hashes).hashes(begin, begin + length + window - 1)
    out["stretch"] = mix(whole + (at[first] - begin).astype(np.uint64))
    out["row"] = rows[of[first]]
    out["start"] = begin - words.first[of[first]]
    out["windows"] = length
    return out


def _spans(doubtful: bool, row: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(row), doubtful)), pa.array(row), pa.array(start), pa.array(stop), pa.array(anchor.view(np.int64))],
        ["doubtful", "row", "start", "stop", "anchor"],
    )


def _factors(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Factors as rows; those of a row that touch as one."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    if len(row):
        # the furthest end so far inside each row, by an offset that keeps rows apart
        number = np.cumsum(np.isin(np.arange(len(row)), run_starts(row))) - 1
        apart = number * (int(stop.max()) + 2)
        furthest = np.maximum.accumulate(stop + apart)
        new = np.ones(len(row), bool)
        new[1:] = (start + apart)[1:] > furthest[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row)) - 1
        row, start, stop = row[first], start[first], furthest[last] - apart[first]
    return _spans(False, row, start, stop, np.zeros(len(row), np.uint64))


def _block_factors(blocks: np.ndarray) -> pa.RecordBatch:
    return _factors(blocks["row"], blocks["start"], blocks["start"] + blocks["windows"].astype(np.int64) + WINDOW - 1)


def _doubtful(blocks: np.ndarray) -> pa.RecordBatch:
    return _spans(True, blocks["row"], blocks["start"], blocks["start"] + blocks["windows"].astype(np.int64), blocks["anchor"].copy())


def _span_bytes(spans: pa.RecordBatch) -> bytes:
    return np.stack([spans.column(c).to_numpy() for c in ("row", "start", "stop", "anchor")], axis=1).tobytes()


def _from_bytes(doubtful: bool, records: pa.Scalar) -> pa.RecordBatch:
    row, start, stop, anchor = np.frombuffer(records.as_buffer(), np.int64).reshape(-1, 4).T.copy()
    return _spans(doubtful, row, start, stop, anchor)


def _as_row(kind: int, spans: pa.RecordBatch, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task settles itself, as one row in some bucket."""
    if len(spans):
        bucket = int(mix(spans.column("row").to_numpy()[:1].view(np.uint64))[0] % np.uint64(n_buckets))
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([_span_bytes(spans)], pa.binary())], ["kind", "bucket", "records"]
        )


def _as_rows(kind: int, records: np.ndarray, keys: np.ndarray, n_buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in buckets.pack(records, keys, n_buckets):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), kind, np.int32)), *batch.columns], ["kind", *batch.schema.names])


def _merge_blocks(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For blocks of one task: one for each anchor, the ones that are factors, the doubtful ones."""
    held = held[np.lexsort((held["start"], held["row"], held["stretch"], held["anchor"]))]
    by_stretch = run_starts(held["anchor"], held["stretch"])
    counts = np.diff(np.append(by_stretch, len(held)))
    leads = held[by_stretch]
    by_anchor = run_starts(leads["anchor"])
    stretches = np.diff(np.append(by_anchor, len(leads)))
    one = leads[by_anchor]
    one["mixed"] |= stretches > 1
    further = np.ones(len(leads), bool)
    further[by_anchor] = False
    return one, held[np.repeat(counts > 1, counts)], leads[further]


def _index(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks by anchor (kind 0), and what the task itself settles: factors (1) and doubtful blocks (2)."""
    held: list[np.ndarray] = []
    count = 0

    def flush() -> Iterator[pa.RecordBatch]:
        one, factors, doubtful = _merge_blocks(np.concatenate(held))
        yield from _as_rows(0, one, one["anchor"], n_buckets)
        yield from _as_row(1, _block_factors(factors), n_buckets)
        yield from _as_row(2, _doubtful(doubtful), n_buckets)

    for batch in text_slices(batches):
        held.append(blocks_of(_words(batch.column("text")), batch.column("row").to_numpy()))
        count += len(held[-1])
        if count >= buckets.HELD:
            yield from flush()
            held.clear()
            count = 0
    if count:
        yield from flush()


def _look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors and doubtful blocks, from the blocks of one anchor after the other."""

    def blocks() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in (1, 2):
                for records in batch.filter(pa.array(batch.column("kind").to_numpy() == kind)).column("records"):
                    ready.append(_from_bytes(kind == 2, records))
            yield batch.filter(pa.array(batch.column("kind").to_numpy() == 0))

    ready: list[pa.RecordBatch] = []
    for _, found in buckets.by_bucket(blocks(), BLOCK):
        yield from ready
        ready.clear()
        found = found[np.lexsort((found["start"], found["row"], found["stretch"], found["anchor"]))]
        by_anchor = run_starts(found["anchor"])
        per_anchor = np.diff(np.append(by_anchor, len(found)))
        by_stretch = run_starts(found["anchor"], found["stretch"])
        per_stretch = np.diff(np.append(by_stretch, len(found)))
        of = np.repeat(np.arange(len(by_anchor)), per_anchor)
        stretches = np.bincount(of[by_stretch], minlength=len(by_anchor))
        mixed = (stretches > 1) | np.logical_or.reduceat(found["mixed"], by_anchor)
        factor = np.repeat(per_stretch > 1, per_stretch)
        leads = np.zeros(len(found), bool)
        leads[by_stretch] = True
        doubtful = leads & mixed[of]
        yield _block_factors(found[factor])
        yield _doubtful(found[doubtful])
    yield from ready


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of (start, stop), null as empty: which list each is in, the starts and the stops."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    inner = lists.flatten()
    starts, stops = (pc.struct_field(inner, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "stop"))
    return np.repeat(np.arange(len(lists)), counts), starts, stops


def _merge_windows(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One record for each window, and the ones that start more than once in this task."""
    held = held[np.lexsort((held["start"], held["row"], held["window"]))]
    first = run_starts(held["window"])
    counts = np.diff(np.append(first, len(held)))
    return held[first], held[np.repeat(counts > 1, counts)]


def references_of(words: Words, rows: np.ndarray, of: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The blocks with windows ``starts`` to ``stops`` of texts ``of``, with the words around their anchors."""
    out = np.zeros(len(of), REFERENCE)
    if not len(of):
        return out
    n = len(words.hashes)
    grams = Sequences(words.hashes).hashes(np.arange(n - ANCHOR + 1), np.arange(n - ANCHOR + 1) + ANCHOR)
    begin = words.first[of] + starts
    end = begin + (stops - starts) + WINDOW - 1
    left = np.argmin(mix(grams)[begin[:, None] + np.arange(SIDE + 1)], axis=1)
    anchor = begin + left
    before = anchor[:, None] - 1 - np.arange(SIDE)
    behind = anchor[:, None] + ANCHOR + np.arange(SIDE)
    out["anchor"], out["row"], out["start"] = grams[anchor], rows[of], starts
    out["windows"], out["left"] = stops - starts, left
    out["before"] = np.where(before >= begin[:, None], words.hashes[np.maximum(before, 0)], np.uint64(0))
    out["behind"] = np.where(behind < end[:, None], words.hashes[np.minimum(behind, n - 1)], np.uint64(0))
    return out


def parse(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the factors in words, for blocks that come with all others of their anchors."""
    blocks = blocks[np.lexsort((*blocks["behind"].T[::-1], blocks["anchor"]))]
    left, behind = blocks["left"].astype(np.int64), blocks["behind"]
    last = left - blocks["windows"] + 1
    # the anchor with 0, 1, 2, ... words before it
    same = [blocks["anchor"].copy()]
    for i in range(SIDE):
        same.append(mix(same[-1] * np.uint64(3) + blocks["before"][:, i]))
    place, found = left.copy(), []
    for words_left in range(SIDE, -1, -1):
        here = (place == words_left) & (words_left >= last)
        if not here.any():
            continue
        # blocks that share the words before, in the order of the words behind: the longest match is a neighbour's
        order = np.flatnonzero(left >= words_left)
        order = order[np.argsort(same[words_left][order], kind="stable")]
        key = same[words_left][order]
        near = np.flatnonzero((key[1:] == key[:-1]) & (here[order[1:]] | here[order[:-1]]))
        one, other = order[near], order[near + 1]
        common = np.logical_and.accumulate((behind[one] == behind[other]) & (behind[one] != 0), axis=1).sum(axis=1)
        longest = np.full(len(blocks), -1)
        longest[one] = common
        longest[other] = np.maximum(longest[other], common)
        factor = here & (longest >= SIDE - words_left)
        start = blocks["start"][factor] + left[factor] - words_left
        found.append((blocks["row"][factor], start, start + words_left + ANCHOR + longest[factor]))
        place[here] = words_left - 1
        place[factor] = SIDE - 1 - longest[factor]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, start, stop


def _windows_of(words: Words, rows: np.ndarray, of: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    each = np.repeat(of, stops - starts)
    start = ranges(starts, stops - starts)
    at = start + words.first[each]
    out = np.empty(len(at), SEEN)
    out["window"] = Sequences(words.hashes).hashes(at, at + WINDOW)
    out["row"], out["start"] = rows[each], start
    return out


def _window_factors(windows: np.ndarray) -> pa.RecordBatch:
    return _factors(windows["row"], windows["start"], windows["start"] + WINDOW)


def _doubted(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Doubtful blocks with their words, by anchor; of crowded anchors their windows, and factors that the task finds."""
    references: list[np.ndarray] = []
    windows: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if references:
            packed = np.concatenate(references)
            yield from _as_rows(REFERENCES, packed, packed["anchor"], n_buckets)
        if windows:
            one, repeated = _merge_windows(np.concatenate(windows))
            yield from _as_rows(WINDOWS, one, one["window"], n_buckets)
            yield from _as_row(FOUND, _window_factors(repeated), n_buckets)
        references.clear()
        windows.clear()

    for batch in text_slices(batches):
        words, rows, lists = _words(batch.column("text")), batch.column("row").to_numpy(), batch.column("blocks")
        of, starts, stops = _flat(lists)
        crowded = pc.struct_field(lists.flatten(), "crowded").to_numpy(zero_copy_only=False).astype(bool)
        for part in np.array_split(np.flatnonzero(~crowded), len(of) // HELD + 1):
            references.append(references_of(words, rows, of[part], starts[part], stops[part]))
            if sum(map(len, references)) >= HELD:
                yield from flush()
        if crowded.any():
            windows.append(_windows_of(words, rows, of[crowded], starts[crowded], stops[crowded]))
        if sum(map(len, windows)) >= buckets.HELD:
            yield from flush()
    yield from flush()


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of the blocks of one anchor after the other, and of windows that start more than once."""

    def records() -> Iterator[tuple[tuple[int, int], pa.Scalar]]:
        for batch in batches:
            yield from zip(
                zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), strict=True), batch.column("records"), strict=True
            )

    for (_, kind), own in groupby(records(), key=lambda x: x[0]):
        if kind == FOUND:
            for _, spans in own:
                yield _from_bytes(False, spans)
        elif kind == WINDOWS:
            yield _window_factors(_merge_windows(np.concatenate([np.frombuffer(r.as_buffer(), SEEN) for _, r in own]))[1])
        else:
            held = np.concatenate([np.frombuffer(r.as_buffer(), REFERENCE) for _, r in own])
            held = held[np.argsort(held["anchor"], kind="stable")]
            first = run_starts(held["anchor"])
            cuts = [*first[run_starts(first // PARSED)].tolist(), len(held)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield _factors(*parse(held[a:b]))


def duplicate_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(row, start, stop): stretches of words that windows starting elsewhere cover; they may overlap. ``row`` is a hash
    of id and text."""
    rows = _rows(docs, id_column, text_column)
    n_buckets = buckets.bucket_count(rows)
    index = rows.mapInArrow(partial(_index, n_buckets=n_buckets), f"kind int, {buckets.SCHEMA}")
    spans = written(buckets.gathered(index, n_buckets).mapInArrow(_look_up, SPANS), "factors")
    doubtful = spans.where("doubtful")
    # blocks are counted before the shuffle, so a crowded anchor is one row of each task there
    counted = doubtful.groupBy(F.col("anchor").alias("_anchor")).count()
    crowded = written(counted.where(F.col("count") > GROUP).select("_anchor"), "crowded")
    if crowded.count() <= FEW_CROWDED:
        crowded = F.broadcast(crowded)
    marked = doubtful.join(crowded, F.col("anchor") == F.col("_anchor"), "left")
    block = F.struct("start", "stop", F.col("_anchor").isNotNull().alias("crowded"))
    own = marked.groupBy(F.col("row").alias("_row")).agg(F.collect_list(block).alias("blocks"))
    again = rows.join(own, F.col("row") == F.col("_row")).select("row", "text", "blocks")
    seen = again.mapInArrow(partial(_doubted, n_buckets=n_buckets), f"kind int, {buckets.SCHEMA}")
    dealt = seen.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
    parsed = dealt.mapInArrow(_settle, SPANS)
    return spans.where("not doubtful").union(parsed).select("row", "start", "stop")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.xxhash64(F.col(id_column), F.col(text_column)).alias("row"), F.col(text_column).alias("text"))


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and cut the words under each row's spans, and join the others by one space."""
    for batch in text_slices(batches, "_text"):
        n = batch.num_columns - 2
        words = _words(batch.column("_text"))
        total = len(words.starts)
        of, starts, stops = _flat(batch.column("_spans"))
        starts, stops = starts + words.first[of], stops + words.first[of]
        depth = np.bincount(starts, minlength=total + 1) - np.bincount(stops, minlength=total + 1)
        kept = np.cumsum(depth)[:total] == 0
        texts = words.texts[kept]
        begin, size = words.starts[kept], (words.ends - words.starts)[kept]
        # each kept word with a space behind it, but for the last one of a text
        last = np.append(texts[1:] != texts[:-1], True) if len(texts) else np.zeros(0, bool)
        room = size + (~last).astype(np.int64)
        at = np.cumsum(room) - room
        out = np.full(room.sum(), 32, np.uint8)
        out[ranges(at, size)] = words.raw[ranges(begin, size)]
        bounds = np.append(0, np.cumsum(np.bincount(texts, weights=room, minlength=len(batch)).astype(np.int64)))
        joined = pa.Array.from_buffers(pa.large_string(), len(batch), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(n)],
                pa.array(words.counts.astype(np.int64)),
                pa.array(words.counts - np.bincount(texts, minlength=len(batch))),
                joined.cast(pa.string()),
            ],
            [*batch.schema.names[:n], "n_words", "n_removed", "kept_text"],
        )


def remove_duplicate_spans(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: its id, n_words, n_removed, kept_text (the other words, joined by one space)."""
    own = spans.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    row = F.xxhash64(F.col(id_column), F.col(text_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), row.alias("row"), F.col(text_column).alias("_text"))
    joined = rows.join(own, F.col("row") == F.col("_row"), "left").select("doc_id", "_text", "_spans")
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_keep, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
