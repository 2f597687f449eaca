"""Best-fit packing of token sequences into sequences of fixed length.

Every document becomes its token ids and an end id; longer documents are cut into pieces, the rest first. Best-fit
decreasing then puts each piece into the fullest open sequence that still has room for it, found in a segment tree over
remaining capacities.

Pieces of one length are alike to that rule, so the plan needs only how many pieces of each length there are: at most as
many numbers as a sequence has places, however many documents there are. The plan is a list of moves ("the next 500
pieces of length 37 go, 2 each, into sequences 1000 to 1249 at place 900"); pieces are ranked inside their length by
running totals, and look up their move by (length, rank). The result is that of best-fit decreasing over all pieces.

Defined results: null text counts as empty and is one piece with the end id; ties between equal lengths go by a hash of
the id; repeated rows are pieces of their own; an empty table gives no sequence.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.running import with_total_before
from siteloom.llm.tokens import ChunkEncoder, text_slices
from siteloom.sources.scratch import written

CAPACITY = 1024
END_ID = 2


class RoomTree:
    """Segment tree over remaining capacities 0 .. capacity: the smallest one with an open sequence, in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.filled = np.zeros(2 * self.leaves, np.int64)

    def add(self, room: int, change: int) -> None:
        """Change the number of open groups with that much room."""
        at = self.leaves + room
        while at:
            self.filled[at] += change
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest room of at least ``need`` that is open."""
        at = self.leaves + need
        if self.filled[at]:
            return need
        while at > 1:
            # from a left child, look into the right one beside it
            if at % 2 == 0 and self.filled[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.filled[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_moves(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing over how many pieces have each length.

    A move: pieces of ``length`` from ``rank`` on go, ``each`` to a sequence, into the sequences from ``sequence`` on,
    beginning at place ``offset``. Sequences filled alike stay together as one range, so the number of moves depends on
    the capacity and not on the number of pieces.
    """
    tree = RoomTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}
    moves: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            ranges.setdefault(room, []).append((first, n))
            tree.add(room, 1)

    for length in sorted((k for k, n in counts.items() if n and k), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each, n = capacity // length, -(-left // (capacity // length))
                room, first, opened = capacity, opened, opened + n
            else:
                first, n = ranges[room].pop()
                tree.add(room, -1)
                each = room // length
            # the piece that comes next finds the sequence just used tightest, until it is full
            full, rest = divmod(min(left, each * n), each)
            if full:
                moves.append((length, rank, each, first, capacity - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if rest and left:
                moves.append((length, rank, rest, first + full, capacity - room))
                leave(room - rest * length, first + full, 1)
                rank, left, full = rank + rest, left - rest, full + 1
            leave(room, first + full, n - full)
    return pd.DataFrame(moves, columns=["length", "rank", "each", "sequence", "offset"], dtype=np.int64)


def _place(batches: Iterable[pa.RecordBatch], moves: pd.DataFrame) -> Iterator[pa.RecordBatch]:
    """Look up each row's move by (length, rank)."""
    moves = moves.sort_values(["length", "rank"])
    length, rank, each, sequence, offset = (moves[c].to_numpy() for c in ("length", "rank", "each", "sequence", "offset"))
    by_length = np.searchsorted(length, np.arange(length.max(initial=0) + 2))
    for batch in batches:
        own, place = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
        at = np.empty(len(own), np.int64)
        for n in np.unique(own):
            rows = own == n
            a, b = by_length[n], by_length[n + 1]
            at[rows] = a + np.searchsorted(rank[a:b], place[rows], side="right") - 1
        step = place - rank[at]
        out = {c: batch.column(c) for c in batch.schema.names if c != "_rank"}
        out["sequence_id"] = pa.array(sequence[at] + step // each[at])
        out["offset"] = pa.array(offset[at] + step % each[at] * own)
        yield pa.RecordBatch.from_pydict(out)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` from 1 to ``capacity``.

    ``pieces`` is read more than once: pass a written table. ``order`` names columns that tell its rows apart.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = best_fit_moves(counts, capacity)
    ranked = with_total_before(pieces, ["length"], order, F.lit(1).cast("long"), "_rank")
    fields = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(partial(_place, moves=moves), f"{schema}, sequence_id long, offset long")


def _cut(batches: Iterable[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder.of(path)
    for batch in text_slices(batches):
        ids, bounds = encoder.encode(batch.column("text"))
        counts = np.diff(bounds) + 1
        whole = np.full(counts.sum(), end_id, np.uint32)
        ends = np.cumsum(counts)
        inside = np.ones(len(whole), bool)
        inside[ends - 1] = False
        whole[inside] = ids
        # the rest of a document comes first, then full pieces
        rest = (counts - 1) % capacity + 1
        n = (counts - rest) // capacity + 1
        of = np.repeat(np.arange(len(counts)), n)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start = np.where(piece == 0, 0, rest[of] + (piece - 1) * capacity)
        length = np.where(piece == 0, rest[of], capacity)
        at = (ends - counts)[of] + start
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(of)),
                pa.array(piece, pa.int32()),
                pa.array(start),
                pa.array(length),
                pa.array([whole[a:b].tobytes() for a, b in zip(at, at + length, strict=True)], pa.binary()),
            ],
            ["doc_id", "piece", "start", "length", "ids"],
        )


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Pieces of the documents' token ids: doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = partial(_cut, path=os.fspath(tokenizer), end_id=end_id, capacity=capacity)
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def write_sequences(pieces: DataFrame, path: str) -> None:
    """Write packed pieces (with ids) as one row for each sequence: sequence_id, ids, doc_ids, lengths."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    rows.select(
        "sequence_id",
        F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
        F.col("parts.length").alias("lengths"),
    ).write.parquet(path)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut_documents(docs, tokenizer, end_id, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(written(pieces, "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)
