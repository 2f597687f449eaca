"""Token counts of sections: encode whole documents once, then attribute tokens to sections by their character spans.

A section's tokens are those of the whole document, not of the section encoded alone, so the counts of a document's
sections add up to its token count. Sections are the lines of a text (a line feed ends the line it stands in), or stretches
that begin at given characters. A token that reaches over the end of a section is counted by one of these rules:

- ``first``: it belongs to the section that holds its first character,
- ``last``: to the section that holds its last one,
- ``most``: to the section that holds most of its characters, of equals to the first.

A token that is a part of a character covers that character. Spans come from the ids: each stands for a known number of
bytes. The interval join runs inside a document, where both sides are in order.

Defined results: null and empty texts are one section of no characters with no tokens; a text that ends with a line feed
has no empty last line; repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import text_bytes
from siteloom.llm.tokens import ChunkEncoder, text_slices

RULES = ("first", "last", "most")


def attribute(token_starts: np.ndarray, token_ends: np.ndarray, section_starts: np.ndarray, rule: str) -> np.ndarray:
    """The index of the section that each token belongs to; spans and sections are in order, and count characters."""
    first = np.searchsorted(section_starts, token_starts, side="right") - 1
    if rule == "first":
        return first
    last = np.searchsorted(section_starts, token_ends - 1, side="right") - 1
    if rule == "last":
        return last
    best, most = first.copy(), np.zeros(len(first), np.int64)
    ends = np.append(section_starts[1:], np.iinfo(np.int64).max)
    for step in range(int((last - first).max(initial=-1)) + 1):
        at = np.minimum(first + step, last)
        share = np.minimum(token_ends, ends[at]) - np.maximum(token_starts, section_starts[at])
        better = share > most
        best[better], most[better] = at[better], share[better]
    return best


def _attribute(batches: Iterable[pa.RecordBatch], path: str, rule: str, given: bool) -> Iterator[pa.RecordBatch]:
    encoder = ChunkEncoder.of(path)
    for batch in text_slices(batches):
        raw, bounds = text_bytes(batch.column("text"))
        ids, first = encoder.encode(batch.column("text"))
        n = len(batch)
        # characters before each byte; a byte inside a character has the character's number
        lead = (raw & 0xC0) != 0x80
        chars = np.append(0, np.cumsum(lead))
        char_of = np.append(chars[1:] - 1, chars[-1])
        text_chars = chars[bounds]
        ends = np.cumsum(encoder.widths[ids])
        starts = ends - encoder.widths[ids]
        token_starts, token_ends = char_of[starts], char_of[ends - 1] + 1
        if given:
            own = [np.array(v or [], np.int64) for v in batch.column("starts").to_pylist()]
            lists = [np.unique(np.append(0, v[(v > 0) & (v < c)])) for v, c in zip(own, np.diff(text_chars), strict=True)]
            sizes = np.array([len(v) for v in lists], np.int64)
            section_starts = np.concatenate([v + c for v, c in zip(lists, text_chars, strict=False)])
        else:
            line_ends = np.flatnonzero(raw == 10) + 1
            inner = line_ends[~np.isin(line_ends, bounds)]
            texts = np.searchsorted(bounds, inner, side="right") - 1
            of = np.concatenate([np.arange(n), texts])
            begin = np.concatenate([text_chars[:-1], char_of[inner]])
            order = np.lexsort((begin, of))
            section_starts = begin[order]
            sizes = np.bincount(of, minlength=n)
        of = np.repeat(np.arange(n), sizes)
        section_ends = np.append(section_starts[1:], text_chars[-1])
        # empty texts begin where the next one does: look tokens up among the sections that hold something
        filled = np.flatnonzero(section_ends > section_starts)
        counts, crossing = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        if len(ids):
            chosen = filled[attribute(token_starts, token_ends, section_starts[filled], rule)]
            counts = np.bincount(chosen, minlength=len(of))
            begun = filled[attribute(token_starts, token_ends, section_starts[filled], "first")]
            crossing = np.bincount(begun[token_ends > section_ends[begun]], minlength=len(of))
        number = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(of)),
                pa.array(number, pa.int32()),
                pa.array(section_starts - text_chars[of]),
                pa.array(section_ends - text_chars[of]),
                pa.array(counts.astype(np.int64)),
                pa.array(crossing.astype(np.int64)),
            ],
            ["doc_id", "section", "start", "end", "tokens", "crossing"],
        )


def section_tokens(
    docs: DataFrame,
    tokenizer: str,
    rule: str = "first",
    starts_column: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row for each section: doc_id, section (from 0), start, end (characters), tokens, and crossing: how many tokens
    begin in the section and reach beyond its end.

    ``starts_column``: an array of the characters at which sections begin (0 always does), instead of lines.
    """
    if rule not in RULES:
        raise ValueError(f"no such rule: {rule}")
    columns = [F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")]
    if starts_column:
        columns.append(F.col(starts_column).cast("array<long>").alias("starts"))
    rows = docs.select(*columns)
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = partial(_attribute, path=os.fspath(tokenizer), rule=rule, given=bool(starts_column))
    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, `end` long, tokens long, crossing long")
