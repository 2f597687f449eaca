"""Byte-level BPE by prefix dynamic programming: each prefix of bytes keeps the one token that its encoding ends with.

Two neighbouring tokens are an encoding of their bytes when no merge could have reached over the boundary before the merges
on both sides were made; a row of tokens is the encoding of its bytes when all neighbours are. So the encoding of a prefix
is the encoding of a shorter prefix and one more token, and exactly one token fits. A table of these tokens, one for each
byte, is all that is stored:

* bytes that come behind never change it, so text is appended exactly by going on with the table;
* an entry depends on the bytes and entries of one token's length before it, so behind an edit the table is computed anew
  only until that many entries equal the old ones, and the rest is taken over.

Text is first split by ``pattern`` and each match is encoded by itself, as the tiktoken library does; a match that is a token
is that token. What a letter, a number or a space is, is what tiktoken's tables say: characters for which the ``regex``
module says something else are split as a stand-in of the right kind.

Matches repeat, so a worker keeps the tokens of those it has seen and computes tables for new ones only. No step looks at a
part of a text only.

Defined results: null counts as the empty text and has no ids; ids that are null or outside the vocabulary decode to null;
repeated rows are encoded each; an empty table gives none; an added column takes the place of one with its name.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import SLICE_BYTES, ranges
from siteloom.llm.carried import row_schema, unpacked, whole_row

#: matches and ids that a worker keeps, and pairs of tokens whose fit it knows; each starts anew beyond it
KEPT_MATCHES, KEPT_IDS, KEPT_PAIRS = 1 << 19, 1 << 22, 1 << 19
#: characters behind its end that a match of the pattern may have looked at
LOOK_AHEAD = 4
#: a character of each kind that both tables agree on, and that no alternative of a pattern spells out
STAND_INS = {r"\p{L}": "é", r"\p{N}": "²", r"\s": " ", "": "†"}


@cache
def stand_ins() -> dict[int, str]:
    """Characters that the ``regex`` module puts into another class than tiktoken does, each with its stand-in."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    kinds = {}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks=single, special_tokens={})
        there = set(bytes(theirs.encode_ordinary(every)).decode())
        here = set(regex.findall(kind, every))
        kinds[kind] = (there, there ^ here)
    odd = set().union(*(changed for _, changed in kinds.values()))
    return {ord(c): STAND_INS[next((kind for kind, (there, _) in kinds.items() if c in there), "")] for c in odd}


class Vocabulary:
    """Tokens by rank, the two tokens that each was merged from, and which neighbours fit."""

    _known: dict[str, Vocabulary] = {}

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(token) for token in self.tokens]
        self.longest = max(self.sizes)
        lengths = np.array(self.sizes, np.int64)
        self.lengths, self.places = lengths, np.cumsum(lengths) - lengths
        self.pool = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.joined: dict[tuple[int, int], int] = {}
        #: the left and right part of a token; bytes have none
        self.parts: list[tuple[int, int] | None] = [None] * size
        self._fits: dict[tuple[int, int], bool] = {}
        #: finds every token that ends at a byte; bytes are characters of the same number here
        self.ends = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1 or self._learn(token, rank):
                self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.forget()

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        """One for each worker process."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _learn(self, token: bytes, rank: int) -> bool:
        """Find the two earlier tokens that merge to this one; without any, only a whole match can be it."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if max(left, right) < rank and self._fit(left, right):
                self.parts[rank] = (left, right)
                self.joined[left, right] = rank
                return True
        return False

    def _fit(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side are the encoding of their bytes.

        Merges are undone backwards in time, on whichever side was merged last (of equal ones, the right one). A merge
        over the boundary that would have come before the one that is undone means that the two never arise.
        """
        joined, parts, bound = self.joined, self.parts, len(self.parts)
        while True:
            if joined.get((left, right), bound) < bound:
                return False
            a, b = parts[left], parts[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[left, right] = self._fit(left, right)
        return known

    # --- tables ---------------------------------------------------------------
    def extend(self, table: list[int], data: bytes, old: Sequence[int] = (), shift: int = 0, same_from: int | None = None) -> list[int]:
        """Go on with the table of a match's first ``len(table)`` bytes until it covers ``data``.

        ``old`` may be the table of an earlier text whose bytes from ``same_from - shift`` on equal those of ``data`` from
        ``same_from`` on; its entries are taken over as soon as one token's length of them came out equal.
        """
        sizes, fits, longest = self.sizes, self.fits, self.longest
        done = len(table)
        equal = 0
        # tokens that end behind ``done`` begin at most one token's length before it
        begin = max(done - longest + 1, 0)
        for end, (token, size) in self.ends.iter(data.decode("latin-1"), begin):
            if end < done or len(table) > end:
                continue
            before = end - size
            if before < -1 or before >= 0 and not fits(table[before], token):
                continue
            table.append(token)
            if same_from is not None and end >= same_from:
                equal = equal + 1 if old[end - shift] == token else 0
                if equal >= longest and min(end, end - shift) >= 2 * longest:
                    table.extend(old[end - shift + 1 :])
                    break
        return table

    def read(self, table: Sequence[int]) -> list[int]:
        """The tokens of a match, from its table."""
        out, at, sizes = [], len(table), self.sizes
        while at:
            out.append(table[at - 1])
            at -= sizes[out[-1]]
        return out[::-1]

    def match_ids(self, data: bytes, table: Sequence[int] | None = None) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.read(self.extend([], data) if table is None else table)

    # --- many texts -----------------------------------------------------------
    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.starts, self.ids = array("q", [0]), array("i")

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts given by their matches, in a row, and where each text's begin (one more entry than texts)."""
        if len(self.seen) > KEPT_MATCHES or len(self.ids) > KEPT_IDS:
            self.forget()
        seen = self.seen
        for matches in texts:
            for match in set(matches).difference(seen):
                seen[match] = len(self.starts) - 1
                self.ids.extend(self.match_ids(match.encode()))
                self.starts.append(len(self.ids))
        counts = [len(matches) for matches in texts]
        which = np.fromiter((seen[m] for matches in texts for m in matches), np.int64, sum(counts))
        starts = np.array(self.starts)
        sizes = (starts[1:] - starts[:-1])[which]
        found = np.array(self.ids)[ranges(starts[which], sizes)]
        ends = np.append(0, np.cumsum(sizes))
        return found, ends[np.append(0, np.cumsum(counts))]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids of the vocabulary."""
        return self.pool[ranges(self.places[ids], self.lengths[ids])]


class Splitter:
    """The matches of a pattern, with tiktoken's idea of letters, numbers and spaces."""

    _known: dict[str, Splitter] = {}

    def __init__(self, pattern: str, odd: dict[int, str]) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.odd = odd

    @classmethod
    def of(cls, pattern: str, odd: dict[int, str]) -> Splitter:
        if pattern not in cls._known:
            cls._known[pattern] = cls(pattern, odd)
        return cls._known[pattern]

    def plain(self, text: str) -> str:
        """The text with stand-ins, character by character."""
        return text if text.isascii() or self.odd.keys().isdisjoint(text) else text.translate(self.odd)

    def split(self, text: str) -> list[str]:
        plain = self.plain(text)
        if plain is text:
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]


class Prefixes:
    """A text with the table of each of its matches: what is kept of an encoding to append to it or to edit it."""

    def __init__(self, vocabulary: Vocabulary, splitter: Splitter, matches: list[str], tables: list[list[int]]) -> None:
        self.vocabulary, self.splitter, self.matches, self.tables = vocabulary, splitter, matches, tables

    @classmethod
    def encode(cls, vocabulary: Vocabulary, splitter: Splitter, text: str) -> Prefixes:
        matches = splitter.split(text)
        return cls(vocabulary, splitter, matches, [vocabulary.extend([], m.encode()) for m in matches])

    @classmethod
    def read(cls, vocabulary: Vocabulary, splitter: Splitter, text: str, stored: bytes) -> Prefixes:
        """From a text and its stored tables; an entry below 0 begins a match."""
        flat = np.frombuffer(stored, "<i4")
        data = text.encode()
        starts = np.flatnonzero(flat < 0).tolist()
        tokens = np.where(flat < 0, -1 - flat, flat).tolist()
        bounds = list(zip(starts, [*starts[1:], len(flat)], strict=False))
        return cls(vocabulary, splitter, [data[a:b].decode() for a, b in bounds], [tokens[a:b] for a, b in bounds])

    def stored(self) -> bytes:
        flat = np.array([t for table in self.tables for t in table], "<i4")
        starts = np.cumsum([0, *(len(table) for table in self.tables)])[:-1] if self.tables else np.zeros(0, np.int64)
        flat[starts] = -1 - flat[starts]
        return flat.tobytes()

    def text(self) -> str:
        return "".join(self.matches)

    def ids(self) -> list[int]:
        return [i for match, table in zip(self.matches, self.tables, strict=True) for i in self.vocabulary.match_ids(match.encode(), table)]

    def append(self, more: str) -> int:
        return self.edit(sum(map(len, self.matches)), 0, more)

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Replace ``removed`` characters at ``at``; returns how many matches were split anew."""
        text = self.text()
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        shift = len(inserted) - removed
        starts = np.cumsum([0, *map(len, self.matches)]).tolist()
        ends = starts[1:]
        # matches that ended well before the edit, and what they looked at, are the same
        first = next((k for k, end in enumerate(ends) if end > at - LOOK_AHEAD), len(ends))
        behind = {start + shift: k for k, start in enumerate(starts[:-1]) if start >= at + removed}
        new_text = text[:at] + inserted + text[at + removed :]
        matches, tables = [], []
        last = len(ends)
        for found in self.splitter.pattern.finditer(self.splitter.plain(new_text), starts[first] if ends else 0):
            if found.start() >= at + len(inserted) and found.start() in behind:
                last = behind[found.start()]
                break
            k = first + len(matches)
            matches.append(new_text[found.start() : found.end()])
            tables.append(self._table(matches[-1].encode(), k if k < len(ends) and starts[k] == found.start() else None))
        self.matches[first:last], self.tables[first:last] = matches, tables
        return len(matches)

    def _table(self, data: bytes, k: int | None) -> list[int]:
        """The table of a match that begins where the old match ``k`` did."""
        if k is None:
            return self.vocabulary.extend([], data)
        old, table = self.matches[k].encode(), self.tables[k]
        common = _common(old, data)
        tail = min(_common(old[::-1], data[::-1]), min(len(old), len(data)) - common)
        return self.vocabulary.extend(table[:common], data, table, len(data) - len(old), len(data) - tail)


def _common(a: bytes, b: bytes) -> int:
    """How many bytes two texts begin with alike."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else ()
    return int(apart[0]) if len(apart) else n


def _slices(batches: Iterable[pa.RecordBatch], lengths: Callable[[pa.RecordBatch], pa.Array], size: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``size`` each."""
    for batch in batches:
        n = pc.fill_null(lengths(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(n) - n) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _field(batch: pa.RecordBatch, at: int) -> pa.Array:
    return pc.struct_field(batch.column("row"), [at])


def _encode(batches: Iterable[pa.RecordBatch], path: str, pattern: str, odd: dict[int, str], at: int) -> Iterator[pa.RecordBatch]:
    vocabulary, splitter = Vocabulary.of(path), Splitter.of(pattern, odd)
    for batch in _slices(batches, lambda b: pc.binary_length(_field(b, at)), SLICE_BYTES):
        ids, bounds = vocabulary.encode([splitter.split(text or "") for text in _field(batch, at).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.ListArray.from_arrays(bounds.astype(np.int32), ids)], ["row", "ids"])


def _decode(batches: Iterable[pa.RecordBatch], path: str, at: int) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary.of(path)
    for batch in _slices(batches, lambda b: pc.list_value_length(_field(b, at)), SLICE_BYTES // 4):
        lists = _field(batch, at)
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        wrong = (ids < 0) | (ids >= len(vocabulary.lengths))
        wrong[~wrong] = vocabulary.lengths[ids[~wrong]] == 0
        of = np.repeat(np.arange(len(counts)), counts)
        unknown = np.bincount(of, weights=wrong, minlength=len(counts)) > 0
        unknown |= pc.is_null(lists).to_numpy(zero_copy_only=False)
        ids = np.where(wrong, vocabulary.ranks[b"\0"], ids)
        sizes = np.bincount(of, weights=vocabulary.lengths[ids], minlength=len(counts)).astype(np.int64)
        bounds = np.append(0, np.cumsum(sizes))
        whole = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(vocabulary.decode(ids).tobytes())])
        decoded = pc.if_else(pa.array(unknown), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row"), decoded], ["row", "decoded"])


def _store(batches: Iterable[pa.RecordBatch], path: str, pattern: str, odd: dict[int, str], at: int) -> Iterator[pa.RecordBatch]:
    vocabulary, splitter = Vocabulary.of(path), Splitter.of(pattern, odd)
    for batch in _slices(batches, lambda b: pc.binary_length(_field(b, at)), SLICE_BYTES // 4):
        tables = [Prefixes.encode(vocabulary, splitter, text or "").stored() for text in _field(batch, at).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tables, pa.binary())], ["row", "prefixes"])


def _edit(batches: Iterable[pa.RecordBatch], path: str, pattern: str, odd: dict[int, str], at: list[int]) -> Iterator[pa.RecordBatch]:
    vocabulary, splitter = Vocabulary.of(path), Splitter.of(pattern, odd)
    for batch in _slices(batches, lambda b: pc.binary_length(_field(b, at[0])), SLICE_BYTES // 4):
        texts, stored, ids = [], [], []
        for text, table, place, removed, inserted in zip(*(_field(batch, i).to_pylist() for i in at), strict=True):
            if table is None:
                prefixes = Prefixes.encode(vocabulary, splitter, text or "")
            else:
                prefixes = Prefixes.read(vocabulary, splitter, text or "", table)
            if place is None:
                prefixes.append(inserted or "")
            else:
                prefixes.edit(place, removed or 0, inserted or "")
            texts.append(prefixes.text())
            stored.append(prefixes.stored())
            ids.append(np.array(prefixes.ids(), np.int32))
        columns = [batch.column("row"), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(stored, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "new_text", "ids", "prefixes"])


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, path: str, pattern: str | None = None, text_column: str = "text") -> DataFrame:
    """The rows with ``ids``: the token ids of the whole text, by the ranks in ``path``."""
    run = partial(_encode, path=path, pattern=pattern or _public_pattern(), odd=stand_ins(), at=docs.columns.index(text_column))
    rows = docs.select(whole_row(docs)).mapInArrow(run, row_schema(docs, {"ids": "array<int>"}))
    return unpacked(rows, docs, {"ids": F.col("ids")})


def decode_ids(rows: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """The rows with ``decoded``: the bytes of their ids."""
    run = partial(_decode, path=path, at=rows.columns.index(ids_column))
    decoded = rows.select(whole_row(rows)).mapInArrow(run, row_schema(rows, {"decoded": "binary"}))
    return unpacked(decoded, rows, {"decoded": F.col("decoded")})


def store_prefixes(docs: DataFrame, path: str, pattern: str | None = None, text_column: str = "text") -> DataFrame:
    """The rows with ``prefixes``: the last token of every prefix of bytes, four bytes for each, to edit the text later."""
    run = partial(_store, path=path, pattern=pattern or _public_pattern(), odd=stand_ins(), at=docs.columns.index(text_column))
    rows = docs.select(whole_row(docs)).mapInArrow(run, row_schema(docs, {"prefixes": "binary"}))
    return unpacked(rows, docs, {"prefixes": F.col("prefixes")})


def edit_texts(docs: DataFrame, path: str, pattern: str | None = None, text_column: str = "text") -> DataFrame:
    """Rows of text and ``prefixes`` after the edit in their columns ``at``, ``removed`` and ``inserted``, with ``ids``.

    ``removed`` characters at character ``at`` make room for ``inserted``; a null ``at`` appends. Places outside the text
    count as its ends, a null ``prefixes`` is computed first.
    """
    names = [text_column, "prefixes", "at", "removed", "inserted"]
    run = partial(_edit, path=path, pattern=pattern or _public_pattern(), odd=stand_ins(), at=[docs.columns.index(n) for n in names])
    rows = docs.select(whole_row(docs)).mapInArrow(run, row_schema(docs, {"new_text": "string", "ids": "array<int>", "prefixes": "binary"}))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (*names, "ids")]
    return rows.select(*kept, F.col("new_text").alias(text_column), "ids", "prefixes")
