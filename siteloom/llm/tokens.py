"""Whole documents to token ids of a byte-level tokenizer, with each distinct chunk of text encoded once.

The tokenizer splits text before it merges bytes, and never merges over that split. A single space or line feed between
two plain characters always begins a new part, and so does a mark behind a letter; a text may be cut there: the ids of
the chunks, one after the other, are the ids of the text (``tests/llm`` compares them). Chunks repeat a lot, so a worker
keeps the ids of those it has seen, and the tokenizer runs on new ones only. A token that was added to the vocabulary
(``<|endoftext|>``) is taken out of a text before anything else, and is a chunk of its own.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from siteloom.llm.arrays import SLICE_BYTES, byte_hashes, ranges, text_bytes, text_slices

__all__ = ["ChunkEncoder", "text_slices", "SLICE_BYTES"]

#: chunks whose ids a worker keeps; the table starts anew beyond it
KEPT = 1 << 21
#: bytes that one call of the tokenizer gets
CALL = 1 << 16

# plain characters: visible ASCII, and letters with the lead byte C3
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _VISIBLE & ~_LETTER
_MARK[[0x27, *range(0x30, 0x3A)]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True


class ChunkEncoder:
    """A tokenizer with the ids of the chunks it has seen."""

    _known: dict[str, ChunkEncoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take their neighbours into account")
        #: finds added tokens, the longer one first
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(added.values(), key=lambda t: -len(t.content)))) if added else None
        #: bytes of each id: the vocabulary writes one character for a byte
        self.widths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(added[i].content.encode()) if i in added else len(token)
        self._forget()

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        """One for each worker process."""
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more entry than texts)."""
        raw, bounds = text_bytes(column)
        starts, ends = chunks(raw, bounds, self.added)
        hashes = byte_hashes(raw, starts, ends)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT:
            self._forget()
        at = np.searchsorted(self.keys, keys)
        seen = at < len(self.keys)
        seen[seen] = self.keys[at[seen]] == keys[seen]
        if not seen.all():
            self._learn(raw, keys[~seen], starts[first[~seen]], ends[first[~seen]])
            at = np.searchsorted(self.keys, keys)
        n = self.lengths[at][which]
        ids = self.pool[ranges(self.where[at][which], n)]
        sums = np.append(0, np.cumsum(n))
        return ids, sums[np.searchsorted(starts, bounds)]

    def _learn(self, raw: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new chunks: in long runs where each begins a new part behind the one before, else one by one."""
        plain = _VISIBLE[raw] | np.append(False, raw[:-1] == 0xC3)
        joins = (raw[starts] == 0x20) & (ends - starts > 1) & plain[ends - 1]
        joins &= _VISIBLE[raw[np.minimum(starts + 1, len(raw) - 1)]] | (raw[np.minimum(starts + 1, len(raw) - 1)] == 0xC3)
        order = np.argsort(~joins, kind="stable")
        keys, starts, ends, n_joined = keys[order], starts[order], ends[order], int(joins.sum())
        text = raw.tobytes()
        new = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        ids, lengths = self._encode_joined(new[:n_joined], (ends - starts)[:n_joined])
        singles = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in new[n_joined:]], add_special_tokens=False)]
        lengths = np.concatenate([lengths, np.array([len(x) for x in singles], np.int64)])
        where = len(self.pool) + np.cumsum(lengths) - lengths
        self.pool = np.concatenate([self.pool, ids, np.array([i for x in singles for i in x], np.uint32)])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.where, self.lengths = (
            np.insert(old, at, add[order]) for old, add in ((self.keys, keys), (self.where, where), (self.lengths, lengths))
        )

    def _encode_joined(self, new: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part in np.array_split(np.arange(len(new)), sizes.sum() // CALL + 1) if new else ():
            text = b"".join(new[i] for i in part).decode()
            own = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.widths[own])
            marks = np.cumsum(sizes[part])
            last = np.searchsorted(ends, marks)
            if not np.array_equal(ends[last], marks):
                raise ValueError("the tokenizer merges over the beginning of a word")
            ids.append(own)
            lengths.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(lengths)


def chunks(raw: np.ndarray, bounds: np.ndarray, added: re.Pattern[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of some texts begin and end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = _VISIBLE[raw]
    letter = np.zeros(n, bool)
    letter[1:] = raw[:-1] == 0xC3
    after_plain = np.zeros(n, bool)
    after_plain[1:] = plain[:-1] | letter[:-1]
    before_plain = np.zeros(n, bool)
    before_plain[:-1] = plain[1:] | (raw[1:] == 0xC3)
    cuts = _BREAK[raw] & after_plain & before_plain
    # the character behind such a line feed
    cuts[1:] |= cuts[:-1] & (raw[:-1] == 0x0A)
    # a mark behind a letter, but for the apostrophe, which may begin a part with the letters behind it
    cuts[1:] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
    ends = np.unique(bounds)
    for a, b in _spans(raw, ends, added) if added else ():
        cuts[a + 1 : b] = False
        cuts[a] = True
        cuts[b : b + 1] = True
    cuts[ends[ends < n]] = True
    starts = np.flatnonzero(cuts)
    return starts, np.append(starts[1:], n)


def _spans(raw: np.ndarray, ends: np.ndarray, added: re.Pattern[bytes]) -> list[tuple[int, int]]:
    """Where added tokens stand, each within one text."""
    data, out, at = raw.tobytes(), [], 0
    while found := added.search(data, at):
        a, b = found.span()
        inside = np.searchsorted(ends, a, "right") == np.searchsorted(ends, b, "left")
        if inside:
            out.append((a, b))
        at = b if inside else a + 1
    return out
