"""Runs of repeated words, found in a grammar of the text: Re-Pair, one search for each rule's boundary, merged intervals.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``LEAST`` and ``TIMES * q`` that no neighbouring word extends keeping period q.

Re-Pair. Pairs of neighbouring symbols that come twice or more are replaced by new symbols, the most frequent first. All
pairs that none of their neighbours outdoes (by magnitude of their number, ties by a hash) go in one round, for all texts of
a slice at once. What is left of a text is paired up level by level, so that everything hangs under one symbol.

One search for each rule. A run lies within some symbol and over the boundary between that symbol's two parts, and equal
symbols have equal runs there: they are looked for once, in the first place where the symbol stands. The words on one side
of the boundary equal those q further on, so only such q are tried whose eight words there are equal; how far equality goes
on both sides is found by halving over hashes of stretches.

Translation. A run over a boundary stands in every place that the symbol was made in. It may go on beyond the symbol; the
whole of it is then found in a larger one. So of the intervals of one period only those that no other holds stay, and of
equal intervals the one of the smallest period.

Before that, a text is cut where no run can be: every nine words within a run come twice or more in their text, because
TIMES >= 3 and LEAST >= 24, and so a stretch in which they don't needs no grammar.

Defined results: null and empty texts have no words and no runs; repeated rows are texts of their own; an empty table gives
none; added columns take the place of ones with their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import Sequences, Words, find_words, mix, ranges, run_starts, text_bytes
from siteloom.llm.carried import column, row_schema, unpacked, whole_row

LEAST = 24
TIMES = 3
#: words on one side of a boundary that must be equal: a run's equal words are at least 16, so 8 of them are on one side
SIDE = 8
#: words that come twice wherever a run is
TWICE = 9
#: bytes of text whose words are looked at together
SLICE_BYTES = 1 << 20
#: comparisons of one step
STEP = 1 << 18

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Stretches:
    """Hashes of stretches of words modulo two primes, for comparing any two of them."""

    PRIMES = (2147483647, 2147483629)

    def __init__(self, words: np.ndarray) -> None:
        self.sums, self.powers = [], []
        for prime, base in zip(self.PRIMES, (1000003, 998244353), strict=True):
            p = np.uint64(prime)
            powers = np.ones(len(words) + 1, np.uint64)
            done, step = 1, np.uint64(base)
            # powers of the base by doubling
            while done < len(powers):
                more = min(done, len(powers) - done)
                powers[done : done + more] = powers[:more] * step % p
                step = step * step % p
                done += more
            values = mix(words) % p
            sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(values * powers[:-1] % p, out=sums[1:])
            self.sums.append(sums)
            self.powers.append(powers)

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words at a equal the n words at b, a <= b."""
        out = np.ones(len(a), bool)
        for prime, sums, powers in zip(self.PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            one, other = (sums[a + n] - sums[a]) % p, (sums[b + n] - sums[b]) % p
            out &= one * powers[b - a] % p == other
        return out

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, at most so many."""
        return self._halving(most, lambda n: self.equal(a, b, n))

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b, at most so many."""
        return self._halving(most, lambda n: self.equal(a - n, b - n, n))

    @staticmethod
    def _halving(most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            right = equal(middle)
            low, high = np.where(right, middle, low), np.where(right, high, middle - 1)
        return low


@dataclass
class Symbols:
    """The symbols that stand in a row at some time, each a stretch of words."""

    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray

    def kept(self, which: np.ndarray) -> Symbols:
        return Symbols(self.name[which], self.start[which], self.size[which], self.text[which])


def _numbered(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _chosen_pairs(symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs that this round replaces begin, and which pair each is."""
    name, n = symbols.name, len(symbols.name)
    together = symbols.text[1:] == symbols.text[:-1]
    at = np.flatnonzero(together)
    if not len(at):
        return at, at
    left, right = name[at], name[at + 1]
    # of equal neighbours, every second pair counted from where they begin
    twin = left == right
    if twin.any():
        begins = np.ones(n, bool)
        begins[1:] = (name[1:] != name[:-1]) | ~together
        since = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        kept = ~twin | (since[at] % 2 == 0)
        at, left, right = at[kept], left[kept], right[kept]
    pair, which, count = np.unique(left * (int(name.max()) + 1) + right, return_inverse=True, return_counts=True)
    often = count > 1
    if not often.any():
        return at[:0], at[:0]
    a, b = np.divmod(pair, int(name.max()) + 1)
    rank = np.zeros(len(pair), np.uint64)
    magnitude = np.frexp(count.astype(np.float64))[1].astype(np.uint64)
    # a pair's number in its last bits: no two are equal
    bits = np.uint64(max(int(len(pair) - 1).bit_length(), 1))
    order = mix(pair.astype(np.uint64)) >> np.uint64(8) >> bits << bits | np.arange(len(pair), dtype=np.uint64)
    rank[often] = (magnitude[often] << np.uint64(56)) | order[often]
    best = np.zeros(int(name.max()) + 1, np.uint64)
    np.maximum.at(best, a, rank)
    np.maximum.at(best, b, rank)
    chosen = often & (rank == best[a]) & (rank == best[b])
    taken = chosen[which]
    return at[taken], which[taken]


def _replaced(symbols: Symbols, at: np.ndarray, names: np.ndarray) -> Symbols:
    """The row with each pair that begins at ``at`` as one symbol."""
    name, size = symbols.name.copy(), symbols.size.copy()
    name[at], size[at] = names, size[at] + size[at + 1]
    stays = np.ones(len(name), bool)
    stays[at + 1] = False
    return Symbols(name, symbols.start, size, symbols.text).kept(stays)


def _search(words: np.ndarray, side: np.ndarray, stretches: Stretches, start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs over the boundary of each symbol, inside it: which symbol, first word, end, period."""
    found: list[tuple[np.ndarray, ...]] = []
    longest = (stop - start) // TIMES
    room = np.cumsum(2 * longest)
    cuts = [0, *(np.flatnonzero(np.diff(room // STEP)) + 1).tolist(), len(start)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b == a:
            continue
        of = np.repeat(np.arange(a, b), longest[a:b])
        period = ranges(np.ones(b - a, np.int64), longest[a:b])
        m, low, high = middle[of], start[of], stop[of]
        hits = []
        # the words that follow the boundary, or those before it, equal the ones a period on
        for x, y in ((m, m + period), (m - SIDE, m - SIDE + period), (m - period, m), (m - period - SIDE, m - SIDE)):
            inside = np.flatnonzero((x >= low) & (y + SIDE <= high))
            hits.append(inside[side[x[inside]] == side[y[inside]]])
        # equal words may be around the boundary itself, or around the place one period before it
        for shift, hit in ((0, np.union1d(hits[0], hits[1])), (1, np.union1d(hits[2], hits[3]))):
            q, s = period[hit], of[hit]
            p = middle[s] - shift * q
            hit_in = (p >= start[s]) & (p + q <= stop[s])
            q, s, p = q[hit_in], s[hit_in], p[hit_in]
            first = p - stretches.backward(p, p + q, p - start[s])
            end = p + q + stretches.forward(p, p + q, stop[s] - p - q)
            long = (end - first >= LEAST) & (end - first >= TIMES * q)
            found.append((s[long], first[long], end[long], q[long]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    s, first, end, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, end, first, s))
    s, first, end, q = s[order], first[order], end[order], q[order]
    # of equal intervals the smallest period
    least = run_starts(s, first, end)
    return s[least], first[least], end[least], q[least]


def _grammar_runs(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in a row of words, none over the boundary of two texts: first word, end, period."""
    n = len(words)
    if n < LEAST:
        return (np.zeros(0, np.int64),) * 3
    number = _numbered(words)
    side = np.zeros(n, np.uint64)
    at = np.arange(n - SIDE + 1)
    side[at] = Sequences(mix(words)).hashes(at, at + SIDE)
    stretches = Stretches(words)
    # symbols of different texts have different names
    symbols = Symbols(_numbered(number + text * (int(number.max()) + 1)), np.arange(n), np.ones(n, np.int64), text)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def make(at: np.ndarray, which: np.ndarray) -> None:
        """Replace pairs, look at each once, and put its runs in all places where it was made."""
        nonlocal symbols
        rule, first, names = np.unique(which, return_index=True, return_inverse=True)
        places = symbols.start[at]
        start, middle = places[first], symbols.start[at[first] + 1]
        stop = middle + symbols.size[at[first] + 1]
        large = np.flatnonzero(stop - start >= LEAST)
        s, begin, end, period = _search(words, side, stretches, start[large], middle[large], stop[large])
        if len(s):
            s = large[s]
            by_rule = np.argsort(names, kind="stable")
            counts = np.bincount(names, minlength=len(rule))
            offsets = np.cumsum(counts) - counts
            every = places[by_rule[ranges(offsets[s], counts[s])]]
            moved = np.repeat(np.arange(len(s)), counts[s])
            shift = every - start[s][moved]
            found.append((begin[moved] + shift, end[moved] + shift, period[moved]))
        symbols = _replaced(symbols, at, int(symbols.name.max()) + 1 + names)
        symbols.name = _numbered(symbols.name)

    while True:
        at, which = _chosen_pairs(symbols)
        if not len(at):
            break
        make(at, which)
    # what is left, level by level
    while True:
        first = run_starts(symbols.text)
        place = np.arange(len(symbols.text)) - np.repeat(first, np.diff(np.append(first, len(symbols.text))))
        together = np.append(symbols.text[1:] == symbols.text[:-1], False)
        at = np.flatnonzero(together & (place % 2 == 0))
        if not len(at):
            break
        make(at, np.arange(len(at)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    begin, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return _maximal(begin, end, period)


def _maximal(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a period that no other of it holds; of equal ones the smallest period."""
    order = np.lexsort((-end, begin, period))
    begin, end, period = begin[order], end[order], period[order]
    number = np.cumsum(np.isin(np.arange(len(period)), run_starts(period))) - 1
    reach = end + number * (int(end.max()) + 1)
    furthest = np.maximum.accumulate(reach)
    stays = np.ones(len(begin), bool)
    stays[1:] = reach[1:] > furthest[:-1]
    begin, end, period = begin[stays], end[stays], period[stays]
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    least = run_starts(begin, end)
    return begin[least], end[least], period[least]


def find_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of some texts, given by the hashes of their words: text, first word (in the text), length, period, in order."""
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    here = ranges(first, np.maximum(counts - TWICE + 1, 0))
    if not len(here):
        return (np.zeros(0, np.int64),) * 4
    grams = Sequences(words).hashes(here, here + TWICE)
    # a collision only leaves more words in
    grams = mix(grams) ^ mix(text[here].astype(np.uint64))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(here), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    depth = np.zeros(len(words) + 1, np.int64)
    begins = here[twice]
    np.add.at(depth, begins, 1)
    np.subtract.at(depth, begins + TWICE, 1)
    covered = np.cumsum(depth[:-1]) > 0
    # stretches of such words, each of one text
    where = np.flatnonzero(covered)
    if not len(where):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(where) > 1) | (text[where[1:]] != text[where[:-1]])
    stretch = np.cumsum(new) - 1
    long = np.bincount(stretch)[stretch] >= LEAST
    where, stretch = where[long], stretch[long]
    begin, end, period = _grammar_runs(words[where], _numbered(stretch) if len(stretch) else stretch)
    # equal words are only told by hashes so far
    wrong = [k for k in range(len(begin)) if not np.array_equal(words[where[begin[k] : end[k] - period[k]]], words[where[begin[k] + period[k] : end[k]]])]
    if wrong:
        raise ValueError("two stretches of words have one hash")
    start = where[begin]
    of = text[start]
    order = np.lexsort((period, start, of))
    return of[order], (start - first[of])[order], (end - begin)[order], period[order]


def collapsed(words: Words, of: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that no run repeats, joined by one space: bytes, and where each text begins (one more entry than texts)."""
    total, texts = len(words.starts), len(words.first) - 1
    a = words.first[of] + start
    depth = np.bincount(a + period, minlength=total + 1) - np.bincount(a + length, minlength=total + 1)
    kept = np.cumsum(depth)[:total] == 0
    text = words.texts[kept]
    begin, size = words.starts[kept], (words.ends - words.starts)[kept]
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    room = size + (~last).astype(np.int64)
    at = np.cumsum(room) - room
    out = np.full(room.sum(), 32, np.uint8)
    out[ranges(at, size)] = words.raw[ranges(begin, size)]
    return out, np.append(0, np.cumsum(np.bincount(text, weights=room, minlength=texts).astype(np.int64)))


def _run_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b == a:
                continue
            words = find_words(*text_bytes(texts.slice(a, b - a)))
            of, start, length, period = find_runs(words.hashes, words.counts)
            runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
            bounds = np.append(0, np.cumsum(np.bincount(of, minlength=b - a))).astype(np.int32)
            raw, ends = collapsed(words, of, start, length, period)
            joined = pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds), runs), joined.cast(pa.string())],
                ["row", "runs", "collapsed_text"],
            )


def periodic_runs(docs: DataFrame, text_column: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The rows (all columns, or the named ones) with ``runs`` and ``collapsed_text``.

    ``runs`` holds start, length and period, by start, then period. ``collapsed_text`` joins by one space the words that no
    run contains after its first ``period`` words.
    """
    kept = docs.select(*[column(c) for c in (docs.columns if columns is None else columns)])
    sent = docs.select(whole_row(kept), column(text_column).alias("_text"))
    rows = sent.mapInArrow(_run_rows, row_schema(kept, {"runs": RUNS, "collapsed_text": "string"}))
    return unpacked(rows, kept, {"runs": F.col("runs"), "collapsed_text": F.col("collapsed_text")})


def strongest_run(runs: Column) -> Column:
    """The run with the greatest length / period, then the smallest start and period; null if there is none."""

    def beats(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        earlier = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return (more > less) | ((more == less) & earlier)

    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, run: F.when(beats(run, best), run).otherwise(best)
    )


def run_lines(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
