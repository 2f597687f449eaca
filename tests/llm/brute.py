"""The operators' results the plain way, over lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def components(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingle_components(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    sets = []
    for _, text in rows:
        w = words(lower(text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                links.append((i, j))
    root = components(len(rows), links)
    least = defaultdict(lambda: math.inf)
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] = min(least[r], i)
    return sorted((i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, root, strict=True))


def exact_groups(rows: list[tuple[int, str | None]]) -> list[tuple]:
    def bare(text: str | None) -> str:
        return re.sub(r"[\x20\x09-\x0D]", "", text or "")

    groups = defaultdict(list)
    for i, text in rows:
        groups[bare(text)].append((-len(text or ""), i))
    out, taken = [], set()
    for i, text in sorted(rows, key=lambda r: (-len(r[1] or ""), r[0])):
        own = groups[bare(text)]
        best = min(own)
        kept = (-len(text or ""), i) == best and (bare(text)) not in taken
        if kept:
            taken.add(bare(text))
        out.append((i, best[1], len(own), kept, hashlib.sha256(bare(text).encode()).hexdigest()))
    return sorted(out)


def substring_dedup(rows: list[tuple[int, str | None]], window: int = 35) -> list[tuple]:
    lists = [words(t) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, lists, strict=True):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if count[tuple(w[s : s + window])] > 1:
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def targets(sizes: dict[str | None, int], share: Fraction = Fraction(3, 2), most: int = 2) -> dict[str | None, float]:
    """Share by weight, cut at twice the size, and share what is over again, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            return {s: float(v) for s, v in (out | {s: left * weight[s] / total for s in free}).items()}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        free -= over
    return {s: float(v) for s, v in out.items()}


def best_fit(lengths: list[int], capacity: int) -> int:
    """How many bins best-fit decreasing opens."""
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, i) for i, room in enumerate(bins) if room >= n]
        if fits:
            _, i = min(fits)
            bins[i] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def base_scores(rows: list[tuple[int, str | None]], training: list[str | None]) -> list[tuple]:
    def tokens(text: str | None) -> list[str | None]:
        return [*words(lower(text or "")), None]

    count = Counter(t for text in training for t in tokens(text))
    n, v = sum(count.values()), len(count)
    return sorted(
        (i, len(tokens(t)), sum(w in count for w in tokens(t)), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)))
        for i, t in rows
    )


def embedding_links(rows: list[tuple[int, list | None]], least: float = 0.9) -> list[tuple]:
    def unit(v: list | None) -> np.ndarray | None:
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    links = [(i, j) for i, a in enumerate(units) for j, b in enumerate(units[:i]) if a is not None and b is not None and len(a) == len(b) and a @ b >= least]
    root = components(len(rows), links)
    n, smallest = Counter(x for pair in links for x in pair), defaultdict(lambda: math.inf)
    for r, (i, _) in zip(root, rows, strict=True):
        smallest[r] = min(smallest[r], i)
    return sorted((i, n[k], smallest[r], i == smallest[r]) for k, ((i, _), r) in enumerate(zip(rows, root, strict=True)))
