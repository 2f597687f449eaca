"""Toxicity: a linear classifier that is regularised by counterfactuals.

Texts are sets of lower-case words, hashed. In labelled texts that mention a group, each identity term is swapped for
another of its kind, and the loss holds the squared change of the score: a mention by itself can't push the score. The
classifier is a logistic regression over the words whose share among toxic texts differs from that among others by more
than chance (``SCREEN`` standard deviations), and over the identity terms; few words carry it, so long texts are not
found toxic for their length.

Fitting takes a bounded sample of about ``SAMPLE`` labelled rows, chosen by a hash of the text. Scoring reads every whole
text; labels, language, source and id are no inputs of it.

Defined results: null and empty texts get the score of a text without known words; a text labelled more than once is
toxic if any label says so, rows without a label of 0 or 1 are not learnt from; without labels of both kinds the score is
the share of toxic ones (0 without labels); repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.arrays import byte_hashes, find_words, text_bytes, text_slices
from siteloom.llm.carried import column, row_schema, unpacked, whole_row

SAMPLE = 20_000
PLACES = 1 << 20
SCREEN = 5.0
MOST_WORDS = 1000
LEAST_TEXTS = 4
RIDGE = 1.0
SWAP_PENALTY = 10.0
STEPS = 30

#: terms that may be swapped for each other (fixed words)
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
)

# letters of ASCII and all bytes of other characters
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(byte_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> dict[int, int]:
    """For the hash of each identity term, that of the next one of its kind."""
    return {_hash(t): _hash(g[(i + 1) % len(g)]) for g in groups for i, t in enumerate(g)}


def word_places(column: pa.Array, swap: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words as (text, place), every pair once; and the texts in which ``swap`` changed a word."""
    words = find_words(*text_bytes(column), within=_LETTERS, lower=True)
    hashes, texts = words.hashes, words.texts
    changed = np.zeros(0, np.int64)
    if swap:
        old = np.array(sorted(swap), np.uint64)
        at = np.minimum(np.searchsorted(old, hashes), len(old) - 1)
        found = old[at] == hashes
        hashes = np.where(found, np.array([swap[int(k)] for k in old], np.uint64)[at], hashes)
        changed = np.unique(texts[found])
    pairs = np.unique(texts * PLACES + (hashes % np.uint64(PLACES)).astype(np.int64))
    return pairs // PLACES, pairs % PLACES, changed


@dataclass(frozen=True)
class ToxicityModel:
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        words = find_words(*text_bytes(column), within=_LETTERS, lower=True)
        table = np.zeros(PLACES, np.float64)
        table[self.places] = self.weights
        place = (words.hashes % np.uint64(PLACES)).astype(np.int64)
        some = np.flatnonzero(table[place])
        pairs = np.unique(words.texts[some] * PLACES + place[some])
        total = np.bincount(pairs // PLACES, weights=table[pairs % PLACES], minlength=len(column))
        return 1 / (1 + np.exp(-(self.bias + total)))


def _features(batches: Iterable[pa.RecordBatch], swap: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        n = len(batch)
        texts, places, _ = word_places(batch.column("text"))
        swapped, swapped_places, changed = word_places(batch.column("text"), swap)
        first = np.searchsorted(texts, np.arange(n + 1))
        first_swapped = np.searchsorted(swapped, np.arange(n + 1))
        has = np.isin(np.arange(n), changed)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("toxic"),
                pa.array([places[first[i] : first[i + 1]].astype(np.int32).tobytes() for i in range(n)], pa.binary()),
                pa.array(
                    [swapped_places[first_swapped[i] : first_swapped[i + 1]].astype(np.int32).tobytes() if has[i] else None for i in range(n)],
                    pa.binary(),
                ),
            ],
            ["key", "toxic", "places", "swapped"],
        )


def fit_toxicity(
    labelled: DataFrame, text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS
) -> ToxicityModel:
    """Fit on at most ``sample`` labelled texts, drawn by a hash of the text; equal texts with one label count once.

    The MOST_WORDS words that go most strongly with a label are kept, of those in LEAST_TEXTS sampled texts or more.
    """
    rows = labelled.select(F.col(text_column).alias("text"), F.col(label_column).cast("int").alias("toxic")).where("toxic in (0, 1)")
    share = min(1.0, sample / max(rows.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1_000_000))
    rows = rows.where(draw < int(share * 1_000_000) + 1).select("text", "toxic", F.xxhash64("text").alias("key"))
    swap = swaps(groups)
    found = rows.mapInArrow(lambda batches: _features(batches, swap), "key long, toxic int, places binary, swapped binary")
    # copies of a drawn text become one before they are dealt out
    seen = found.distinct().orderBy(F.xxhash64(F.lit(5), "key"), "key", "toxic").limit(sample).collect()
    y = np.array([r["toxic"] for r in seen], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        return ToxicityModel(float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
    terms = np.unique(np.array([k % PLACES for k in swap], np.int64))
    own = [np.frombuffer(r["places"], np.int32) for r in seen]
    n_all = np.bincount(np.concatenate(own), minlength=PLACES)
    n_toxic = np.bincount(np.concatenate([p for p, r in zip(own, seen, strict=True) if r["toxic"]]), minlength=PLACES)
    rate = y.mean()
    deviation = (n_toxic - rate * n_all) / np.sqrt(np.maximum(n_all * rate * (1 - rate), 1e-9))
    strong = np.flatnonzero((np.abs(deviation) > SCREEN) & (n_all >= LEAST_TEXTS))
    strong = strong[np.argsort(-np.abs(deviation[strong]), kind="stable")][:MOST_WORDS]
    places = np.union1d(strong, terms[n_all[terms] > 0])
    x = _matrix(own, places)
    pairs = [(p, np.frombuffer(r["swapped"], np.int32)) for p, r in zip(own, seen, strict=True) if r["swapped"] is not None]
    change = _matrix([p for p, _ in pairs], places) - _matrix([q for _, q in pairs], places)
    return _solve(x, y, change, places)


def _matrix(rows: list[np.ndarray], places: np.ndarray) -> np.ndarray:
    """Which of the places each row has."""
    column = np.full(PLACES, -1)
    column[places] = np.arange(len(places))
    out = np.zeros((len(rows), len(places)), np.float32)
    for i, row in enumerate(rows):
        at = column[row]
        out[i, at[at >= 0]] = 1
    return out


def _solve(x: np.ndarray, y: np.ndarray, change: np.ndarray, places: np.ndarray) -> ToxicityModel:
    """Newton steps on log loss + ridge + the mean squared change of the score under swaps."""
    n = x.shape[1]
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    bound = np.diag(np.append(np.full(n, RIDGE), 0.0))
    if len(change):
        bound[:n, :n] += SWAP_PENALTY * (change.T @ change).astype(np.float64)
    w = np.zeros(n + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + bound @ w
        curve = (x * (p * (1 - p) + 1e-6)[:, None].astype(np.float32)).T @ x
        step = np.linalg.solve(curve + bound + 1e-6 * np.eye(n + 1), gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return ToxicityModel(float(w[-1]), places, w[:n])


def _score(batches: Iterable[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.scores(batch.column("text")))], ["row", "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_column: str = "text") -> DataFrame:
    """The rows with a score from 0 to 1."""
    rows = docs.select(whole_row(docs), column(text_column).alias("text"))
    found = rows.mapInArrow(lambda batches: _score(batches, model), row_schema(docs, {"score": "double"}))
    return unpacked(found, docs, {"score": F.col("score")})


def labelled_texts(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """The usable documents that have a label: text and toxic."""
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.where(usable).select("doc_id", "text").join(known, "doc_id").select("text", "toxic")
