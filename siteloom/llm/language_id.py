"""Language identification with string kernels.

The kernel of two texts counts the byte n-grams of 1 to 4 letters that both have (a blended spectrum, presence only),
divided by the geometric mean of what each has. Landmark texts give the Nyström map of that kernel; on it, kernel ridge
regression is solved once for each language against the rest. The kernel is an inner product of n-gram presence vectors,
so landmarks, map and regression fold into one matrix, and a batch of texts is scored by one product with it. N-grams are
hashed into ``WIDTH`` places.

Fitting takes a bounded sample: at most ``SAMPLE`` different labelled texts, as many of each language as far as there are as
many, chosen by a hash; copies of a text count once. Every language is learnt that has a text, unless there are more
languages than ``SAMPLE``. Scoring reads every whole text.

Defined results: a text that is null or has no letter gets ``und`` and score 0; without any labelled text all get it;
ties go to the language that sorts first; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.arrays import text_bytes, text_slices
from siteloom.llm.carried import column, row_schema, unpacked, whole_row
from siteloom.sources.scratch import written

UNKNOWN = "und"
SAMPLE = 3000
LANDMARKS = 400
RIDGE = 1e-2
WIDTH = 1 << 15
LONGEST = 4
#: texts whose presence vectors are held at a time
ROWS = 128

_ODD = np.uint32(0x9E3779B1)
# letters in lower case, everything else of ASCII as a blank
_FOLD = np.full(256, 32, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def presence(column: pa.Array) -> Iterator[tuple[slice, np.ndarray]]:
    """For runs of texts: which of the hashed n-grams each has."""
    raw, bounds = text_bytes(column)
    folded = _FOLD[raw]
    for a in range(0, len(column), ROWS):
        b = min(a + ROWS, len(column))
        has = np.zeros((b - a) * WIDTH, bool)
        part = folded[bounds[a] : bounds[b]]
        at = np.repeat(np.arange(b - a, dtype=np.int64) * WIDTH, np.diff(bounds[a : b + 1]))
        gram = np.zeros(len(part), np.uint32)
        for n in range(1, LONGEST + 1):
            gram = part.copy() if n == 1 else (gram[:-1] << np.uint32(8)) | part[n - 1 :]
            if not len(gram):
                break
            place = ((gram + np.uint32(n)) * _ODD) >> np.uint32(32 - WIDTH.bit_length() + 1)
            inside = at[: len(gram)] == at[n - 1 :]
            has[at[: len(gram)][inside] + place[inside]] = True
        yield slice(a, b), has.reshape(b - a, WIDTH)


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter; texts with a letter of ASCII are settled on the bytes."""
    raw, bounds = text_bytes(column)
    plain = np.append(0, np.cumsum((_FOLD[raw] != 32) & (raw < 0x80)))
    found = plain[bounds[1:]] > plain[bounds[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: n-gram places by languages
    matrix: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """For each text and language the regression's value, about 1 for its own and -1 for others."""
        out = np.zeros((len(column), len(self.languages)))
        for rows, has in presence(column):
            norm = np.sqrt(np.maximum(has.sum(axis=1), 1))
            out[rows] = (has.astype(np.float32) @ self.matrix) / norm[:, None]
        return out


def _pack_presence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The presence vectors of different texts; a task sends the copies that it meets as one."""
    met: set[tuple[str, int]] = set()  # drawn texts, so as many as the sample holds at most
    for batch in text_slices(batches):
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("draw").to_pylist(), strict=True))
        first = {key: i for i, key in reversed(list(enumerate(keys))) if key not in met}
        met.update(first)
        batch = batch.take(pa.array(sorted(first.values()), pa.int64()))
        for rows, has in presence(batch.column("text")):
            bits = [row.tobytes() for row in np.packbits(has, axis=1)]
            own = batch.slice(rows.start, rows.stop - rows.start)
            yield pa.RecordBatch.from_arrays([own.column(c) for c in ("lang", "draw", "turn")] + [pa.array(bits, pa.binary())], ["lang", "draw", "turn", "bits"])


def fit_languages(
    docs: DataFrame, usable: Column, text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS
) -> LanguageModel:
    """Fit on at most ``sample`` different texts of the ``usable`` rows that have a text and a language."""
    rows = docs.where(usable).select(column(text_column).alias("text"), column(lang_column).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").withColumn("draw", F.xxhash64(F.lit(3), "text"))
    # copies are one draw; every language's first draw comes before any second one
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    drawn = rows.select("lang", "draw").distinct().withColumn("turn", turn).where(F.col("turn") <= sample)
    drawn = written(drawn.orderBy("turn", "draw", "lang").limit(sample), "drawn")
    # at most ``sample`` rows of two numbers and a name
    known = F.broadcast(drawn.select(F.col("lang").alias("of"), F.col("draw").alias("drawn"), "turn"))
    texts = rows.join(known, (F.col("lang") == F.col("of")) & (F.col("draw") == F.col("drawn"))).select("text", "lang", "draw", "turn")
    packed = texts.mapInArrow(_pack_presence, "lang string, draw long, turn int, bits binary")
    seen = packed.groupBy("turn", "draw", "lang").agg(F.first("bits").alias("bits")).orderBy("turn", "draw", "lang").collect()
    if not seen:
        return LanguageModel([], np.zeros((WIDTH, 0), np.float32))
    languages = sorted({r["lang"] for r in seen})
    y = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in languages] for r in seen])
    bits = [r["bits"] for r in seen]
    own = _normed(bits[:landmarks])
    values, vectors = np.linalg.eigh((own @ own.T).astype(np.float64))
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    kernels = [_normed(bits[a : a + ROWS]) @ own.T for a in range(0, len(bits), ROWS)]
    mapped = np.concatenate(kernels).astype(np.float64) @ root
    weights = np.linalg.solve(mapped.T @ mapped + RIDGE * len(seen) / 100 * np.eye(mapped.shape[1]), mapped.T @ y)
    return LanguageModel(languages, own.T @ (root @ weights).astype(np.float32))


def _normed(bits: list[bytes]) -> np.ndarray:
    """Presence vectors of length 1."""
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in bits]), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    return x


def _predict(batches: Iterable[pa.RecordBatch], model: LanguageModel) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, UNKNOWN], object)
    for batch in text_slices(batches):
        column = batch.column("text")
        known = has_letter(column) if model.languages else np.zeros(len(batch), bool)
        best, score = np.full(len(batch), len(model.languages)), np.zeros(len(batch))
        if known.any():
            values = model.scores(column)
            best[known] = values.argmax(axis=1)[known]
            score[known] = np.clip((values.max(axis=1)[known] + 1) / 2, 0, 1)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names[best], pa.string()), pa.array(score)], ["row", "lang_pred", "score"])


def predict_languages(
    docs: DataFrame, model: LanguageModel, text_column: str = "text", lang_name: str = "lang_pred", score_name: str = "score"
) -> DataFrame:
    """The rows with the language and its score (0 to 1)."""
    rows = docs.select(whole_row(docs), column(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH rows, one number for each language

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _predict(batches, shared.value)

    found = rows.mapInArrow(predict, row_schema(docs, {"lang_pred": "string", "score": "double"}))
    return unpacked(found, docs, {lang_name: F.col("lang_pred"), score_name: F.col("score")})
