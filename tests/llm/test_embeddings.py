"""Embedding links against brute force."""

from __future__ import annotations

import brute
import numpy as np
import pyarrow as pa
import pytest

from siteloom.llm import embedding_dedup
from siteloom.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, node long, bucket string"


def found(rows):
    return sorted(tuple(r) for r in rows.select("vec_id", "n_links", "component_id", "kept").collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def test_given_table(ready):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in ready.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(QUERIES["op10_embedding_dedup"](ready, folder)) == brute.embedding_links(rows)


def test_odd_vectors(ready):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.1], [-1.0, 0.0], [1.0], [1.0, 0.0, 0.0]]
    vectors += [[1e-30, 0.0], [3e38, 3e38], [0.0, 1.0], [0.0, 1.0], [0.5, 0.5], [0.0, -0.0]]
    rows = list(enumerate(vectors)) + [(14, [0.0, 1.0]), (0, None)]
    assert found(embedding_dedup.link_embeddings(table(ready, rows))) == brute.embedding_links(rows)
    assert found(embedding_dedup.link_embeddings(table(ready, rows).limit(0))) == []


def test_large_group_in_blocks(ready, monkeypatch):
    """A group of near copies over several blocks, with exact copies among them."""
    draw = np.random.default_rng(2)
    centre = draw.normal(size=16)
    rows = [(i, (centre + 0.12 * draw.normal(size=16)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)] + [(300 + i, draw.normal(size=16).astype(np.float32).tolist()) for i in range(50)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    assert found(embedding_dedup.link_embeddings(table(ready, rows))) == brute.embedding_links(rows)


def test_recall_at_the_bound(ready):
    """Pairs with a cosine just above the bound, among many others: at least nine in ten are found, and nothing false."""
    draw = np.random.default_rng(4)
    n, d = 3000, 64
    x = draw.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = draw.normal(size=(300, d))
    y -= (y * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = draw.uniform(0.9, 0.93, (300, 1))
    pairs = cosine * x[:300] + np.sqrt(1 - cosine**2) * y
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, pairs]).astype(np.float32))]
    wanted, links = brute.embedding_links(rows), found(embedding_dedup.link_embeddings(table(ready, rows)))
    assert sum(r[1] for r in links) >= 0.9 * sum(r[1] for r in wanted)
    assert all(a[1] <= b[1] for a, b in zip(links, wanted, strict=True))


@pytest.mark.parametrize("hashes", [3, 4, 5])
def test_recall_of_large_tables(ready, hashes):
    """As many hashes as large tables get: of pairs with a cosine of 0.9 to 0.902, 98 in a hundred are found at least."""
    draw = np.random.default_rng(hashes)
    n, d = 1000, 64
    x, y = draw.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cosine = draw.uniform(0.9001, 0.902, (n, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, cosine * x + np.sqrt(1 - cosine**2) * y]).astype(np.float32))]
    wanted, links = brute.embedding_links(rows), found(embedding_dedup.link_embeddings(table(ready, rows), hashes=hashes))
    assert sum(r[1] for r in wanted) == 2 * n
    print(hashes, sum(r[1] for r in links) / sum(r[1] for r in wanted))
    assert sum(r[1] for r in links) >= 0.98 * sum(r[1] for r in wanted)


def test_tables_follow_hashes_and_length():
    """At every number of vectors pairs at the bound meet alike, in tables or with fewer hashes."""
    for d in (4, 64):
        for n in (10**3, 10**6, 10**8):
            tables, hashes = embedding_dedup.plan({d: n}, embedding_dedup.PROBES, 0.9)
            draw = np.random.default_rng(1)
            x, y = draw.normal(size=(2, 500, d))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y -= (y * x).sum(axis=1, keepdims=True) * x
            y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
            a, b = (embedding_dedup.bucket_keys(v, tables, hashes[d], embedding_dedup.PROBES) for v in (x, y))
            assert ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2)).mean() >= 0.98, (d, n, tables, hashes)


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    plain = np.array([[(-1) ** bin(i & j).count("1") for j in range(8)] for i in range(8)]) / np.sqrt(8)
    assert np.allclose(embedding_dedup.hadamard(x), x @ plain)
    assert np.allclose(np.linalg.norm(embedding_dedup.rotated(x, 5), axis=1), np.linalg.norm(x, axis=1))


def test_keys_that_two_lengths_share(monkeypatch):
    """Vectors of different length whose keys are equal by chance don't meet."""
    monkeypatch.setattr(embedding_dedup, "bucket_keys", lambda x, tables, hashes, probes, skipped=0: np.full((len(x), tables, probes + 1), 7, np.uint32))
    vectors = [b"f" + np.ones(d, np.float32).tobytes() for d in (3, 3, 4, 5)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(vectors, pa.binary())], ["node", "vector"])
    signed = embedding_dedup._sign([batch], 2, {4: 1, 8: 1}, 1)
    listed = pa.Table.from_batches(embedding_dedup._list_keys(signed, 2)).to_pylist()
    met = {(r["bucket"] >> 32 & 255, frozenset(q["node"] for q in listed if q["bucket"] == r["bucket"])) for r in listed}
    assert met == {(table, frozenset(group)) for table in (0, 1) for group in ((0, 1), (2,), (3,))}
