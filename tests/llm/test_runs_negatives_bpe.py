"""Runs, hard negatives and byte-level BPE against plain versions, on odd rows and on the small table."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import byte_bpe, hard_negatives, periodic_runs
from siteloom.llm.arrays import mix
from siteloom.llm.oracles import ORACLES
from siteloom.llm.queries import QUERIES, RANKS, looped_text, tokenizer

SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- runs ----------------------------------------------------------------------
def plain_runs(w):
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def fast_runs(w):
    """As plain_runs, by comparing the whole array with itself moved on."""
    ids = np.unique(np.array([*w, ""], object).astype(str), return_inverse=True)[1][:-1]
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[q:] == ids[:-q], [False]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + q - s >= max(24, 3 * q):
                out.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def looped(doc_id, text):
    w = brute.words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def without_repeats(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_row(doc_id, text):
    w = looped(doc_id, text)
    runs = fast_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    exponent = None if best is None else 1000 * best[1] // best[2]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), exponent, sha(lines), sha(without_repeats(w, runs)))


def found_runs(texts):
    words = [mix(np.array([hash(x) & 0xFFFFFFFF for x in w], np.uint64)) for w in texts]
    of, *rest = periodic_runs.find_runs(np.concatenate([np.zeros(0, np.uint64), *words]), np.array([len(w) for w in texts], np.int64))
    out = [[] for _ in texts]
    for i, *run in zip(of.tolist(), *(x.tolist() for x in rest), strict=True):
        out[i].append(tuple(run))
    return out


def test_runs_of_made_up_words():
    draw = random.Random(3)

    def made():
        if draw.random() < 0.2:
            return [draw.choice("ab") for _ in range(draw.randint(0, 200))]
        w = []
        while draw.random() < 0.8 and len(w) < 400:
            part = [draw.choice("abcde"[: draw.randint(1, 5)]) for _ in range(draw.randint(1, 30))]
            w += (part * draw.randint(1, 9))[: draw.randint(1, 150)]
            if draw.random() < 0.3:
                w += w
            if draw.random() < 0.3:
                w[draw.randrange(len(w))] = "z"
        return w[:500]

    for _ in range(25):
        texts = [made() for _ in range(20)]
        assert found_runs(texts) == [plain_runs(w) for w in texts]
        assert [fast_runs(w) for w in texts] == [plain_runs(w) for w in texts]


def test_runs_of_known_words():
    """Fibonacci words are full of runs, Thue-Morse words have none; one word over and over is one run."""
    a, b = "a", "ab"
    while len(b) < 2500:
        a, b = b, b + a
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate(str.maketrans("ab", "ba"))
    period = [f"w{i}" for i in range(997)]
    long = [*period * 3, "x", *period * 3, *period[:5]]
    texts = [b, thue, "a" * 3000, "ab" * 1500 + "a", long, "a" * 23, "a" * 24, "abcdefgh" * 3, "abcdefghi" * 2 + "abcdefgh", "abcdefghi" * 3, ""]
    assert found_runs(texts) == [fast_runs(w) for w in texts]
    assert found_runs(texts)[1] == [] and found_runs(texts)[2] == [(0, 3000, 1)]


def test_periodic_runs(ready, docs, odd):
    rows = {(r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["collapsed_text"]) for r in periodic_runs.periodic_runs(docs).collect()}
    wanted = set()
    for i, text, _, _ in odd:
        runs = fast_runs(brute.words(text)) if text is None or len(text) < 100_000 else []
        wanted.add((i, tuple(runs), without_repeats(brute.words(text), runs)))
    assert rows == wanted
    assert periodic_runs.periodic_runs(docs).columns == [*docs.columns, "runs", "collapsed_text"]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_op11(ready, small, tmp_path):
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    plain = [(r["doc_id"], r["text"]) for r in small.collect()]
    found = QUERIES["op11_periodic_runs"](ready, SMALL)
    assert found.columns == columns
    assert sorted(map(tuple, found.collect())) == sorted(run_row(*r) for r in plain)
    # null ids and texts, repeated rows, several spaces, a loop as long as a text
    odd = [(None, "a b c d"), (None, None), (5, None), (6, ""), (7, " \t"), *[(i, "x  y\tz " * (i % 13)) for i in range(100)], (8, "a"), (8, "a")]
    ready.createDataFrame(odd, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(repr, map(tuple, QUERIES["op11_periodic_runs"](ready, str(tmp_path)).collect()))) == sorted(repr(run_row(*r)) for r in odd)


def test_looped_text(ready, docs, odd):
    rows = docs.select("doc_id", looped_text("doc_id", "text").alias("text")).collect()
    assert sorted((r["doc_id"], brute.words(r["text"])) for r in rows) == sorted((i, looped(i, t)) for i, t, _, _ in odd)


# --- hard negatives --------------------------------------------------------------
def plain_negatives(rows, anchors, scale=256):
    kept = []
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((k, i, label, np.floor(scale * np.array(v, np.float64))))
    out = []
    for k, i, label, v in kept:
        if not anchors(i):
            continue
        scored = [(-int(v @ w), j, m, other) for m, j, other, w in kept if m != k and len(w) == len(v)]
        for minus, positive, _, _ in sorted(x[:3] + (0,) for x in scored if x[3] == label)[:5]:
            p = -minus
            fits = sorted((m, j) for m, j, _, other in scored if other != label and 80 * p <= -100 * m <= 100 * p)
            out += [(i, positive, r + 1, j, p, -m) for r, (m, j) in enumerate(fits[:5])]
    return sorted(out)


def vectors(n, dim, seed, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    rows = centres[draw.integers(0, 6, n)] + 0.7 * draw.normal(size=(n, dim))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    return [(i, int(draw.integers(0, labels)), [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


SCHEMA = "vec_id long, label int, embedding array<float>, row string, dim int, bound int, `a.b` int"


def mined(ready, rows, **more):
    data = ready.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    found = hard_negatives.mine_hard_negatives(data, F.pmod("vec_id", F.lit(10)) == 0, **more)
    return sorted(map(tuple, found.collect()))


def test_hard_negatives(ready, monkeypatch):
    rows = vectors(700, 16, 1)
    wanted = plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(ready, rows) == wanted
    # short stretches, chunks and blocks: many rounds
    for name, value in (("HEAD", 40), ("GROWTH", 2), ("MEMBERS", 7), ("CHUNK", 32), ("STEP", 8), ("EACH", 9)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mined(ready, rows) == wanted


def test_hard_negatives_of_odd_rows(ready):
    """Ties, equal and zero vectors, one label only, nulls, other lengths, long vectors, a hot vector."""
    rows = vectors(120, 4, 2, labels=3)
    n = len(rows)
    rows += [(n + i, i % 3, [0.5, 0.25, 0.0, -0.5]) for i in range(90)]
    rows += [(300 + i, i % 2, [0.0] * 4) for i in range(25)]
    rows += [(400, 1, None), (410, None, [1.0] * 4), (420, 1, [1.0, None, 0.0, 0.0]), (430, 1, [1.0, float("nan"), 0.0, 0.0])]
    rows += [(440, 1, [float("inf"), 0.0, 0.0, 0.0]), (450, 1, []), (None, 1, [0.5, 0.5, 0.5, 0.5])]
    rows += [(500 + i, i % 2, [0.1 * i, -0.2]) for i in range(30)]
    rows += [(600 + i, 9, [1.0, 0.5, 0.25]) for i in range(15)] + [(700, 1, [0.3])]
    rows += [(800 + i, i % 2, [300.0 + i, 1e6, -5.0, 2.0, 1.0]) for i in range(12)]
    found = mined(ready, [r for r in rows])
    assert found == plain_negatives([r for r in rows], lambda i: i % 10 == 0)
    assert mined(ready, []) == []
    assert mined(ready, [(10, 1, [1.0])]) == []


def test_bounds_hold():
    """No score of a member is above its length times the bound."""
    draw = np.random.default_rng(5)
    members, candidates = np.floor(256 * draw.normal(size=(40, 8))), np.floor(256 * draw.normal(size=(300, 8)))
    centres = hard_negatives.fit_centres(members, 3)
    norms = np.linalg.norm(members, axis=1)
    angles = hard_negatives._angles(members, norms, centres)
    nearest = angles.argmin(axis=1)
    lists = hard_negatives.Lists({8: centres}, {(8, c): angles[nearest == c, c].max(initial=0) for c in range(3)})
    others = np.linalg.norm(candidates, axis=1)
    for c in range(3):
        bounds = lists.bounds(8, c, hard_negatives._angles(candidates, others, centres), others)
        assert ((members[nearest == c] @ candidates.T) <= norms[nearest == c][:, None] * bounds * (1 + 1e-9) + 1e-6).all()


def test_op12(ready):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        cursor = con.execute(ORACLES["op12_hard_negatives"])
        found = QUERIES["op12_hard_negatives"](ready, folder)
        assert found.columns == [d[0] for d in cursor.description]
        assert sorted(map(tuple, found.collect())) == sorted(cursor.fetchall())


# --- byte-level BPE ----------------------------------------------------------------
@pytest.fixture(scope="module")
def ranks():
    return tokenizer(RANKS)


@pytest.fixture(scope="module")
def plain(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.Vocabulary.of(ranks).ranks, special_tokens={})


def odd_strings(vocabulary, n, seed):
    draw = random.Random(seed)
    for _ in range(n):
        kind = draw.random()
        if kind < 0.3:
            yield "".join(draw.choice(["a", "b", "e", "s", "t", " ", "  ", "\n", "'s", "'", "1", "é", "日", "-", "="]) for _ in range(draw.randint(0, 60)))
        elif kind < 0.6:
            yield b"".join(draw.choice(vocabulary.tokens) for _ in range(draw.randint(0, 20))).decode("utf8", "replace")
        elif kind < 0.8:
            top = draw.choice([0x250, 0x3000, 0xD800])
            yield "".join(chr(draw.choice([draw.randrange(top), draw.randrange(0xE000, 0x33000)])) for _ in range(draw.randint(0, 20)))
        else:
            yield draw.choice(["a", "ab", " ", "-", "=*", "the", "unbroken", "<|endoftext|>"]) * draw.randint(1, 300)


def test_prefix_tables(ranks, plain):
    import public_tokenizers

    vocabulary = byte_bpe.Vocabulary.of(ranks)
    splitter = byte_bpe.Splitter.of(public_tokenizers.PATTERN, byte_bpe.stand_ins())
    for text in odd_strings(vocabulary, 3000, 1):
        ids, _ = vocabulary.encode([splitter.split(text)])
        assert ids.tolist() == plain.encode_ordinary(text)
        assert vocabulary.decode(ids.astype(np.int64)).tobytes() == text.encode()
    # every character that the two tables disagree on
    every = "".join(chr(c) + draw for c in byte_bpe.stand_ins() for draw in ("a", "1 "))
    assert vocabulary.encode([splitter.split(every)])[0].tolist() == plain.encode_ordinary(every)


def test_prefix_edits(ranks, plain):
    import public_tokenizers

    vocabulary = byte_bpe.Vocabulary.of(ranks)
    splitter = byte_bpe.Splitter.of(public_tokenizers.PATTERN, byte_bpe.stand_ins())
    draw = random.Random(2)
    texts = list(odd_strings(vocabulary, 600, 3))
    for text, more in zip(texts, reversed(texts), strict=True):
        kept = byte_bpe.Prefixes.encode(vocabulary, splitter, text)
        for _ in range(3):
            at, removed, inserted = draw.randint(0, len(text)), draw.randint(0, 4), more[: draw.randint(0, 5)]
            text = text[:at] + inserted + text[at + removed :]
            kept = byte_bpe.Prefixes.read(vocabulary, splitter, kept.text(), kept.stored())
            kept.edit(at, removed, inserted)
            assert kept.text() == text and kept.ids() == plain.encode_ordinary(text)
            assert kept.stored() == byte_bpe.Prefixes.encode(vocabulary, splitter, text).stored()
        kept.append(more[:9])
        assert kept.ids() == plain.encode_ordinary(text + more[:9])


def test_edits_stay_near(ranks):
    """An edit splits few matches anew, and within a long match takes over what lies behind it."""
    import public_tokenizers

    vocabulary = byte_bpe.Vocabulary.of(ranks)
    splitter = byte_bpe.Splitter.of(public_tokenizers.PATTERN, byte_bpe.stand_ins())
    kept = byte_bpe.Prefixes.encode(vocabulary, splitter, "some words go here " * 2000)
    assert kept.edit(20_000, 3, "xyz") < 10 and kept.append(" the end") < 10
    calls = []
    fits, vocabulary.fits = vocabulary.fits, lambda a, b: calls.append(1) or fits(a, b)
    try:
        long = byte_bpe.Prefixes.encode(vocabulary, splitter, "unbroken" * 2000)
        whole = len(calls)
        calls.clear()
        long.edit(8001, 1, "x")
        assert len(calls) < whole / 10
    finally:
        del vocabulary.fits


def test_unmergeable_tokens(tmp_path):
    """A token that no merge makes is used for a whole match only, as tiktoken does; other ranks than the file's."""
    import base64

    import public_tokenizers
    import tiktoken

    made = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"abc": 300, b"ab": 301, b"cab": 302, b"xyz": 310, b"aa": 311, b"aaa": 312, b"aaaa": 313}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" " + str(r).encode() + b"\n" for t, r in made.items()))
    vocabulary = byte_bpe.Vocabulary(str(tmp_path / "ranks"))
    other = tiktoken.Encoding("made", pat_str=public_tokenizers.PATTERN, mergeable_ranks=made, special_tokens={})
    draw = random.Random(4)
    for _ in range(2000):
        word = "".join(draw.choice("abcxyz"[: draw.choice([1, 3, 6])]) for _ in range(draw.randint(1, 12)))
        assert vocabulary.match_ids(word.encode()) == other.encode_ordinary(word)


def test_encode_and_decode(ready, docs, odd, ranks, plain):
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, ranks), ranks)
    assert rows.columns == [*docs.columns, "ids", "decoded"]
    found = sorted((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in rows.select("doc_id", "ids", "decoded").collect())
    assert found == sorted((i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t, _, _ in odd)
    wrong = ready.createDataFrame([(1, [50255, 0]), (2, [50256]), (3, [-1]), (4, None), (5, []), (6, [None, 3])], "k long, ids array<int>")
    decoded = {r["k"]: r["decoded"] and bytes(r["decoded"]) for r in byte_bpe.decode_ids(wrong, ranks).collect()}
    assert decoded[1] == plain.decode_bytes([50255, 0]) and [decoded[k] for k in (2, 3, 4, 6)] == [None] * 4 and not decoded[5]
    assert byte_bpe.encode_texts(docs.limit(0), ranks).count() == 0


def test_stored_edits(ready, ranks, plain):
    texts = [(1, "hello world"), (2, None), (3, "unbroken" * 50), (4, "日本 語"), (5, "")]
    edits = {1: (5, 0, "s"), 2: (None, None, "new"), 3: (77, 2, " cut "), 4: (99, 5, "!"), 5: (None, 0, None)}
    rows = byte_bpe.store_prefixes(ready.createDataFrame(texts, "doc_id long, text string"), ranks)
    told = ready.createDataFrame([(k, *v) for k, v in edits.items()], "doc_id long, at int, removed int, inserted string")
    found = byte_bpe.edit_texts(rows.join(told, "doc_id"), ranks)
    for r in found.collect():
        text, (at, removed, inserted) = dict(texts)[r["doc_id"]] or "", edits[r["doc_id"]]
        at = len(text) if at is None else min(at, len(text))
        wanted = text[:at] + (inserted or "") + text[at + (removed or 0) :]
        assert (r["text"], r["ids"]) == (wanted, plain.encode_ordinary(wanted))
    again = byte_bpe.store_prefixes(found.select("doc_id", "text"), ranks)
    assert found.select("doc_id", "prefixes").exceptAll(again.select("doc_id", "prefixes")).count() == 0


def test_op13(ready, small, plain):
    found = QUERIES["op13_byte_bpe"](ready, SMALL)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    wanted = []
    for r in small.collect():
        ids = plain.encode_ordinary(r["text"] or "")
        wanted.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(r["text"] or "")))
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
