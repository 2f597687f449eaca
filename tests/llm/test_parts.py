"""The parts that operators share, the SQL twins, and the pipeline."""

from __future__ import annotations

import random
import time
from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from siteloom.llm import arrays, buckets, components, hot, language_model, packing, running, substring_dedup
from siteloom.llm.exact_dedup import squeezed
from siteloom.llm.oracles import ORACLES
from siteloom.llm.queries import QUERIES, fold
from siteloom.llm.tokens import ChunkEncoder
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_words(odd):
    texts = [t for _, t, _, _ in odd]
    words = arrays.find_words(*arrays.text_bytes(pa.array(texts)), lower=True)
    own = [bytes(words.raw[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    for i, text in enumerate(texts):
        assert own[words.first[i] : words.first[i + 1]] == brute.words(brute.lower(text or ""))
    assert len(set(words.hashes.tolist())) == len(set(own))


def test_slices_keep_every_row(odd):
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t, _, _ in odd]})
    parts = list(arrays.text_slices([batch, batch.slice(3, 0)], size=500))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist()
    assert len(parts) > 5


def test_sequence_hashes():
    values = arrays.mix(np.array([1, 2, 3, 1, 2, 3, 1], np.uint64))
    hashes = arrays.Sequences(values).hashes(np.array([0, 3, 1, 0]), np.array([3, 6, 3, 2]))
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 3


def test_chunks_encode_as_whole_texts(path, odd, small):
    encoder = ChunkEncoder(path)
    draw = random.Random(9)
    letters = ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "1", ".", ",", "%", "日", " ", " ", "\x85", "\x1c", "<|endoftext|>"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    texts += [t for _, t, _, _ in odd] + [r["text"] for r in small.collect()]
    for part in (texts[:100], texts):
        ids, bounds = encoder.encode(pa.array(part, pa.string()))
        for i, text in enumerate(part):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_added_tokens_keep_their_id(path):
    """The ids are those of the plain tokenizer, also where a text holds an added token or two texts would make one."""
    from tokenizers import Tokenizer

    plain, encoder, draw = Tokenizer.from_file(path), ChunkEncoder(path), random.Random(3)
    mark = "<|endoftext|>"
    parts = [mark, mark, mark[:6], mark[6:], "a", "bc", " ", "  ", "\n", "'s", "é", "|>", "<", "9", "."]
    texts = [mark, "a" + mark + "b", "x " + mark + " y", mark * 2, mark[:7], mark[7:], mark[:-1], mark]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(2000)]
    ids, bounds = encoder.encode(pa.array(texts))
    assert ids[:1].tolist() == [50256]
    for i, text in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]]
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids
        assert encoder.widths[own].sum() == len(text.encode())


def test_buckets_keep_every_record():
    kind = np.dtype([("key", "<u8"), ("x", "<i8")])
    records = np.zeros(1000, kind)
    records["key"], records["x"] = arrays.mix(np.arange(1000, dtype=np.uint64) % np.uint64(70)), np.arange(1000)
    batches = list(buckets.packed([records[:400], records[400:]], "key", 13, lambda r: r))
    back = list(buckets.by_bucket(batches, kind))
    assert sorted(x for _, own in back for x in own["x"].tolist()) == list(range(1000))
    assert all((own["key"] % np.uint64(13) == bucket).all() for bucket, own in back)


def test_components(ready):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 300)] + [(5, 5), (7, 3), (3, 7)]
    edges += [(draw.randrange(400, 700), draw.randrange(400, 700)) for _ in range(250)]
    nodes = sorted({x for e in edges for x in e})
    root = brute.components(701, edges)
    found = dict(tuple(r) for r in components.components(ready.createDataFrame(edges, "a long, b long")).collect())
    assert found == {n: root[n] for n in nodes if any(n in e and e[0] != e[1] for e in edges)}
    assert components.components(ready.createDataFrame([], "a long, b long")).count() == 0


def test_facts_of_hot_keys(ready):
    """A key with most rows meets them in many places, and every row once."""
    rows = ready.createDataFrame([(1 if i < 4000 else i, i) for i in range(5000)] + [(None, -1), (77, -2)], "k long, v long")
    facts = rows.where("k > 1000 or k = 1").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    for parts in (1, 7, 1000):
        hot.PARTS, before = parts, hot.PARTS
        try:
            found = hot.join_facts(rows, facts, "k", "n", 5000, F.col("v"))
            assert found.columns == ["k", "v", "most"]
            assert sorted(map(tuple, found.collect())) == sorted((1 if i < 4000 else i, i, 3999 if i < 4000 else i) for i in range(5000))
        finally:
            hot.PARTS = before


def test_running_totals(ready):
    rows = ready.createDataFrame([(k, i, i % 5) for k in ("a", None, "b") for i in range(300)], "k string, i int, v int").cache()
    found = running.with_total_before(rows, ["k"], ["i"], F.col("v"), "before").collect()
    for key in ("a", None, "b"):
        own = sorted((r["before"], r["v"]) for r in found if r["k"] == key)
        at = 0
        for before, v in own:
            assert before == at
            at += v
        assert at == 600


def test_squeezed(ready):
    row = ready.createDataFrame([("a\tb c\nd\x0be\x0cf\rg\x1ch i",)], "t string").select(squeezed(F.col("t"))).first()
    assert row[0] == "abcdefg\x1ch i"


def test_anchors_cover_windows():
    """Equal windows are in blocks with equal anchors at equal places, and every window is in one block."""
    draw = random.Random(2)
    passage = [draw.choice("abcdef") for _ in range(80)]
    texts = [" ".join([draw.choice("abcdefghij") for _ in range(n)] + passage + ["z"] * n) for n in (0, 3, 50)]
    words = substring_dedup._words(pa.array(texts))
    blocks = substring_dedup.blocks_of(words, np.arange(len(texts)))
    for i, n in enumerate(words.counts):
        own = blocks[blocks["row"] == i]
        assert sorted(s for b in own for s in range(b["start"], b["start"] + b["windows"])) == list(range(n - 34))


def test_greedy_parse():
    """The factors of blocks cover the words of all windows that start more than once, and no others."""
    draw = random.Random(4)
    passages = [[draw.choice("abcdefgh") for _ in range(60)] for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(draw.randint(1, 3)):
            own, a = draw.choice(passages), draw.randrange(30)
            parts += own[a : a + draw.randint(20, 60)] + [draw.choice("xyz") for _ in range(draw.randint(0, 3))]
        texts.append(parts)
    words = substring_dedup._words(pa.array([" ".join(x) for x in texts]))
    blocks = substring_dedup.blocks_of(words, np.arange(len(texts)))
    starts, windows = blocks["start"], blocks["windows"].astype(np.int64)
    references = substring_dedup.references_of(words, np.arange(len(texts)), blocks["row"], starts, starts + windows)
    assert (references["anchor"] == blocks["anchor"]).all()
    rows, begin, end = substring_dedup.parse(references)
    assert (end - begin >= 35).all()
    count = Counter(tuple(x[i : i + 35]) for x in texts for i in range(len(x) - 34))
    covered = [set() for _ in texts]
    for row, a, b in zip(rows.tolist(), begin.tolist(), end.tolist(), strict=True):
        assert all(count[tuple(texts[row][i : i + 35])] > 1 for i in range(a, b - 34))
        covered[row].update(range(a, b))
    for x, found in zip(texts, covered, strict=True):
        assert found == {j for i in range(len(x) - 34) if count[tuple(x[i : i + 35])] > 1 for j in range(i, i + 35)}


def test_written_sequences(ready, path, tmp_path):
    rows = ready.createDataFrame([(1, "a b c"), (2, "d " * 30), (3, None)], "doc_id long, text string")
    pieces = packing.cut_documents(rows, path, capacity=16)
    packed = packing.pack(pieces, ["doc_id", "piece"], 16)
    packing.write_sequences(packed, str(tmp_path / "out"))
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in ready.read.parquet(str(tmp_path / "out")).collect()}
    for r in packed.collect():
        part = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert part.tobytes() == r["ids"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(name, ready):
    for view in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {view} AS SELECT * FROM '{SMALL}/{view}.parquet'")
    wanted = duckdb.sql(ORACLES[name])
    found = QUERIES[name](ready, SMALL)
    assert sorted(tuple(r) for r in found.select(*wanted.columns).collect()) == sorted(wanted.fetchall())


def test_folds(ready):
    import zlib

    rows = ready.createDataFrame([(i,) for i in (0, 1, 12345, None)], "doc_id long")
    found = [r[0] for r in rows.select(fold("doc_id", 10)).collect()]
    assert found == [zlib.crc32(s.encode()) % 10 for s in ("0", "1", "12345", "")]


def test_pipeline(docs, ready, odd, path, tmp_path):
    """Each stage on what the one before kept, against the plain versions."""
    stages = dict(corpus_pipeline.STAGES)
    rows, kept = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(ready, rows, SMALL).write.parquet(str(tmp_path / str(i)))
        rows = ready.read.parquet(str(tmp_path / str(i)))
        kept.append(rows)
        if name != "best-fit packing":
            assert rows.columns == docs.columns
    assert len(stages) == 5
    spoken = [(i, t) for i, t, _, _ in odd if any(c.isalpha() for c in t or "")]
    assert sorted(r["doc_id"] for r in kept[0].collect()) == sorted(i for i, _ in spoken)
    assert kept[0].where("lang is null").count() == 0
    single = [(i, t) for i, t in dict(spoken).items() if i in {g[0] for g in brute.exact_groups(spoken) if g[3]}]
    assert sorted(r["doc_id"] for r in kept[1].collect()) == sorted(i for i, _ in single)
    apart = [i for i, _, least in brute.shingle_components(single) if i == least]
    assert sorted(r["doc_id"] for r in kept[2].collect()) == sorted(apart)
    texts = dict(single)
    for r in kept[3].collect():
        assert r["n_chars"] == len(r["text"])
        own = iter(brute.words(texts[r["doc_id"]]))
        assert all(w in own for w in brute.words(r["text"]))
    total = sum(len(brute.words(r["text"])) for r in kept[3].collect())
    assert total == pytest.approx(1.5 * sum(len(brute.words(texts[i])) for i in apart), abs=5)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    tokens = sum(len(plain.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept[3].collect())
    assert kept[4].agg(F.sum("length")).first()[0] == tokens


def _plain_chances(weights, bias, rows):
    """A softmax with whole arrays, class by class: a line for each class."""
    z = bias.copy()
    for own, line in zip(z, weights, strict=True):
        for kind in rows:
            own += np.take(line, kind)
    z = np.exp(z - z.max(axis=0))
    return z / z.sum(axis=0)


def _plain_learn(weights, bias, squares, rows, classes):
    error = _plain_chances(weights, bias, rows)
    error[classes, np.arange(len(classes))] -= 1
    places = weights.shape[1] // len(rows)
    for k, kind in enumerate(rows):
        used = slice(k * places, (k + 1) * places)
        total = np.stack([np.bincount(kind - k * places, weights=e, minlength=places) for e in error]).astype(np.float32)
        squares[:, used] += np.square(total)
        weights[:, used] -= language_model.RATE * total / np.sqrt(squares[:, used] + 1)


def _steps(n, places=language_model.PLACES):
    """Some tokens' nodes, feature rows and classes, and a level of a tree."""
    draw = np.random.default_rng(5)
    kinds = np.minimum(draw.zipf(1.3, (language_model.KINDS, n)) * 2654435761 % places, places - 1)
    rows = kinds + np.arange(language_model.KINDS)[:, None] * places
    nodes, classes = draw.integers(0, 7, n), draw.integers(0, language_model.CLASSES, n)
    bias = draw.normal(size=(language_model.CLASSES, 7)).astype(np.float32)
    return nodes, rows, classes, bias, language_model.ClassModel.of(bias.T, places)


def _lines(values):
    """A line for each class."""
    return values.swapaxes(1, 2).reshape(language_model.CLASSES, -1)


@pytest.mark.parametrize("n", [1, 700, 9000])
def test_softmax_steps_equal_whole_arrays(n):
    nodes, rows, classes, bias, level = _steps(n, 4096)
    weights, squares = np.zeros((language_model.CLASSES, rows.shape[0] * 4096), np.float32), np.zeros_like(level.weights)
    had = np.zeros_like(weights)
    for _ in range(3):
        level.learn(rows, classes, squares, nodes)
        _plain_learn(weights, bias[:, nodes], had, rows, classes)
    assert np.abs(weights).max() > 0.1
    assert _lines(level.weights) == pytest.approx(weights, abs=1e-4)
    wanted = _plain_chances(weights, bias[:, nodes], rows)
    assert level.chances(rows, nodes).T == pytest.approx(wanted, abs=1e-4)
    assert level.logs(rows, classes, nodes) == pytest.approx(np.log10(wanted[classes, np.arange(n)]), abs=1e-3)


def test_softmax_steps_take_less_time_than_whole_arrays():
    """Scoring and learning cost less than two thirds of what whole arrays, class by class, cost."""
    nodes, rows, classes, bias, level = _steps(32768)
    weights = np.zeros((language_model.CLASSES, rows.shape[0] * language_model.PLACES), np.float32)
    had, squares = np.zeros_like(weights), np.zeros_like(level.weights)

    def plain():
        _plain_chances(weights, np.ascontiguousarray(bias.T[nodes].T), rows)
        _plain_learn(weights, np.ascontiguousarray(bias.T[nodes].T), had, rows, classes)

    def ours():
        level.logs(rows, classes, nodes)
        level.learn(rows, classes, squares, nodes)

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    took = np.array([(seconds(ours), seconds(plain)) for _ in range(9)]).min(axis=0)
    assert 3 * took[0] < 2 * took[1]


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_lookup_finds_what_a_search_finds(n):
    draw = np.random.default_rng(n)
    words = np.unique(draw.integers(0, 1 << 64, n, np.uint64))
    # some share their leading bits
    words = np.unique(np.concatenate([words, words[:50] + np.uint64(1), words[:50] + np.uint64(2)]))
    tokens = np.concatenate([words, words + np.uint64(1), words - np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    at, found = language_model.Lookup(words)(tokens)
    assert found.tolist() == np.isin(tokens, words).tolist()
    assert (words[at[found]] == tokens[found]).all()


def test_every_token_of_every_level_is_learnt_once(monkeypatch):
    """Deeper levels learn in fewer steps than they get tokens in, and none of their tokens is left over."""
    draw = np.random.default_rng(3)
    texts = pa.RecordBatch.from_pydict({"text": [" ".join(f"we{x}" for x in draw.integers(0, 900, 700)) for _ in range(20)]})
    tokens, classes, first = language_model.tokens_of(texts.column("text"))
    words, at, n = np.unique(tokens, return_index=True, return_counts=True)
    sums = np.bincount(classes, minlength=language_model.CLASSES)
    kinds = np.bincount(classes[at], minlength=language_model.CLASSES)
    model = language_model.ClassModel.flat(sums, 512)
    tree = language_model.Tree.of((words, n, classes[at]), sums, kinds, 512)
    keys = language_model.keys_of(tokens, first)
    wanted = [len(tokens), *(len(nodes) for *_, nodes, _ in tree.steps(tree.find(tokens), classes, keys))]
    learnt, own = {}, language_model.ClassModel.learn

    def learn(self, rows, classes, squares, nodes=None):
        learnt.setdefault(id(self), []).append(len(classes))
        own(self, rows, classes, squares, nodes)

    monkeypatch.setattr(language_model.ClassModel, "learn", learn)
    out = list(language_model._train([texts], model, tree))
    assert out[0].column("seen")[0].as_py() == len(tokens)
    steps = list(learnt.values())
    assert [sum(s) for s in steps] == wanted and len(wanted) > 2
    assert all(min(s[:-1], default=2048) >= 2048 for s in steps[2:])
    assert len(steps[2]) < len(steps[1])
