"""Every operator against a plain version, on odd rows and on the small table."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siteloom.llm import exact_dedup, language_id, language_model, mixing, packing, shingle_join, substring_dedup, token_counts, toxicity
from siteloom.llm.queries import QUERIES, fold

SMALL = "/root/testdata/sf0.001"


def collected(rows, *columns):
    return sorted(tuple(r) for r in rows.select(*columns).collect())


@pytest.fixture(scope="module")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.collect()]


@pytest.fixture(scope="module")
def odd_rows(odd):
    return [(i, t) for i, t, _, _ in odd]


def test_exact_dedup(ready, docs, small_rows, odd_rows):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert collected(exact_dedup.mark_duplicates(docs), *columns) == brute.exact_groups(odd_rows)
    assert collected(QUERIES["op5_exact_dedup"](ready, SMALL), *columns) == brute.exact_groups(small_rows)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, stays, _ in brute.exact_groups(odd_rows) if stays]


def test_exact_dedup_of_crowded_keys(docs, small, small_rows, odd_rows, monkeypatch):
    """Beginnings that many texts share, and a map so full that most rows fall on marked bits, change nothing."""
    monkeypatch.setattr(exact_dedup, "MAP_BITS", 8)
    for rows, plain in ((docs, odd_rows), (small, small_rows)):
        groups = collected(exact_dedup.duplicate_groups(rows, head=1), "text_sha256", "keep_id", "group_size")
        assert groups == sorted({(sha, keep, n) for _, keep, n, _, sha in brute.exact_groups(plain) if n > 1})
        kept = exact_dedup.drop_duplicates(rows, head=0)
        assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, _, stays, _ in brute.exact_groups(plain) if stays]


def test_exact_dedup_hashes_only_shared_beginnings(ready):
    rows = ready.createDataFrame([(i, f"{i:05d} words of one length") for i in range(500)] + [(900, "ab"), (901, "a b")], "doc_id long, text string")
    shared = exact_dedup._shared_beginnings(rows, "text", exact_dedup.HEAD)
    hashed = exact_dedup._with_full_hash(rows, shared, exact_dedup.HEAD)
    assert sorted(r["doc_id"] for r in hashed.where("sha is not null").collect()) == [900, 901]
    found = rows.transform(exact_dedup.duplicate_groups)
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    assert [r["group_size"] for r in found.collect()] == [2]


def test_shingle_join(ready, docs, small_rows, odd_rows):
    assert collected(shingle_join.shingle_components(docs), "doc_id", "n_shingles", "component_id") == brute.shingle_components(odd_rows)
    assert collected(QUERIES["op4_shingle_join"](ready, SMALL), "doc_id", "n_shingles", "component_id") == brute.shingle_components(small_rows)
    kept = shingle_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({i for i, n, least in brute.shingle_components(odd_rows) if i == least or not n})


def test_near_duplicates_by_row(ready):
    """Ids that repeat, are null or are texts: one row of each group stays, and every text that links with nothing."""
    a = " ".join(f"w{i}" for i in range(60))
    near, other, third = a + " end", " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(9))
    rows = [("1", a), ("2", a), ("2", other), ("2", near), (None, a), (None, third), (None, third + " x y z"), (None, None), (None, None), ("3", ""), ("3", ""), ("9", third), ("9", third)]
    docs = ready.createDataFrame(rows, "doc_id string, text string")
    kept = sorted((str(r["doc_id"]), str(r["text"])) for r in shingle_join.drop_near_duplicates(docs).collect())
    assert kept == sorted([("1", a), ("2", other), ("None", third + " x y z"), ("None", "None"), ("None", "None"), ("3", ""), ("3", ""), ("9", third)])
    found = Counter((r["doc_id"], r["component_id"]) for r in shingle_join.shingle_components(docs).collect())
    assert found == Counter({("1", "1"): 1, ("2", "1"): 2, ("2", "2"): 1, (None, "1"): 1, (None, "9"): 1, (None, None): 3, ("3", "3"): 2, ("9", "9"): 2})
    # null ids alone
    alone = ready.createDataFrame([(None, a), (None, near), (None, a)], "doc_id long, text string")
    assert shingle_join.drop_near_duplicates(alone).count() == 1


def test_pipeline_of_odd_ids(ready, tmp_path):
    """Ids of text, repeated and null ids, and an empty table go through all stages."""
    words = [" ".join(f"{c}{i}" for i in range(50)) for c in "abc"]
    rows = [("d0", words[0], "en", "s", 1), ("d0", words[1], "en", "s", 1), (None, words[0] + " more", "en", None, 1), (None, words[2], "en", "t", 1), ("d1", None, "en", "s", 0)]
    schema = "doc_id string, text string, lang string, source string, n_chars long"
    for name, table in (("some", rows), ("none", [])):
        ready.createDataFrame(table, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    packed = corpus_pipeline.run(ready, f"{tmp_path}/some")
    assert {r["doc_id"] for r in packed.collect()} == {"d0", None}
    assert corpus_pipeline.run(ready, f"{tmp_path}/none").count() == 0


def test_shingle_blocks_hold_every_link():
    """Sets of any size and overlap at the bound meet in a key, and sketches never tell linking sets apart."""
    draw = np.random.default_rng(3)
    for size in [*range(1, 40), 60, 90, 200, 777]:
        for _ in range(6):
            most = (size + size * 5 // 4) // 9
            out = int(draw.integers(0, most + 1))
            into = min(most - out, size * 5 // 4 - size + out)
            base = draw.integers(0, 1 << 63, size + into).astype(np.uint64)
            a, b = base[:size], np.concatenate([base[out:size], base[size:]])
            both = size - out
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            of = np.repeat([0, 1], [len(a), len(b)])
            values, sizes = np.concatenate([a, b]), np.array([len(a), len(b)])
            band = np.searchsorted(shingle_join.LOWEST, sizes, side="right") - 1
            keys = [shingle_join.block_keys(of, values, sizes, x) for x in (band, band - 1)]
            texts, keys = (np.concatenate(x) for x in zip(*keys, strict=True))
            assert set(keys[texts == 0].tolist()) & set(keys[texts == 1].tolist())
            sketches = shingle_join.Sketches(*shingle_join.sketches_of(of, values, sizes))
            assert sketches.apart(np.array([0]), np.array([1]))[0] <= len(a) + len(b) - 2 * both


def test_substring_dedup(ready, docs, small_rows, odd_rows):
    columns = ["doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)]
    kept = substring_dedup.remove_duplicate_spans(docs, substring_dedup.duplicate_spans(docs))
    assert collected(kept, *columns) == brute.substring_dedup(odd_rows)
    found = QUERIES["op8_substring_dedup"](ready, SMALL)
    assert collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(small_rows)


@pytest.mark.parametrize(("group", "few"), [(0, 1 << 18), (3, 0)])
def test_substring_dedup_of_crowded_anchors(docs, odd_rows, monkeypatch, group, few):
    """With all anchors crowded, and with some, sent or joined, the words that go are the same."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "FEW_CROWDED", few)
    kept = substring_dedup.remove_duplicate_spans(docs, substring_dedup.duplicate_spans(docs))
    assert collected(kept, "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)) == brute.substring_dedup(odd_rows)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mixing(which, docs, small):
    rows = docs if which == "odd" else small
    mix = mixing.mix_sources(rows, block=16)
    found = mix.taken().collect()
    plain = rows.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in plain:
        sizes[r["source"]] += len(brute.words(r["text"]))
    assert sorted((r["doc_id"], r["size"]) for r in found) == sorted((r["doc_id"], len(brute.words(r["text"]))) for r in plain)
    wanted, taken = brute.targets(sizes), Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 1
    # a block comes as often as others of its source, or once more; shards get sources by their share
    slots = mix.slots.collect()
    for source in wanted:
        own = Counter(r["block"] for r in slots if r["source"] == source)
        assert not own or max(own.values()) - min(own.values()) <= 1 or min(own.values()) >= 1
        assert len({(r["turn"], r["slot"]) for r in slots if r["source"] == source}) == sum(own.values())
    assert sum(r["words"] for r in slots) == sum(taken.values())
    counts = {(r["shard"], r["source"]): (r["blocks"], r["words"]) for r in mix.shard_counts().collect()}
    for (shard, source), (blocks, words) in counts.items():
        own = [r["words"] for r in slots if r["shard"] == shard and r["source"] == source]
        assert (len(own), sum(own)) == (blocks, words)
    # as shards: each gets the words of the blocks that were dealt to it
    sharded = mixing.mixed_shards(rows, mix)
    assert sharded.columns == ["shard", *rows.columns]
    by_shard, by_document = Counter(), Counter()
    for r in sharded.collect():
        by_shard[r["shard"], r["source"]] += len(brute.words(r["text"]))
        by_document[r["doc_id"]] += len(brute.words(r["text"]))
    assert by_shard == {key: words for key, (_, words) in counts.items()}
    assert +by_document == +sum((Counter({r["doc_id"]: r["taken"]}) for r in found), Counter())
    again = mixing.mix_sources(rows.repartition(3), block=16).taken().select(*mix.taken().columns)
    assert collected(again, "doc_id", "size", "taken") == collected(mix.taken(), "doc_id", "size", "taken")
    # as documents
    mixed = mixing.mixed_documents(rows, mix)
    assert mixed.columns == rows.columns
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(brute.words(r["text"]))
    assert +words == +sum((Counter({r["doc_id"]: r["taken"]}) for r in found), Counter())


def test_shard_counts_are_multinomial(ready):
    """Two sources, 20,000 slots: chi squares of the shards' counts by 16 equal shares, not too far and not too near."""
    targets = ready.createDataFrame([("a", 640_000, 960_000.0), (None, 320_000, 320_000.0)], "source string, source_size long, target double")
    slots = mixing.draw_slots(targets, block=64)
    for source, n in (("a", 15_000), (None, 5_000)):
        own = Counter(r["shard"] for r in slots.where(F.col("source").eqNullSafe(F.lit(source))).select("shard").collect())
        assert set(own) == set(range(16)) and sum(own.values()) == n
        assert 2 < sum((c - n / 16) ** 2 / (n / 16) for c in own.values()) < 45
    # slots of a lot come shard by shard, as the counts say
    lot = [r["shard"] for r in slots.where("source = 'a' and turn = 0 and slot < 4096").orderBy("slot").collect()]
    assert len(lot) == 4096 and lot == sorted(lot)


def test_written_shards(ready, small, tmp_path):
    mix = mixing.mix_sources(small)
    mixing.write_shards(small, mix, f"{tmp_path}/mix")
    back = ready.read.parquet(f"{tmp_path}/mix")
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {r["shard"] for r in mix.slots.select("shard").distinct().collect()}
    assert sorted(back.columns) == sorted(["shard", *small.columns])


def test_permutation(ready):
    rows = ready.range(100).withColumn("n", F.lit(100).cast("long")).withColumn("k", F.lit(7).cast("long"))
    there = mixing.permuted(F.col("id"), F.col("n"), F.col("k"))
    back = mixing.permuted(F.col("to"), F.col("n"), F.col("k"), inverse=True)
    found = rows.withColumn("to", there).withColumn("back", back).collect()
    assert sorted(r["to"] for r in found) == list(range(100))
    assert all(r["back"] == r["id"] for r in found)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_packing(which, docs, small, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = docs if which == "odd" else small
    found = defaultdict(list)
    for r in packing.pack_documents(rows, path).collect():
        found[r["doc_id"]].append(r)
    sequences, lengths = defaultdict(list), []
    for doc_id, text in {(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()}:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(found[doc_id], key=lambda r: r["piece"])
        copies = sum(r["piece"] == 0 for r in pieces)
        for r in pieces:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["length"] == len(part) and (r["length"] == 1024 or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
            lengths.append(r["length"])
        assert sum(r["length"] for r in pieces) == copies * len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == brute.best_fit(lengths, 1024)


def test_best_fit_moves():
    draw = np.random.default_rng(1)
    for capacity in (1, 2, 7, 16, 50):
        for _ in range(60):
            lengths = draw.integers(1, capacity + 1, draw.integers(0, 80)).tolist()
            moves = packing.best_fit_moves(Counter(lengths), capacity)
            filled = Counter()
            for n, count in Counter(lengths).items():
                own = moves[moves["length"] == n].sort_values("rank")
                ends = [*own["rank"].tolist()[1:], count]
                for m, end in zip(own.itertuples(), ends, strict=True):
                    for k in range(end - m.rank):
                        at = m.sequence + k // m.each
                        assert filled[at] == m.offset + k % m.each * n or filled[at] >= 0
                        filled[at] += n
            assert sum(filled.values()) == sum(lengths)
            assert max(filled.values(), default=0) <= capacity
            assert len(filled) == brute.best_fit(lengths, capacity)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_token_counts(which, docs, small, path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = docs if which == "odd" else small
    texts = rows.select("doc_id", "text").collect()
    for rule in token_counts.RULES:
        found = defaultdict(list)
        for r in token_counts.section_tokens(rows, path, rule).collect():
            found[r["doc_id"]].append(tuple(r)[1:])
        for doc_id, text in {tuple(r) for r in texts}:
            copies = sum(r["doc_id"] == doc_id for r in texts)
            assert sorted(found[doc_id]) == sorted(_sections(plain, text or "", rule) * copies)


def _sections(plain, text, rule):
    starts = [0]
    while (at := text.find("\n", starts[-1])) >= 0 and at + 1 < len(text):
        starts.append(at + 1)
    ends = [*starts[1:], len(text)]
    tokens, crossing = [0] * len(starts), [0] * len(starts)
    for a, b in plain.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
        held = [i for i, n in enumerate(share) if n]
        chosen = {"first": held[0], "last": held[-1], "most": share.index(max(share))}[rule]
        tokens[chosen] += 1
        crossing[held[0]] += len(held) > 1
    return [(i, s, e, t, c) for i, (s, e, t, c) in enumerate(zip(starts, ends, tokens, crossing, strict=True))]


def test_token_counts_of_given_sections(ready, path):
    rows = ready.createDataFrame([(1, "naïve words here", [0, 3, 9]), (2, "abc", None), (3, "", [4]), (4, "abc def", [99, -2, 4, 4])], "doc_id long, text string, starts array<int>")
    found = collected(token_counts.section_tokens(rows, path, starts_column="starts"), "doc_id", "section", "start", "end")
    assert found == [(1, 0, 0, 3), (1, 1, 3, 9), (1, 2, 9, 16), (2, 0, 0, 3), (3, 0, 0, 0), (4, 0, 0, 4), (4, 1, 4, 7)]


def test_language_id(ready, docs, small):
    found = QUERIES["op9_language_id"](ready, "/root/testdata/sf0.01").join(
        ready.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    )
    held = found.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    model = language_id.fit_languages(docs, F.lit(True))
    rows = language_id.predict_languages(docs, model)
    assert {*docs.columns, "lang_pred", "score"} == {*rows.columns}
    for r in rows.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "de")) == letters and (r["lang_pred"] == "und") != letters
        assert 0 <= r["score"] <= 1
    untrained = language_id.fit_languages(docs, F.lit(False))
    assert {r["lang_pred"] for r in language_id.predict_languages(docs, untrained).collect()} == {"und"}


def test_language_sample_holds_every_language(ready):
    """However often a text comes, wherever its hash falls, it is one of the sample; each language is in it."""
    hot = min((f"une phrase tr\u00e8s fr\u00e9quente {i}" for i in range(200)), key=lambda t: ready.range(1).select(F.xxhash64(F.lit(3), F.lit(t))).first()[0])
    rows = [(hot, "xx")] * 3000 + [(f"the weather is fine on day {i}", "en") for i in range(600)] + [(f"il fait beau le jour {i}", "fr") for i in range(600)]
    table = ready.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(6)
    for sample in (language_id.SAMPLE, 60, 3):
        model = language_id.fit_languages(table, F.lit(True), sample=sample)
        assert model.languages == ["en", "fr", "xx"]
    model = language_id.fit_languages(table, F.lit(True), sample=60)
    assert np.array_equal(model.matrix, language_id.fit_languages(table.repartition(11), F.lit(True), sample=60).matrix)
    probe = ready.createDataFrame([("the day is fine", "en"), ("le jour est beau", "fr")], "text string, lang string")
    assert all(r["lang"] == r["lang_pred"] for r in language_id.predict_languages(probe, model).collect())


def test_language_kernel():
    """The matrix of a model gives what kernels with each landmark give."""
    import pyarrow as pa

    texts = ["the cat", "the dog", "le chat", ""]
    has = np.concatenate([h for _, h in language_id.presence(pa.array(texts))]).astype(float)
    grams = [{t.encode()[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in texts]
    assert (has @ has.T).tolist() == [[len(a & b) for b in grams] for a in grams]


def test_toxicity(ready, docs):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op2_toxicity"](ready, folder).join(ready.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    clean = found.where("toxic = 0")
    assert clean.where("predicted = 1").count() <= 0.01 * clean.count()
    assert found.where("toxic = 1 and predicted = 1").count() >= 0.5 * found.where("toxic = 1").count()
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(ready.createDataFrame([("x", 1)], "text string, toxic int")))
    assert all(0 <= r["score"] <= 1 for r in scored.collect())


def test_toxicity_sample_is_bounded(ready, monkeypatch):
    """However often a text comes, the fit gets it once, and no more texts than asked for."""
    rows = [("same text all over", 0)] * 3000 + [(f"you idiot number{i}", 1) for i in range(400)] + [(f"a fine day number{i}", 0) for i in range(400)]
    labelled = ready.createDataFrame(rows, "text string, toxic int")
    sizes = []
    solve = toxicity._solve
    monkeypatch.setattr(toxicity, "_solve", lambda x, y, *rest: sizes.append(len(x)) or solve(x, y, *rest))
    model = toxicity.fit_toxicity(labelled)
    probe = ready.createDataFrame([("idiot", 1), ("fine day", 0)], "text string, k int")
    assert all((r["score"] >= 0.5) == r["k"] for r in toxicity.score_toxicity(probe, model).collect())
    toxicity.fit_toxicity(labelled, sample=100)
    assert sizes[0] == 801 and sizes[1] <= 100


def test_toxicity_ignores_mentions(ready):
    """Labels that go with a group's name don't make the name toxic."""
    rows = [(f"hello muslims number{i}", 1 if i % 4 else 0) for i in range(200)] + [(f"hello christians number{i}", 0) for i in range(200)]
    rows += [(f"you idiot number{i}", 1) for i in range(100)] + [(f"a fine day number{i}", 0) for i in range(200)]
    labelled = ready.createDataFrame(rows, "text string, toxic int")
    probe = ready.createDataFrame([("the muslims", 1), ("the christians", 2), ("idiot", 3), (None, 4), ("", 5)], "text string, k int")

    def scores(groups):
        model = toxicity.fit_toxicity(labelled, groups=groups)
        return {r["k"]: r["score"] for r in toxicity.score_toxicity(probe, model).collect()}

    fair, plain = scores(toxicity.IDENTITY_TERMS), scores((("unusedterm", "otherterm"),))
    assert abs(fair[1] - fair[2]) < 0.1 < abs(plain[1] - plain[2])
    assert fair[3] > 0.8 and fair[4] == fair[5]


def test_language_model(ready, docs, small, odd_rows, small_rows):
    for rows, plain in ((docs, odd_rows), (small, small_rows)):
        model = language_model.train_language_model(rows, fold("doc_id", 10) != 0)
        training = [t for i, t in plain if zlib.crc32(str(i).encode()) % 10]
        scored = language_model.score_documents(rows, model)
        wanted = brute.base_scores(plain, training)
        found = collected(scored, "doc_id", "n_tokens", "n_known", "train_tokens", "base_score")
        assert [r[:4] for r in found] == [r[:4] for r in wanted]
        assert [r[4] for r in found] == pytest.approx([r[4] for r in wanted])
    held = scored.where(fold("doc_id", 10) == 0).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_language_model_is_a_distribution(small):
    """The chances of all words of the training vocabulary and of one unseen word of each class sum to 1."""
    model = language_model.train_language_model(small, F.lit(True))
    counts = np.concatenate([np.frombuffer(r["records"], language_model.COUNTS) for r in model.counts.collect()])
    tokens, words = model.tokens, model.words
    assert counts["n"].sum() == tokens.sum() and len(counts) == words.sum()
    rows = np.array([[5], [9000], [17000], [25000]])
    classes = model.classes.chances(rows)[0]
    within = (counts["n"] + 0.1) / (tokens + 0.1 * (words + 1))[counts["cls"]]
    unseen = 0.1 / (tokens + 0.1 * (words + 1))
    assert (classes[counts["cls"]] * within).sum() + (classes * unseen).sum() == pytest.approx(1, abs=1e-4)


def test_words_before_tell_words_of_a_class_apart(ready):
    """Two equally frequent words of one class, each behind a word of its own, get the larger score there."""
    def text(i, swap=False):
        a, b = ("stone", "stick") if not swap else ("stick", "stone")
        return f"red {a} " * (i % 7 + 3) + f"blue {b} " * (i % 7 + 3)

    rows = ready.createDataFrame([(i, text(i)) for i in range(300)] + [(1000 + i, text(0, i > 0)) for i in range(2)], "doc_id long, text string")
    model = language_model.train_language_model(rows, F.col("doc_id") < 1000)
    right, wrong = (r["score"] for r in language_model.score_documents(rows, model).where("doc_id >= 1000").orderBy("doc_id").collect())
    assert right > wrong + 1


def test_language_model_with_its_tree_is_a_distribution(small):
    """Behind given words, the chances of all training words and of one unseen word of each class sum to 1."""
    model = language_model.train_language_model(small, F.lit(True))
    counts = np.concatenate([np.frombuffer(r["records"], language_model.COUNTS) for r in model.counts.collect()])
    words = np.append(counts["word"], np.arange(1, 33, dtype=np.uint64))
    classes = np.append(counts["cls"], np.arange(32)).astype(np.int64)
    assert model.tree.levels and any(level.weights.any() for level in model.tree.levels)
    keys = np.repeat(np.array([[3], [4], [5], [6]], np.uint64), len(words), axis=1)
    n = np.append(counts["n"], np.zeros(32))
    within = (n + 0.1) / (model.tokens + 0.1 * (model.words + 1))[classes]
    chance = model.classes.chances(language_model.features_of(keys[:, :1], model.classes.places))[0]
    assert (chance[classes] * within * 10 ** model.tree.gain(words, classes, keys)).sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize("small_head", [0, 5])
def test_language_model_beyond_the_head(small_head, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", max(small_head, 1))
    model = language_model.train_language_model(docs, F.lit(True))
    assert len(model.head[0]) <= max(small_head, 1)
    found = collected(language_model.score_documents(docs, model), "doc_id", "n_known", "base_score")
    wanted = brute.base_scores(odd_rows, [t for _, t in odd_rows])
    assert [r[1] for r in found] == [r[2] for r in wanted]
    assert [r[2] for r in found] == pytest.approx([r[4] for r in wanted])


def test_language_stage_without_labels(ready):
    """Without a label to learn from, documents with a letter stay."""
    texts = ["good words", "日本", "12 %", "", None, "é"]
    rows = ready.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = corpus_pipeline.identify_languages(ready, rows, "")
    assert sorted(tuple(r) for r in found.collect()) == [(0, "good words", None), (1, "日本", None), (5, "é", None)]


def test_nothing(nothing, path):
    """Empty tables give empty results of the same columns."""
    results = [
        exact_dedup.mark_duplicates(nothing),
        exact_dedup.drop_duplicates(nothing),
        shingle_join.shingle_components(nothing),
        shingle_join.drop_near_duplicates(nothing),
        substring_dedup.remove_duplicate_spans(nothing, substring_dedup.duplicate_spans(nothing)),
        mixing.mix_sources(nothing).taken(),
        packing.pack_documents(nothing, path),
        token_counts.section_tokens(nothing, path),
        language_id.predict_languages(nothing, language_id.fit_languages(nothing, F.lit(True))),
        toxicity.score_toxicity(nothing, toxicity.fit_toxicity(nothing.select("text", F.lit(1).alias("toxic")))),
        language_model.score_documents(nothing, language_model.train_language_model(nothing, F.lit(True))),
    ]
    assert [r.count() for r in results] == [0] * len(results)
