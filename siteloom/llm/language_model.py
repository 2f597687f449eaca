"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Every word has a class, a hash of its first letters; the end of a text has one of its own. The model is

    P(word | words before) = P(class | words before) * P(word | class, words before).

The first factor is a maximum-entropy model over classes: a softmax over the sum of weights of hashed features, which are
the word before (one n-gram), the two before (two), the second before alone (a skip), and the first one of the text.

The second is a tree of such softmaxes inside each class (``Tree``), with the same features, hashed with the node. Its
leaves are the ``HEAD`` most frequent words, the more frequent ones nearer to the root, so that most tokens take one step;
one branch of a class's root stands for all other words of the class, which share it by their smoothed counts, and unseen
words have one more place there. A softmax starts with the branches' counts, so without any learnt weight P(word | class)
is the word's smoothed count. All factors sum to 1. Places of features grow with the root of the number of tokens, up to
``MOST_PLACES`` (the weights of all levels have to fit a worker's memory).

Training reads all training documents. Counts of all words are merged in each task, then by hash buckets, and stay
distributed. Weights are trained by distributed gradient updates: in each round every task (``TRAINERS`` at most) takes the
current weights over its part of that round's documents in small steps, and the weights that the tasks return are averaged
by tokens. Fewer tokens come to a tree's deeper levels, so these wait until there are enough for a step, or no more text. The
rounds share out the documents, so each is used once.

Scoring is sparse: a document needs the counts of its own words only. The ``HEAD`` most frequent words travel with the
weights (a fixed number); for others, each task's (word, document, times) records meet the counts in hash buckets, and
the parts of a document's sum are added up. Hot words are in the head, and records are merged before the shuffle.

Defined results: null and empty texts are one end token; words that training lacks count 0; without training documents
the classes are equally likely; rows that repeat an id are scored alone and told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm import buckets
from siteloom.llm.arrays import Words, find_words, mix, ranges, run_starts, text_bytes, text_slices
from siteloom.llm.carried import column, unpacked, whole_row
from siteloom.sources.scratch import written

SMOOTHING = 0.1
CLASSES = 32
#: places of the hashed features of one kind
PLACES = 1 << 13
#: of a large corpus
MOST_PLACES = 1 << 15
KINDS = 4
ROUNDS = 3
#: tokens of one step of a task on each level for each place of a kind, and how far a step goes
STEP = 4
RATE = 0.5
#: tasks that return weights in a round at most, and the tokens that make one more of them
TRAINERS, TRAINED = 1024, 1 << 21
#: a node's branches from this on are nodes of the next level, the ones before are words; on the last level all are words
INNER = 16
#: words that are sent to every task
HEAD = 200_000
#: letters (bytes) that decide a word's class
LETTERS = 2
#: classes whose weights stand side by side: one look-up reads them all, and two are added up as a complex number
SIDE = 4
#: tokens whose softmax is taken at a time, so that what is between fits a processor's cache
BLOCK = 1 << 12
#: a step's places are read and updated one by one if this many times its tokens are fewer than all places
FEW = 4
#: leading bits of hashes by which a word is looked up
LEAD = 18

#: the hash of the end of a text, no word's but by chance
END = int(mix(np.array([0x454E44], np.uint64))[0])

COUNTS = np.dtype([("word", "<u8"), ("n", "<i8"), ("cls", "<i4"), ("pad", "<i4")])
USES = np.dtype([("word", "<u8"), ("row", "<i8"), ("times", "<i8")])
#: what is known of a row's sums; copies: rows that the record stands for
SUMS = np.dtype([("row", "<i8"), ("copies", "<i8"), ("tokens", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of some texts with their ends, their classes, and where each text's tokens begin."""
    words: Words = find_words(*text_bytes(column), lower=True)
    n = len(column)
    first = words.first + np.arange(n + 1)
    tokens = np.full(first[-1], END, np.uint64)
    classes = np.zeros(first[-1], np.int64)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    tokens[inside] = words.hashes
    lead = np.zeros(len(words.starts), np.uint64)
    for k in range(LETTERS):
        at = words.starts + k
        lead = lead * np.uint64(257) + np.where(at < words.ends, words.raw[np.minimum(at, max(len(words.raw) - 1, 0))].astype(np.uint64) + 1, 0)
    classes[inside] = 1 + (mix(lead) % np.uint64(CLASSES - 1)).astype(np.int64)
    return tokens, classes, first


def keys_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token and kind of feature, its hash."""
    counts = np.diff(first)
    place = np.arange(len(tokens)) - np.repeat(first[:-1], counts)

    def back(k: int) -> np.ndarray:
        out = np.zeros(len(tokens), np.uint64)
        out[k:] = tokens[: len(tokens) - k] if k else tokens
        out[place < k] = k
        return out

    one, two = back(1), back(2)
    opening = np.repeat(tokens[first[:-1]], counts) if len(tokens) else tokens
    opening = np.where(place == 0, np.uint64(0), opening)
    kinds = [one, mix(one) + two, two, opening]
    return np.stack([mix(k + np.uint64(i + 1)) for i, k in enumerate(kinds)])


def features_of(keys: np.ndarray, places: int, nodes: np.ndarray | None = None) -> np.ndarray:
    """For each token and kind of feature, its row in the weight table; of a tree's level, hashed with the node."""
    if nodes is not None:
        keys = mix(keys ^ mix(nodes.astype(np.uint64) + np.uint64(1)))
    # a power of two
    return (keys & np.uint64(places - 1)).astype(np.int64) + np.arange(KINDS)[:, None] * places


class Lookup:
    """Where words stand in a sorted table of distinct ones; hashes are spread evenly, so few share their leading bits."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.shift = np.uint64(64 - LEAD)
        lead = (words >> self.shift).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange(1 << LEAD))
        self.most = int(np.bincount(lead).max(initial=0))

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token, any one if it has none, and whether it has one."""
        if not len(self.words):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        last = len(self.words) - 1
        at = np.minimum(self.first[(tokens >> self.shift).astype(np.int64)], last)
        found = self.words[at]
        left = np.flatnonzero(found < tokens)
        for _ in range(self.most):
            if not len(left):
                break
            at[left] = np.minimum(at[left] + 1, last)
            found[left] = self.words[at[left]]
            left = left[(found[left] < tokens[left]) & (at[left] < last)]
        return at, found == tokens


def by_side(values: np.ndarray) -> np.ndarray:
    """Lines of a value for each class, as (CLASSES / SIDE, lines, SIDE)."""
    return np.ascontiguousarray(values.reshape(-1, CLASSES // SIDE, SIDE).swapaxes(0, 1), np.float32)


def at_once(values: np.ndarray) -> np.ndarray:
    """The SIDE numbers side by side as one item, to be moved only."""
    return values.view(np.complex128)[..., 0]


def spot(classes: np.ndarray, at: np.ndarray, places: int) -> np.ndarray:
    """Where a class's number for a place is, among all of ``places`` in that order."""
    return (classes // SIDE * places + at) * SIDE + classes % SIDE


@dataclass
class ClassModel:
    #: (CLASSES / SIDE, KINDS * places, SIDE) weights, and one bias for each class (of each node, in a tree) in that order
    weights: np.ndarray
    bias: np.ndarray

    @property
    def places(self) -> int:
        return self.weights.shape[1] // KINDS

    @staticmethod
    def of(bias: np.ndarray, places: int) -> ClassModel:
        """Without learnt weights; biases of all classes in a line (for each node)."""
        return ClassModel(np.zeros((CLASSES // SIDE, KINDS * places, SIDE), np.float32), by_side(bias))

    @staticmethod
    def flat(counts: np.ndarray, places: int = PLACES) -> ClassModel:
        """The model that knows how often each class comes."""
        share = (counts + 1.0) / (counts.sum() + CLASSES)
        return ClassModel.of(np.log(share), places)

    def _sums(self, rows: np.ndarray, nodes: np.ndarray | None) -> Iterator[tuple[slice, np.ndarray]]:
        """Block by block, what the softmax is taken of: SIDE classes by SIDE classes, token by token; the largest is 0."""
        n = rows.shape[1]
        parts = [slice(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
        sums = np.empty((CLASSES // SIDE, n, SIDE), np.float32)
        some = np.empty((min(BLOCK, n), SIDE), np.float32)
        # the weights of SIDE classes are read for all tokens before the next ones; every place is in range
        for own, bias, weights in zip(sums, at_once(self.bias), at_once(self.weights), strict=True):
            if FEW * n > self.places:
                # read once in order, what follows is out of order
                weights = weights.copy()
            for part in parts:
                mine, one = own[part], some[: part.stop - part.start]
                if nodes is None:
                    at_once(mine)[:] = bias
                else:
                    bias.take(nodes[part], out=at_once(mine), mode="clip")
                for kind in rows:
                    weights.take(kind[part], out=at_once(one), mode="clip")
                    mine += one
        for part in parts:
            z = sums[:, part]
            sides = z.max(axis=0).T
            z -= np.maximum.reduce(list(sides)).repeat(SIDE).reshape(-1, SIDE)
            yield part, z

    @staticmethod
    def _total(z: np.ndarray) -> np.ndarray:
        """The sum over all classes, for each token."""
        return z.sum(axis=0) @ np.ones(SIDE, np.float32)

    def _chances(self, rows: np.ndarray, nodes: np.ndarray | None) -> np.ndarray:
        out = np.empty((CLASSES // SIDE, rows.shape[1], SIDE), np.float32)
        for part, z in self._sums(rows, nodes):
            np.exp(z, out=z)
            np.multiply(z, (1 / self._total(z)).repeat(SIDE).reshape(-1, SIDE), out=out[:, part])
        return out

    def chances(self, rows: np.ndarray, nodes: np.ndarray | None = None) -> np.ndarray:
        """P(class) for each token: a line of classes."""
        return self._chances(rows, nodes).swapaxes(0, 1).reshape(-1, CLASSES)

    def logs(self, rows: np.ndarray, classes: np.ndarray, nodes: np.ndarray | None = None) -> np.ndarray:
        """log10 of the chance of each token's class."""
        out = np.empty(len(classes))
        for part, z in self._sums(rows, nodes):
            own = z[classes[part] // SIDE, np.arange(z.shape[1]), classes[part] % SIDE].astype(np.float64)
            np.exp(z, out=z)
            out[part] = np.maximum((own - np.log(self._total(z))) / np.log(10), -30)
        return out

    def learn(self, rows: np.ndarray, classes: np.ndarray, squares: np.ndarray, nodes: np.ndarray | None = None) -> None:
        """One step; each weight's own step shrinks with the gradients it has had (``squares``)."""
        error = self._chances(rows, nodes)
        error.reshape(-1)[spot(classes, np.arange(len(classes)), len(classes))] -= 1
        places = self.places
        few = FEW * len(classes) < places
        kinds = []
        for k, kind in enumerate(rows):
            low = k * places
            used, at = np.unique(kind, return_inverse=True) if few else (slice(low, low + places), kind - low)
            kinds.append((used, at, len(used) if few else places))
        most = max(n for _, _, n in kinds)
        sums, roots = np.empty((most, SIDE), np.float32), np.empty((most, SIDE), np.float32)
        # all kinds of SIDE classes before the next ones, as the errors of these fit a near cache
        for wrong, weights, square in zip(error.view(np.complex64), self.weights, squares, strict=True):
            for used, at, n in kinds:
                total, root = sums[:n], roots[:n]
                total[:] = 0
                for two, own in zip(total.view(np.complex64).T, wrong.T, strict=True):
                    np.add.at(two, at, own)
                had = square[used]
                had += np.square(total, out=root)
                if few:
                    square[used] = had
                total *= RATE
                np.sqrt(np.add(had, 1, out=root), out=root)
                total /= root
                weights[used] -= total


@dataclass
class Tree:
    """The levels inside the classes; branch 0 of a class's root stands for its words beyond the tree."""

    #: words in order, and where each goes on each level; a row of branches for each level, -1 below a word
    words: np.ndarray
    branches: np.ndarray
    levels: list[ClassModel]

    @cached_property
    def find(self) -> Lookup:
        return Lookup(self.words)

    @staticmethod
    def _places(rank: np.ndarray) -> np.ndarray:
        """The branches of a class's words by their rank; a row for each level, -1 below a word and for what has no room.

        On each level but the last a node has INNER words (one less under the root) and as many nodes below it.
        """
        inner = CLASSES - INNER
        depth, room = 1, CLASSES - 1
        while room <= rank.max(initial=0) and depth < 4:
            room += -inner * inner ** (depth - 1) + inner**depth * CLASSES
            depth += 1
        out = np.full((depth, len(rank)), -1, np.int64)
        left, here = rank.copy(), np.arange(len(rank))
        for k in range(depth):
            nodes = inner**k
            words = CLASSES if k == depth - 1 else INNER
            held = nodes * words - (k == 0)
            ends = here[left[here] < held]
            place = left[ends]
            for level in range(k):
                out[level, ends] = INNER + place % inner
                place = place // inner
            out[k, ends] = place + (k == 0)
            here = here[left[here] >= held]
            left[here] -= held
        return out

    @staticmethod
    def of(head: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: np.ndarray, words: np.ndarray, places: int) -> Tree:
        """The tree without learnt weights; a class's words beyond the room of four levels count as not in the head."""
        names, counts, classes = head
        if not len(names):
            return Tree(names, np.zeros((0, 0), np.int64), [])
        order = np.lexsort((names, -counts, classes))
        first = run_starts(classes[order])
        rank = np.empty(len(names), np.int64)
        rank[order] = ranges(np.zeros(len(first), np.int64), np.diff(np.append(first, len(names))))
        branches = Tree._places(rank)
        held = branches[0] >= 0
        names, counts, classes, branches = names[held], counts[held], classes[held], branches[:, held]
        mass, node, levels = counts + SMOOTHING, classes.astype(np.int64), []
        here = np.arange(len(names))
        for k, branch in enumerate(branches):
            nodes = CLASSES * (CLASSES - INNER) ** k
            total = np.bincount(node * CLASSES + branch[here], weights=mass[here], minlength=nodes * CLASSES).reshape(-1, CLASSES)
            if k == 0:
                total[:, 0] = np.maximum(tokens + SMOOTHING * (words + 1) - total.sum(axis=1), SMOOTHING)
            total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
            bias = np.full(total.shape, -1e9, np.float32)
            np.log(total, out=bias, where=total > 0, casting="same_kind")
            levels.append(ClassModel.of(bias, places))
            if k + 1 < len(branches):
                on = branches[k + 1][here] >= 0
                node = node[on] * (CLASSES - INNER) + branch[here[on]] - INNER
                here = here[on]
        return Tree(names, branches, levels)

    def steps(self, places: tuple[np.ndarray, np.ndarray], classes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[ClassModel, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level: the model, its number, the tokens that come so far, their feature rows, nodes and branches.

        ``places`` says where the tokens stand among the words, and whether they do.
        """
        if not self.levels:
            return
        at, known = places
        here, node = None, classes
        for k, level in enumerate(self.levels):
            # all tokens come to the first level
            branch = np.where(known, self.branches[k][at], 0) if here is None else self.branches[k][at[here]]
            own = keys if here is None else keys[:, here]
            yield level, k, slice(None) if here is None else here, features_of(own, level.places, node + (k << 32)), node, branch
            if k + 1 < len(self.levels):
                on = np.flatnonzero(branch >= INNER)
                here, node = on if here is None else here[on], node[on] * (CLASSES - INNER) + branch[on] - INNER

    def gain(self, tokens: np.ndarray, classes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """What the words before change of log10 P(word | class), for each token."""
        return self.gain_at(self.find(tokens), classes, keys)

    def gain_at(self, places: tuple[np.ndarray, np.ndarray], classes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes))
        for level, _, here, rows, nodes, branch in self.steps(places, classes, keys):
            out[here] += level.logs(rows, branch, nodes) - level.bias[branch // SIDE, nodes, branch % SIDE] / np.log(10)
        return out


def _count(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    def counted() -> Iterator[np.ndarray]:
        for batch in text_slices(batches):
            tokens, classes, _ = tokens_of(batch.column("text"))
            order = np.argsort(tokens)
            first = run_starts(tokens[order])
            out = np.zeros(len(first), COUNTS)
            out["word"], out["n"], out["cls"] = tokens[order[first]], np.diff(np.append(first, len(tokens))), classes[order[first]]
            yield out

    yield from buckets.packed(counted(), "word", n_buckets, _add_counts)


def _add_counts(records: np.ndarray) -> np.ndarray:
    records = records[np.argsort(records["word"], kind="stable")]
    first = run_starts(records["word"])
    out = records[first].copy()
    if len(records):
        out["n"] = np.add.reduceat(records["n"], first)
    return out


def _sum_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, records in buckets.by_bucket(batches, COUNTS):
        own = _add_counts(records)
        sums = np.bincount(own["cls"], weights=own["n"], minlength=CLASSES).astype(np.int64)
        kinds = np.bincount(own["cls"], minlength=CLASSES)
        top = own[np.argsort(-own["n"], kind="stable")[:HEAD]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([bucket]),
                pa.array([own.tobytes()], pa.binary()),
                pa.array([sums.tolist()], pa.list_(pa.int64())),
                pa.array([kinds.tolist()], pa.list_(pa.int64())),
                pa.array([int(top["n"][-1])]),
            ],
            ["bucket", "records", "tokens", "words", "least"],
        )


def _head(batches: Iterable[pa.RecordBatch], above: int) -> Iterator[pa.RecordBatch]:
    for _, own in buckets.by_bucket(batches, COUNTS):
        own = own[own["n"] > above]
        yield pa.RecordBatch.from_arrays([pa.array(own["word"].view(np.int64)), pa.array(own["n"]), pa.array(own["cls"])], ["word", "n", "cls"])


def _train(batches: Iterable[pa.RecordBatch], model: ClassModel, tree: Tree) -> Iterator[pa.RecordBatch]:
    """A task's weights after its documents, in packed parts of all levels, and how many tokens it had."""
    before = [model, *tree.levels]
    own = [ClassModel(m.weights.copy(), m.bias) for m in before]
    grown = Tree(tree.words, tree.branches, own[1:])
    squares = [np.zeros_like(m.weights) for m in own]
    # tokens of each level of the tree that wait for a step
    waiting: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in grown.levels]

    def learn(k: int, least: int) -> None:
        if sum(len(nodes) for _, _, nodes in waiting[k]) >= least:
            rows, branch, nodes = (np.concatenate(x, axis=-1) for x in zip(*waiting[k], strict=True))
            grown.levels[k].learn(rows, branch, squares[k + 1], nodes)
            waiting[k].clear()

    seen = 0
    for batch in text_slices(batches):
        tokens, classes, first = tokens_of(batch.column("text"))
        keys, (at, known) = keys_of(tokens, first), grown.find(tokens)
        for a in range(0, len(tokens), STEP * model.places):
            part = slice(a, a + STEP * model.places)
            own[0].learn(features_of(keys[:, part], model.places), classes[part], squares[0])
            for _, k, _, rows, nodes, branch in grown.steps((at[part], known[part]), classes[part], keys[:, part]):
                waiting[k].append((rows, branch, nodes))
                learn(k, STEP * model.places if k else 1)
        seen += len(tokens)
    for k in range(len(waiting)):
        learn(k, 1)
    if seen:
        step = PLACES // 4 * CLASSES
        for k, (new, old) in enumerate(zip(own, before, strict=True)):
            # half precision on the way; the sum is in single precision
            changed = (new.weights - old.weights).astype(np.float16).ravel()
            parts = range(0, len(changed), step)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k * len(changed) + a for a in parts]),
                    pa.array([seen] * len(parts)),
                    pa.array([changed[a : a + step].tobytes() for a in parts], pa.binary()),
                ],
                ["part", "seen", "change"],
            )


def _average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each part of the weights over the tasks, by tokens."""
    totals: dict[int, np.ndarray] = {}
    seen: dict[int, int] = {}
    for batch in batches:
        for part, n, change in zip(*(batch.column(c).to_pylist() for c in ("part", "seen", "change")), strict=True):
            totals[part] = totals.get(part, 0) + np.frombuffer(change, np.float16).astype(np.float32) * n
            seen[part] = seen.get(part, 0) + n
    for part, total in totals.items():
        mean = (total / seen[part]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([mean.tobytes()], pa.binary())], ["part", "change"])


@dataclass(frozen=True)
class LanguageModel:
    classes: ClassModel
    #: distributed: the counts of all training words by bucket
    counts: DataFrame
    n_buckets: int
    #: words, counts and classes of the most frequent ones, sorted by word
    head: tuple[np.ndarray, np.ndarray, np.ndarray]
    #: inside the classes
    tree: Tree
    #: by class: tokens and distinct words in training
    tokens: np.ndarray
    words: np.ndarray


def train_language_model(docs: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> LanguageModel:
    """Train on all usable documents."""
    spark = docs.sparkSession
    everything = docs.select(column(text_column).alias("text"))
    n_buckets = buckets.bucket_count(everything)
    own = docs.where(usable).select(column(text_column).alias("text"), F.pmod(F.xxhash64(F.lit(11), id_column), F.lit(rounds)).alias("round"))
    counted = own.select("text").mapInArrow(partial(_count, n_buckets=n_buckets), buckets.SCHEMA)
    summed = buckets.gathered(counted, n_buckets).mapInArrow(
        _sum_counts, f"{buckets.SCHEMA}, tokens array<long>, words array<long>, least long"
    )
    counts = written(summed, "counts")
    totals = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("tokens", "words") for i in range(CLASSES)]
    found = counts.agg(*totals).first()
    tokens, words = (np.array([found[f"{c}{i}"] or 0 for i in range(CLASSES)], np.float64) for c in ("tokens", "words"))
    head = _most_frequent(counts)
    places = min(MOST_PLACES, max(PLACES, 1 << int(np.sqrt(tokens.sum())).bit_length() - 1)) if tokens.sum() else PLACES
    model = ClassModel.flat(tokens, places)
    tree = Tree.of(head, tokens, words, places)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((model, tree))  # KINDS * places * CLASSES floats for each level, and HEAD words
        # weights travel once for each trainer, so one gets a good many tokens
        trainers = min(TRAINERS, 1 + int(tokens.sum()) // (rounds * TRAINED))
        parts = own.where(F.col("round") == turn).select("text").coalesce(trainers)
        tried = parts.mapInArrow(lambda batches, shared=shared: _train(batches, *shared.value), "part long, seen long, change binary")
        mean = tried.repartition(KINDS * 4, "part").mapInArrow(_average, "part long, change binary").collect()
        weights = np.concatenate([m.weights.ravel() for m in (model, *tree.levels)])
        for r in mean:
            change = np.frombuffer(r["change"], np.float32)
            weights[r["part"] : r["part"] + len(change)] += change
        del mean
        each = [w.reshape(model.weights.shape) for w in np.split(weights, 1 + len(tree.levels))]
        model = ClassModel(each[0], model.bias)
        tree = Tree(tree.words, tree.branches, [ClassModel(w, old.bias) for w, old in zip(each[1:], tree.levels, strict=True)])
        shared.unpersist()
    return LanguageModel(model, counts.select("bucket", "records"), n_buckets, head, tree, tokens, words)


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most HEAD words: those above the smallest count that leaves no more."""
    rows = counts.select("bucket", "records")
    by_count = rows.mapInArrow(_count_sizes, "n long, words long").groupBy("n").agg(F.sum("words").alias("words")).orderBy(F.col("n").desc()).limit(HEAD + 1)
    above, room = 0, HEAD
    for r in by_count.collect():
        room -= r["words"]
        if room < 0:
            above = r["n"]
            break
    found = rows.mapInArrow(partial(_head, above=above), "word long, n long, cls int").toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], found.column("n").to_numpy()[order], found.column("cls").to_numpy()[order]


def _count_sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, own in buckets.by_bucket(batches, COUNTS):
        n, words = np.unique(own["n"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(words)], ["n", "words"])


@dataclass(frozen=True)
class _Scorer:
    """What a task needs to score."""

    classes: ClassModel
    tree: Tree
    head: tuple[np.ndarray, np.ndarray, np.ndarray]
    #: by class, log10 of the smoothed number of its tokens; the same for all tokens
    by_class: np.ndarray
    everything: float

    @cached_property
    def find(self) -> Lookup:
        return Lookup(self.head[0])

    def score(self, column: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums of each text with all other words taken as unseen, and the uses of those words."""
        tokens, classes, first = tokens_of(column)
        n = len(column)
        of = np.repeat(np.arange(n), np.diff(first))
        words, counts, _ = self.head
        at, known = self.find(tokens)
        # the tree holds all words of the head, or fewer
        inside, within = (at, known) if len(self.tree.words) == len(words) else self.tree.find(tokens)
        rare = np.log10(SMOOTHING)
        part = np.full(len(tokens), rare)
        if len(words):
            part[known] = np.log10(counts[at[known]] + SMOOTHING)
        model = np.empty(len(tokens))
        keys = keys_of(tokens, first)
        size = STEP * self.classes.places
        for a in range(0, len(tokens), size):
            step = slice(a, a + size)
            model[step] = self.classes.logs(features_of(keys[:, step], self.classes.places), classes[step])
            model[step] += self.tree.gain_at((inside[step], within[step]), classes[step], keys[:, step])
        sums = np.zeros(n, SUMS)
        sums["row"], sums["copies"], sums["tokens"] = row, 1, np.diff(first)
        sums["known"] = np.bincount(of, weights=known, minlength=n)
        sums["base"] = np.bincount(of, weights=part - self.everything, minlength=n)
        sums["score"] = np.bincount(of, weights=part + model - self.by_class[classes], minlength=n)
        uses = np.zeros((~known).sum(), USES)
        uses["word"], uses["row"], uses["times"] = tokens[~known], row[of[~known]], 1
        return sums, uses


def _add_uses(records: np.ndarray) -> np.ndarray:
    records = records[np.lexsort((records["row"], records["word"]))]
    first = run_starts(records["word"], records["row"])
    out = records[first].copy()
    if len(records):
        out["times"] = np.add.reduceat(records["times"], first)
    return out


def _score(batches: Iterable[pa.RecordBatch], scorer: _Scorer, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Sums of rows (kind 2) and uses of words that the head lacks (kind 1)."""
    sums: list[np.ndarray] = []

    def uses() -> Iterator[np.ndarray]:
        for batch in text_slices(batches):
            own, used = scorer.score(batch.column("text"), batch.column("row").to_numpy())
            sums.append(own)
            yield used

    def told(kind: int, packed: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packed:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), kind, np.int32)), *batch.columns], ["kind", *batch.schema.names])

    for batch in told(1, buckets.packed(uses(), "word", n_buckets, _add_uses)):
        yield batch
        if sums:
            own = np.concatenate(sums)
            sums.clear()
            yield from told(2, buckets.pack(own, own["row"].view(np.uint64), n_buckets))
    if sums:
        own = np.concatenate(sums)
        yield from told(2, buckets.pack(own, own["row"].view(np.uint64), n_buckets))


def _join_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of rows' sums: each bucket's counts (kind 0) come first, then uses of its words, then rows."""
    current = None
    for batch in batches:
        out = []
        for kind, bucket, records in zip(batch.column("kind").to_pylist(), batch.column("bucket").to_pylist(), batch.column("records"), strict=True):
            if bucket != current:
                current, counts = bucket, np.zeros(0, COUNTS)
            if kind == 0:
                counts = np.frombuffer(records.as_buffer(), COUNTS)
            elif kind == 1:
                out.append(_use_sums(np.frombuffer(records.as_buffer(), USES), counts))
            else:
                out.append(np.frombuffer(records.as_buffer(), SUMS))
        if out:
            sums = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(sums[c]) for c in SUMS.names], list(SUMS.names))


def _use_sums(uses: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What the counts of words add to their rows."""
    if not len(uses) or not len(counts):
        return np.zeros(0, SUMS)
    at = np.minimum(np.searchsorted(counts["word"], uses["word"]), len(counts) - 1)
    found = counts["word"][at] == uses["word"]
    uses, n = uses[found], counts["n"][at[found]]
    rows, of = np.unique(uses["row"], return_inverse=True)
    out = np.zeros(len(rows), SUMS)
    out["row"] = rows
    out["known"] = np.bincount(of, weights=uses["times"], minlength=len(rows))
    gain = np.bincount(of, weights=uses["times"] * (np.log10(n + SMOOTHING) - np.log10(SMOOTHING)), minlength=len(rows))
    out["base"] = out["score"] = gain
    return out


def score_documents(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with n_tokens, n_known, train_tokens, base_score (unigrams) and score, both log10 of a probability."""
    spark = docs.sparkSession
    n, v = model.tokens.sum(), model.words.sum()
    by_class = np.log10(model.tokens + SMOOTHING * (model.words + 1))
    scorer = _Scorer(model.classes, model.tree, model.head, by_class, float(np.log10(n + SMOOTHING * (v + 1))))
    shared = spark.sparkContext.broadcast(scorer)  # the weights, and HEAD words at most
    n_buckets = model.n_buckets
    key = F.xxhash64(column(id_column), column(text_column))
    texts = docs.select(key.alias("row"), column(text_column).alias("text"))
    scored = texts.mapInArrow(lambda batches: _score(batches, shared.value, n_buckets), f"kind int, {buckets.SCHEMA}")
    parts = scored.union(model.counts.select(F.lit(0).alias("kind"), "bucket", "records"))
    parts = parts.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "kind")
    sums = parts.mapInArrow(_join_counts, "row long, copies long, tokens long, known long, base double, score double")
    sums = sums.groupBy(F.col("row").alias("summed")).agg(*[F.sum(c).alias(c) for c in SUMS.names[1:]])
    joined = docs.select(whole_row(docs), key.alias("key")).join(sums, F.col("key") == F.col("summed"))
    added = {
        "n_tokens": (F.col("tokens") / F.col("copies")).cast("long"),
        "n_known": (F.col("known") / F.col("copies")).cast("long"),
        "train_tokens": F.lit(int(n)).cast("long"),
        "base_score": F.col("base") / F.col("copies"),
        "score": F.col("score") / F.col("copies"),
    }
    return unpacked(joined, docs, added)
