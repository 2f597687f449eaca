"""Mixing sources to target weights: fixed blocks of words, drawn for output shards, found through permutations.

Each source is one stream of its documents' words, cut into blocks of ``block`` words. A source's share of the mix is a
number of slots. Lot by lot, multinomial counts say how many slots of a source each output shard gets, and the lot's slots
are dealt out by those counts in order. Slot j of a pass takes block perm(j), where perm is a keyed permutation of the
source's blocks (swap-or-not), and slots join blocks by that index. A new pass begins when all blocks are taken; the last
slot is cut so that each source gives its target to the word. The mix comes as documents (``mixed_documents``) or shard by
shard (``mixed_shards``, ``write_shards``).

Defined results: a null source is one source, last in order; empty or null texts have size 0 and give nothing; repeated
rows are documents of their own; an empty table gives an empty mix. Every draw comes from hashes: reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.carried import column, whole_row
from siteloom.llm.running import with_total_before
from siteloom.sources.scratch import written

#: words that are not white space
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_PASSES = 2
BLOCK = 64
SHARDS = 16
ROUNDS = 8


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_PASSES
) -> DataFrame:
    """From (source, source_size): the words each source shall give.

    Sources share ``share`` of all words by weight; one that would give more than ``most`` times its words stops there,
    and the others share the rest by weight. Sorted by how soon they stop, the sources that stop are the first ones, so
    running sums over the sources settle it in one go.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    soonest = Window.orderBy("_stop", F.col("source").asc_nulls_last())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    onward = soonest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    most_words = F.col("source_size") * F.lit(float(most))
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(most_words).over(before), F.lit(0.0))) / F.sum("_weight").over(onward)
    ranked = sizes.withColumn("_weight", weight.cast("double")).withColumn("_stop", most_words / F.col("_weight"))
    levelled = ranked.withColumn("_level", level)
    # the first source in that order that the level doesn't stop sets the level for all
    settled = F.min(F.when(F.col("_level") <= F.col("_stop"), F.struct("_stop", "_level"))).over(everything)["_level"]
    target = F.least(most_words, F.coalesce(settled * F.col("_weight"), most_words))
    return levelled.select("source", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """The place of an index in a keyed permutation of 0 .. n - 1.

    In each round an index trades places with its partner, or not, by a hash. The rounds are folded by a lambda: written
    out, each would repeat the terms of the one before.
    """

    def trade(place: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - place, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(place, partner)), F.lit(2)) == 1, partner).otherwise(place)

    order = reversed(range(rounds)) if inverse else range(rounds)
    return F.aggregate(F.array(*map(F.lit, order)), index, trade)


@dataclass(frozen=True)
class Mix:
    """What a mix is made of."""

    #: one row for each document: doc_id, source, print (of its text), size, begins (in its source's stream), source_size, target
    places: DataFrame
    #: the drawn blocks: source, turn (pass over the source), slot, shard, block, words (taken from the block's beginning)
    slots: DataFrame
    #: for each document of size over 0 and drawn block: source, begins, turn, shard, and the words taken (start, end)
    takes: DataFrame

    def taken(self) -> DataFrame:
        """The places with the number of words the mix takes of each document, and of the shards that get some."""
        words = self.takes.groupBy(F.col("source").alias("_source"), F.col("begins").alias("_begins")).agg(
            F.sum(F.col("end") - F.col("start")).alias("_taken"), F.size(F.collect_set("shard")).cast("long").alias("_shards")
        )
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("begins") == F.col("_begins")) & (F.col("size") > 0)
        found = [F.coalesce(f"_{c}", F.lit(0)).cast("long").alias(c) for c in ("taken", "shards")]
        return self.places.join(words, same, "left").select(*self.places.columns, *found)

    def shard_counts(self) -> DataFrame:
        """For each shard and source that gives it some: the drawn blocks and their words."""
        return self.slots.groupBy("shard", "source").agg(F.count("*").alias("blocks"), F.sum("words").alias("words"))


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = 17,
) -> Mix:
    """Draw a mix of all documents."""
    sized = docs.select(
        column(id_column).alias("doc_id"),
        column(source_column).alias("source"),
        text_print(column(text_column)).alias("print"),
        word_count(column(text_column)).alias("size"),
    )
    sized = written(sized, "sizes")
    # one row for each source
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    streams = with_total_before(sized, ["source"], ["doc_id", "print", "size"], F.col("size"), "begins")
    known = targets.select(F.col("source").alias("_source"), "source_size", "target")
    places = written(streams.join(known, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "places")
    slots = draw_slots(targets, block, shards, seed)
    return Mix(places, slots, _take(places, slots, block))


def text_print(text: Column) -> Column:
    return F.xxhash64(text)


def draw_slots(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 17, together: int = 4096) -> DataFrame:
    """The drawn blocks of every source, ``together`` slots to a row before they spread over the cluster."""
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST_PASSES)
    turns = targets.where("source_size > 0").select(
        "source",
        blocks.alias("n"),
        (F.col("source_size") - (blocks - 1) * block).alias("short"),
        words.alias("words"),
        "source_size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(words / F.col("source_size")))).alias("turn"),
    )
    turns = turns.withColumn("wanted", F.least(F.col("source_size"), F.col("words") - F.col("turn") * F.col("source_size"))).where("wanted > 0")
    key = F.xxhash64(F.lit(seed), "source", "turn")
    turns = turns.withColumn("key", key).withColumn("short_slot", permuted(F.col("n") - 1, F.col("n"), F.col("key"), inverse=True))
    # the short block may come early, so one block more than the words fill
    needed = F.least(F.col("n"), F.floor(F.col("wanted") / block) + 2)
    rows = turns.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((needed - 1) / together))))
    # a row grows 4096-fold here, so the spread has a fixed width: joined again by their bytes, all would fall to one task
    width = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "source", "turn", "lot")
    numbers = F.sequence(F.col("lot") * together, F.least(needed, (F.col("lot") + 1) * together) - 1)
    # a draw for each slot is a multinomial sample; sorted, it is the counts, dealt out to the slots shard by shard
    draws = F.sort_array(F.transform(numbers, lambda number: F.pmod(F.xxhash64("key", number), F.lit(shards))))
    rows = rows.select("*", F.posexplode(draws).alias("at", "shard")).withColumn("slot", F.col("lot") * together + F.col("at"))
    before = F.col("slot") * block - F.when(F.col("short_slot") < F.col("slot"), block - F.col("short")).otherwise(0)
    held = F.when(F.col("short_slot") == F.col("slot"), F.col("short")).otherwise(F.lit(block))
    return rows.select(
        "source",
        "turn",
        "slot",
        "shard",
        permuted(F.col("slot"), F.col("n"), F.col("key")).alias("block"),
        F.least(held, F.col("wanted") - before).alias("words"),
    ).where("words > 0")


def _take(places: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Join blocks by index: which words of which document each drawn block gives."""
    last = F.col("begins") + F.col("size") - 1
    blocks = places.where("size > 0").select(
        "source", "begins", "size", F.explode(F.sequence(F.floor(F.col("begins") / block), F.floor(last / block))).alias("index")
    )
    drawn = slots.select(F.col("source").alias("_source"), "turn", "shard", "block", "words")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("index") == F.col("block"))
    start = F.greatest(F.col("index") * block - F.col("begins"), F.lit(0))
    end = F.least(F.col("index") * block + F.col("words") - F.col("begins"), F.col("size"))
    # sizes of drawn rows can't be told in advance, so Spark must not take them for small
    return blocks.join(drawn.hint("merge"), same).select("source", "begins", "turn", "shard", start.alias("start"), end.alias("end")).where("end > start")


def mixed_documents(docs: DataFrame, mix: Mix, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The mix as documents: for each document and pass, the words it takes, with the columns of ``docs``.

    A text that a pass takes whole stays as it is; of others the taken words are joined by one space.
    """
    return _cut(docs, mix, id_column, text_column, [])


def mixed_shards(docs: DataFrame, mix: Mix, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The mix by output shard: for each shard, document and pass the words that it takes, with ``shard`` and the columns of
    ``docs``; a column of theirs with that name gives way."""
    return _cut(docs, mix, id_column, text_column, ["shard"])


def write_shards(docs: DataFrame, mix: Mix, path: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Write the mix with a folder for each output shard."""
    mixed_shards(docs, mix, id_column, text_column).write.partitionBy("shard").parquet(path)


def _cut(docs: DataFrame, mix: Mix, id_column: str, text_column: str, apart: list[str]) -> DataFrame:
    """The words that documents give to each pass, and further ``apart`` by columns of the takes."""
    pieces = mix.takes.groupBy(F.col("source").alias("from_source"), F.col("begins").alias("from_place"), "turn", *apart).agg(
        F.sum(F.col("end") - F.col("start")).alias("words"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("pieces")
    )
    same_place = F.col("source").eqNullSafe(F.col("from_source")) & (F.col("begins") == F.col("from_place")) & (F.col("size") > 0)
    # rows that repeat are told apart by a number on either side
    copy = F.row_number().over(Window.partitionBy("doc_id", "print").orderBy("begins"))
    places = mix.places.where("size > 0").withColumn("copy", copy)
    parts = places.join(pieces, same_place).select(*apart, "doc_id", "print", "copy", "words", "pieces", F.col("words").eqNullSafe(F.col("size")).alias("whole"))
    texts = docs.select(whole_row(docs), column(id_column).alias("id"), column(text_column).alias("text"), text_print(column(text_column)).alias("text_print"))
    texts = texts.withColumn("number", F.row_number().over(Window.partitionBy("id", "text_print").orderBy("id")))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("text_print") == F.col("print")) & (F.col("number") == F.col("copy"))
    joined = texts.join(parts, same).withColumn("list", F.when(~F.col("whole"), F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    cut = F.flatten(F.transform("pieces", lambda p: F.slice(F.col("list"), p["start"].cast("int") + 1, (p["end"] - p["start"]).cast("int"))))
    text = F.when(F.col("whole"), F.col("text")).otherwise(F.array_join(cut, " "))
    own = [text.alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in apart]
    return joined.select(*apart, *own)
