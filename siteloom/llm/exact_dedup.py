"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Two texts are equal when they are identical after white space is deleted. A length or beginning that only one row has
ends the search for that row; the full hash reads the texts of the rows that are left. Which lengths and beginnings are
shared goes to the tasks as a map of bits of fixed size, so no text is shuffled to be compared.

Defined results: null counts as the empty text; all texts of white space only are equal; of equal texts the one with
most code points stays, then the smallest id, null ids last; of rows repeated with the same id one stays. Other columns
are kept and may have any name but the ones that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.llm.carried import column, unpacked, whole_row
from siteloom.sources.scratch import written

#: white space that does not count
BLANKS = " \t\n\x0b\f\r"
#: code points that the second step hashes
HEAD = 64
#: the map of shared lengths and beginnings: its bits (8 MB), and the bits of one of its rows, as Spark's bitmaps have them
MAP_BITS = 1 << 26
PART_BITS = 1 << 15
#: a group that holds this part of all rows or more (there are at most as many) meets its rows in several places
PARTS = 1000


def squeezed(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", head: int = HEAD) -> DataFrame:
    """One row for each group of two or more equal texts: text_sha256, keep_id, keep_chars, group_size."""
    return _groups(_with_full_hash(_rows(docs, id_column, text_column), _shared_beginnings(docs, text_column, head), head))


def _groups(hashed: DataFrame) -> DataFrame:
    whole = hashed.where("sha is not null")
    # the row that stays: the smallest id of each number of characters, then the one with most characters
    sizes = whole.groupBy("sha", "chars").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    groups = sizes.groupBy("sha").agg(F.max_by("id", "chars").alias("keep_id"), F.max("chars").alias("keep_chars"), F.sum("n").alias("group_size"))
    return groups.where("group_size > 1").select(F.col("sha").alias("text_sha256"), "keep_id", "keep_chars", "group_size")


def _steps(text: Column, head: int) -> list[Column]:
    """What the first two steps know of a text: its length and the hash of its beginning."""
    bare = squeezed(text)
    return [F.char_length(bare).alias("length"), F.xxhash64(F.substring(bare, 1, head)).alias("beginning")]


def _shared_beginnings(docs: DataFrame, text_column: str, head: int) -> DataFrame:
    """The lengths and beginnings of more than one row, marked in a map of ``MAP_BITS`` bits: part, bits.

    A key that no other row has may fall on a marked bit; its row is hashed in vain and found to be alone.
    """
    keys = written(docs.select(*_steps(column(text_column), head)), "lengths")
    lengths = keys.groupBy("length").count().where("count > 1").select("length")
    # counted before they meet the lengths: however many rows share a beginning, it is one row there
    shared = keys.groupBy("length", "beginning").count().where("count > 1").select("length", "beginning")
    part, bit = _place()
    marks = shared.join(lengths, "length", "left_semi").select(part.alias("part"), bit.alias("bit"))
    return written(marks.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")), "beginnings")


def _place() -> tuple[Column, Column]:
    """Where a length and beginning stand in the map: the part, and the bit inside it."""
    place = F.pmod(F.xxhash64("length", "beginning"), F.lit(MAP_BITS))
    return F.floor(place / PART_BITS).cast("long"), F.pmod(place, F.lit(PART_BITS)).cast("long")


def _with_full_hash(rows: DataFrame, shared: DataFrame, head: int) -> DataFrame:
    """The rows with length, beginning and ``sha``, the hash of the whole ``text`` where others share its beginning."""
    part, bit = _place()
    keyed = rows.select("*", *_steps(F.col("text"), head)).withColumn("of_part", part).withColumn("bit", bit)
    # at most MAP_BITS / PART_BITS parts of PART_BITS bits, however large the table
    met = keyed.join(F.broadcast(shared), F.col("of_part") == F.col("part"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1
    return met.withColumn("sha", F.when(marked, F.sha2(squeezed(F.col("text")), 256))).drop("of_part", "bit", "part", "bits")


def mark_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with text_sha256 (of the text without white space), keep_id, group_size and kept.

    The hash is a column of the result, so here it is made for every row; only hashes and numbers are compared.
    """
    groups = written(duplicate_groups(docs, id_column, text_column), "groups")
    rows = _marked(_rows(docs, id_column, text_column).withColumn("key", F.sha2(squeezed(F.col("text")), 256)), groups, docs.count())
    added = {"text_sha256": "key"} | {c: c for c in ("keep_id", "group_size", "kept")}
    return unpacked(rows, docs, {name: F.col(c) for name, c in added.items()})


def drop_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", head: int = HEAD) -> DataFrame:
    """The rows that stay, with their own columns; whole texts are hashed only where a length and beginning is shared."""
    hashed = _with_full_hash(_rows(docs, id_column, text_column), _shared_beginnings(docs, text_column, head), head)
    groups = written(_groups(hashed), "groups")
    # a row that shares no beginning has a key of its own, so such rows spread
    alone = F.concat_ws(" ", "length", "beginning")
    rows = hashed.withColumn("key", F.coalesce("sha", alone)).drop("sha", "length", "beginning")
    return unpacked(_marked(rows, groups, docs.count()).where("kept"), docs)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = column(text_column)
    chars = F.char_length(F.coalesce(text, F.lit("")))
    return docs.select(whole_row(docs), column(id_column).alias("id"), chars.alias("chars"), text.alias("text"))


def _marked(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """The rows (row, id, chars, key) with keep_id, group_size and kept."""
    # a place holds about a thousandth of all rows at most; ids tell which, so rows that repeat one stay together
    places = F.greatest(F.ceil(F.col("group_size") * PARTS / max(total, 1)), F.lit(1)).cast("long")
    sized = groups.withColumnRenamed("text_sha256", "of_key").withColumn("places", places)
    # at most PARTS rows, as group sizes add up to the rows of the table
    large = F.broadcast(sized.where("places > 1").select(F.col("of_key").alias("large_key"), "places"))
    spread = sized.withColumn("in_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1))).drop("places")
    rows = rows.select("row", "id", "chars", "key").join(large, F.col("key") == F.col("large_key"), "left")
    rows = rows.withColumn("place", F.coalesce(F.pmod(F.xxhash64("id"), F.col("places")), F.lit(0).cast("long")))
    marked = rows.join(spread, (F.col("key") == F.col("of_key")) & (F.col("place") == F.col("in_place")), "left")
    alone = F.col("of_key").isNull()
    stays = alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))
    # rows that repeat the id, too: the window's groups are the rows of one id and text
    turn = F.row_number().over(Window.partitionBy("key", "place", "id").orderBy(F.col("chars").desc()))
    return marked.select(
        "row",
        "key",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (stays & (turn == 1)).alias("kept"),
    )
