"""Keyword triage of free-text messages.

With one set of words for all messages it is a projection, so it never shuffles. Words can also be a table, with rows for
each language: then every message is read once for all words of its language, by one pattern that a join brings to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import vocabulary as v
from siteloom.functions.scalars import strip


@dataclass(frozen=True)
class TriageWords:
    """Keyword lists; replace them to work in another language."""

    block: list[str] = field(default_factory=lambda: v.WORDS_BLOCK)
    urgent: list[str] = field(default_factory=lambda: v.WORDS_URGENT)
    material: list[str] = field(default_factory=lambda: v.WORDS_MATERIAL)
    decision: list[str] = field(default_factory=lambda: v.WORDS_DECISION)
    completion: list[str] = field(default_factory=lambda: v.WORDS_COMPLETION)


#: the lists of words by name; a list's place here is its bit
LISTS = list(TriageWords.__dataclass_fields__)

#: bytes of patterns and words up to which a table of words is sent to all executors; a larger one is joined by language
SMALL_WORDS = 4 << 20


def _mentions(lowered: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(lowered, F.lit(word))
    return hit


def message_title(message: Column) -> Column:
    """First sentence, at most 80 characters; a leading dot gives an empty title."""
    stripped = F.coalesce(strip(message), F.lit(""))
    first = F.substring(F.split_part(stripped, F.lit("."), F.lit(1)), 1, v.TITLE_LENGTH)
    return F.when(stripped == "", F.lit(v.TITLE_DEFAULT)).otherwise(first)


def triage(messages: DataFrame, message_col: str = "testo", words: TriageWords = TriageWords()) -> DataFrame:
    """Add tipo, priorita, stato, impatto and titolo to each message.

    The five keyword flags are computed once per row and then combined.
    """
    lowered = F.lower(F.coalesce(F.col(message_col), F.lit("")))
    return _sorted_out(messages, message_col, {name: _mentions(lowered, getattr(words, name)) for name in LISTS})


def _sorted_out(messages: DataFrame, message_col: str, flags: dict[str, Column]) -> DataFrame:
    flagged = messages.withColumn("_f", F.struct(*[flag.alias(name) for name, flag in flags.items()]))
    block, urgent, material, decision, completion = (F.col(f"_f.{n}") for n in flags)
    return flagged.withColumns(
        {
            "tipo": F.when(completion, v.TYPE_COMPLETION)
            .when(block, v.TYPE_BLOCK)
            .when(decision, v.TYPE_DECISION)
            .when(material, v.TYPE_MATERIAL)
            .otherwise(v.TYPE_PROGRESS),
            "priorita": F.when(completion, v.PRIORITY_DEFAULT)
            .when(block & urgent, v.PRIORITY_CRITICAL)
            .when(block | urgent, v.PRIORITY_HIGH)
            .otherwise(v.PRIORITY_DEFAULT),
            "stato": F.when(block & ~completion, v.TICKET_BLOCKING).otherwise(v.TICKET_OPEN),
            # a material word wins over a decision word here, unlike in the type
            "impatto": F.when(completion, v.IMPACT_COMPLETION)
            .when(block, v.IMPACT_BLOCK)
            .when(material, v.IMPACT_MATERIAL)
            .when(decision, v.IMPACT_DECISION)
            .otherwise(""),
            "titolo": message_title(F.col(message_col)),
        }
    ).drop("_f")


# --- words as a table --------------------------------------------------------
def word_table(spark: SparkSession, words: TriageWords = TriageWords(), language: str | None = None) -> DataFrame:
    """The rows (lingua, elenco, parola) of a set of words."""
    rows = [(language, name, word) for name in LISTS for word in getattr(words, name)]
    return spark.createDataFrame(rows, "lingua string, elenco string, parola string")


def word_patterns(words: DataFrame) -> DataFrame:
    """One row for each language of a word table: ``lingua``, ``modello`` and ``elenchi``.

    ``modello`` is a pattern that matches, without consuming anything, wherever a word of the language begins; its group
    holds the longest such word. ``elenchi`` maps each word to the bits of its own lists and of those of all words that it
    begins with, which the group hides. A null language is written as empty. Case does not matter; empty and null words and
    lists other than the five are left out, repeated rows count once.
    """
    place = F.array_position(F.array(*[F.lit(name) for name in LISTS]), F.col("elenco")).cast("int")
    rows = words.select(
        F.coalesce("lingua", F.lit("")).alias("lingua"), F.lower("parola").alias("parola"), F.call_function("shiftleft", F.lit(1), place - 1).alias("bit")
    ).where((F.col("parola") != "") & (place > 0))
    own = rows.groupBy("lingua", "parola").agg(F.bit_or("bit").alias("bits"))
    length = F.char_length("parola")
    heads = own.select("lingua", "parola", F.explode(F.sequence(F.lit(1), length)).alias("n")).select(
        "lingua", "parola", F.col("parola").substr(F.lit(1), F.col("n")).alias("inizio")
    )
    begun = own.select(F.col("lingua").alias("_lingua"), F.col("parola").alias("_parola"), "bits")
    closed = (
        heads.join(begun, (F.col("lingua") == F.col("_lingua")) & (F.col("inizio") == F.col("_parola")))
        .groupBy("lingua", "parola")
        .agg(F.bit_or("bits").alias("bits"))
    )
    entry = F.struct(length.alias("n"), "parola", "bits")
    listed = closed.groupBy("lingua").agg(F.sort_array(F.collect_list(entry), asc=False).alias("voci"))
    # a quoted word ends at the first end of a quotation, so one inside it is written outside
    quoted = F.transform("voci", lambda x: F.concat(F.lit(r"\Q"), F.replace(x["parola"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return listed.select(
        "lingua",
        F.concat(F.lit("(?=("), F.array_join(quoted, "|"), F.lit("))")).alias("modello"),
        F.map_from_entries(F.transform("voci", lambda x: F.struct(x["parola"], x["bits"]))).alias("elenchi"),
    )


def triage_by_language(messages: DataFrame, words: DataFrame, message_col: str = "testo", language_col: str = "lingua") -> DataFrame:
    """As ``triage``, with the words of each message's language from a table (lingua, elenco, parola).

    A message without a language, or all of them where there is no such column, takes the words that have none; one whose
    language has no words mentions none. The words are sent to the messages if they are few, whatever the estimates say.
    """
    patterns = word_patterns(words).select(F.col("lingua").alias("_lingua"), F.col("modello").alias("_modello"), F.col("elenchi").alias("_elenchi"))
    size = words.agg(F.sum(F.octet_length("parola") + 16).alias("n")).first()["n"] or 0
    if size <= SMALL_WORDS:
        patterns = F.broadcast(patterns)
    # empty, but a value of the row: a constant would turn the join by equality into nested loops
    none = F.coalesce(F.substring(F.col(message_col), 1, 0), F.lit(""))
    language = F.coalesce(F.col(language_col), F.lit("")) if language_col in messages.columns else none
    joined = messages.withColumn("_key", language).join(patterns, F.col("_key") == F.col("_lingua"), "left")
    lowered = F.lower(F.coalesce(F.col(message_col), F.lit("")))
    hits = F.array_distinct(F.regexp_extract_all(lowered, F.col("_modello"), F.lit(1)))
    bits = F.aggregate(hits, F.lit(0), lambda all_bits, hit: all_bits.bitwiseOR(F.element_at(F.col("_elenchi"), hit)))
    marked = joined.withColumn("_bits", F.coalesce(bits, F.lit(0)))
    flags = {name: F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(LISTS)}
    return _sorted_out(marked, message_col, flags).drop("_key", "_lingua", "_modello", "_elenchi", "_bits")
