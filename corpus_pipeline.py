"""A training corpus from documents: language ID, exact and near dedup, mixing of sources, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.exact_dedup import drop_duplicates
from siteloom.llm.language_id import UNKNOWN, fit_languages, predict_languages
from siteloom.llm.mixing import mix_sources, mixed_documents
from siteloom.llm.packing import pack_documents
from siteloom.llm.queries import fold, prepare, table, tokenizer
from siteloom.llm.shingle_join import drop_near_duplicates
from siteloom.sources.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; where ``lang`` is null, the predicted one, or null if no language could be learnt."""
    prepare(spark)
    model = fit_languages(docs, fold("doc_id", 3) != 1)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = predict_languages(docs, model, lang_name="predicted language", score_name="language score")
    found = found.where(F.col("predicted language") != UNKNOWN)
    lang = F.coalesce("lang", "predicted language").alias("lang")
    return found.select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle links connect."""
    prepare(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, one row for each pass over it."""
    prepare(spark)
    mixed = mixed_documents(docs, mix_sources(docs))
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None
    return mixed.select(*[n_chars if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of a document in sequences of 1024 tokens."""
    prepare(spark)
    return pack_documents(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL can express neither the trained language model nor the tokenizer
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
