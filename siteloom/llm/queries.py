"""The operators as queries over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.byte_bpe import decode_ids, encode_texts
from siteloom.llm.embedding_dedup import link_embeddings
from siteloom.llm.exact_dedup import mark_duplicates
from siteloom.llm.hard_negatives import mine_hard_negatives
from siteloom.llm.language_id import fit_languages, predict_languages
from siteloom.llm.language_model import score_documents, train_language_model
from siteloom.llm.mixing import mix_sources
from siteloom.llm.packing import pack_documents
from siteloom.llm.periodic_runs import periodic_runs, run_lines, strongest_run
from siteloom.llm.shingle_join import shingle_components
from siteloom.llm.substring_dedup import duplicate_spans, remove_duplicate_spans
from siteloom.llm.token_counts import section_tokens
from siteloom.llm.toxicity import fit_toxicity, labelled_texts, score_toxicity
from siteloom.session import tune

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """The session's settings, with small batches for Python: texts may be long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_hash(id_column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")))


def fold(id_column: str, n: int) -> Column:
    """The remainder that keeps rows out of training."""
    return F.pmod(id_hash(id_column), F.lit(n))


def looped_text(id_column: str, text_column: str) -> Column:
    """The text; where the id's hash ends with 0, its words from some place on go round in a period drawn from that hash."""
    g = F.floor(id_hash(id_column) / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        rounds = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(rounds), F.lit(1), n - a)), " ")

    found = F.regexp_extract_all(F.coalesce(text_column, F.lit("")), F.lit(WORD), F.lit(0))
    # the words are bound to a name, so that they are found once
    once = F.get(F.transform(F.array(found), lambda words: F.when(F.size(words) > 0, looped(words)).otherwise(F.lit(""))), F.lit(0))
    return F.when(F.pmod(id_hash(id_column), F.lit(10)) == 0, once).otherwise(F.col(text_column))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepare(spark), folder)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), tokenizer())


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_toxicity(labelled_texts(docs, table(spark, folder, "labels"), fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    scored = score_toxicity(rows, model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return section_tokens(table(spark, folder, "documents"), tokenizer())


@query
def op4_shingle_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingle_components(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    marked = mark_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query
def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mix_sources(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken", "shards")


@query
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train_language_model(docs, fold("doc_id", 10) != 0)
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = remove_duplicate_spans(docs, duplicate_spans(docs))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs, fold("doc_id", 3) != 1)
    rows = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    return predict_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return link_embeddings(table(spark, folder, "embeddings"))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", looped_text("doc_id", "text").alias("text"))
    rows = periodic_runs(docs, columns=["doc_id"]).withColumn("best", strongest_run(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, folder, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0, label_column=label)


@query
def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer(RANKS)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    decoded = decode_ids(encode_texts(docs, path).select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
