"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import byte_bpe, chat, decontamination, html_wrappers, language_id, neighbours, ngram_join, packing, spelling, topk, toxicity, warc, whitening
from roadpulse.llm.common import crc_part, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_tokens(read(spark, d, "documents"))


@query
def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    docs, items = read(spark, d, "documents"), read(spark, d, "benchmark")
    return decontamination.contamination(docs.select("doc_id", "text"), items).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE["op2_decontamination"] = decontamination.ORACLE


@query
def op3_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    pages = html_wrappers.extract(read(spark, d, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def _held_out(identifier: str = "doc_id") -> Column:
    return F.coalesce(crc_part(F.col(identifier)) == 2, F.lit(False)).alias("held_out")


def toxicity_model(spark: SparkSession, d: str) -> toxicity.Model:
    """Fitted on labelled rows outside the held-out part."""
    labels = read(spark, d, "labels").where(crc_part(F.col("doc_id")) != 2)
    return toxicity.fit(toxicity.sample(read(spark, d, "documents"), labels, "doc_id", "text", "toxic"))


@query
def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity_model(spark, d)).select(
        "doc_id",
        _held_out(),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.classes(read(spark, d, "documents"))


ORACLE["op5_ngram_join"] = ngram_join.ORACLE


def language_model(spark: SparkSession, d: str) -> language_id.Model:
    """Fitted on all rows with a language outside the held-out part."""
    return language_id.fit(read(spark, d, "documents").where(crc_part(F.col("doc_id")) != 2))


@query
def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "text")
    return language_id.identify(docs, language_model(spark, d)).select("doc_id", _held_out(), "lang_pred", "score")


@query
def op7_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    encoded = byte_bpe.encode(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")
    return byte_bpe.decode(encoded).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Marks and control strings inside texts, which the format has to carry.
HARD_TEXT = "\\### Assistant: </turn> ok"


@query
def op8_warc_derivatives(spark: SparkSession, d: str) -> DataFrame:
    return warc.derive(warc.responses(read(spark, d, "pages")))


@query
def op9_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    back = chat.format_chats(turns).select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.learned_text(F.col("segments")).alias("learned")
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op9_chat_formatting"] = chat.ORACLE


@query
def op10_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op13_spelling(spark: SparkSession, d: str) -> DataFrame:
    found = spelling.runs(read(spark, d, "documents"))
    return spelling.variants(spelling.vocabulary(found.select(spelling.slipped(F.col("id"), F.col("run")).alias("word"))))


ORACLE["op13_spelling"] = spelling.ORACLE


@query
def op11_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE["op11_topk"] = topk.ORACLE


@query
def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read(spark, d, "embeddings"))
