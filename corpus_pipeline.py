"""A corpus pipeline: each stage gets the documents that the stage before it kept.

Every stage is written as Parquet below the shared folder and read again, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm import byte_bpe, decontamination, language_id, ngram_join, toxicity
from roadpulse.llm.common import free_name, read
from roadpulse.llm.queries import language_model, toxicity_model
from roadpulse.session import shared_folder, ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language_id.reject(docs, language_model(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    return toxicity.reject(docs, toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least id."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.reject(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, little-endian unsigned 32-bit integers, and their number, beside all columns of `docs` (a taken
    name gets an underscore)."""
    encoded = byte_bpe.encode(docs)
    return encoded.withColumn(free_name(encoded, "n_tokens"), (F.octet_length(encoded.columns[-1]) / 4).cast("long"))


#: Rows that travel to a Python worker at a time. Texts are long, and Spark and the worker each hold a batch whole.
BATCH_ROWS = 1_000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bound_batches(spark: SparkSession) -> None:
    """Let batches of more than BATCH_ROWS rows be cut; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_ROWS_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_ROWS_SETTING, str(BATCH_ROWS))


def _shipped(stage: Stage) -> Stage:
    """The stage, with the package sent to the workers first and the batches they get bounded."""

    @functools.wraps(stage)
    def made(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        _bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return made


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _shipped(identify_language)),
    ("toxicity", _shipped(drop_toxic)),
    ("near_duplicates", _shipped(drop_near_duplicates)),
    ("decontamination", _shipped(drop_contaminated)),
    ("tokenization", _shipped(tokenize)),
]

#: The fitted stages have no form in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
