"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept and returns documents again (doc_id, text, lang, source,
n_chars); the last returns pieces of tokens. Quality: documents that the classifier rejects go. Near-duplicates: of each
class, the document of the least id stays. Decontamination: documents with a leak of a benchmark item go. Secrets: each
is replaced in the text by its kind in brackets, and n_chars follows. Packing: token sequences of power-of-two lengths.

Defined results: null and empty texts are rejected by the classifier wherever any row is trusted; without trusted rows all
documents pass it. Of rows that are equal in id and text one stays, of several texts with one id those of other classes stay
each. A null id stays null. A null benchmark text matches nothing. Other columns than those of documents are not carried. An
empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, near_dedup, packing, quality, secrets, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.representatives(docs.select(COLUMNS))


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs.select(COLUMNS), ["lang", "source", "n_chars"])
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _quality),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("secrets", _secrets),
    ("packing", _packing),
]
#: SQL can't express a Kneser-Ney fit, sampling, or tokenisation; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.table(docs)
    return docs
