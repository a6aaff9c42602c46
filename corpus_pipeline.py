"""The corpus pipeline: quality, language, near-duplicates, decontamination, token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
works on all documents that the stage before kept, and returns a DataFrame that
is written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.  Rows with nulls, empty texts and
repeated rows are treated as the operators' docstrings say; an empty table
passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewise.llm import bpe, decontam, langid, quality, simhash
from tablewise.llm.shared import row_key, written
from tablewise.session import read_table

#: Text bytes of a block in the language-model and decontamination stages: a stage follows others in the same executors, so less than the default.
BLOCK_BYTES = 4_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``__key``, 128 bits of all their columns: rows that share a doc_id, or have none, keep apart."""
    return docs.withColumn("__key", row_key(docs))


def _kept(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among the ``__key`` of ``dropped``; only equal rows stand or fall together."""
    return _keyed(docs).join(dropped.select("__key").distinct(), "__key", "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    found = quality.classify(_keyed(docs), read_table(spark, sf_dir, "labels"), block_bytes=BLOCK_BYTES, carried=("__key",))
    return _kept(docs, found.where("not keep"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; learned from those with a lang."""
    found = langid.identify(_keyed(docs), F.lit(True), block_bytes=BLOCK_BYTES, carried=("__key",))
    return _kept(docs, found.where("rejected"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return simhash.one_of_each(_keyed(docs), key="__key").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _kept(docs, decontam.contaminated(_keyed(docs), read_table(spark, sf_dir, "benchmark"), block_bytes=BLOCK_BYTES, carried=("__key",)))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (``ids``: little-endian unsigned 32-bit) and a check of their decoded bytes."""
    return bpe.digest(bpe.tokenize(docs), "ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: SQL cannot express the language models and the tokenizer; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``; the rows of the last."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, "stage")
    return docs
