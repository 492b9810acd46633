"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret scan, packing; each stage reads what its predecessor kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import common, op5_exact, op6_packing, op8_near, op9_secrets, op10_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the others go. A null or empty text has no words and goes; repeated rows share a verdict; a distance
    equal to a limit passes; texts are measured whole; an empty table stays empty; all columns, whatever their names, pass unchanged."""
    return op10_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the longest, then the smallest doc_id, null last; of rows that
    repeat both, one. Null, empty and blank texts are one group; texts are hashed whole; an empty table stays empty; all columns pass unchanged."""
    return op5_exact.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the smallest doc_id, null last, then the least digest of the text; of rows that repeat
    both, one. Null and empty texts are one class; texts are compared whole; an empty table stays empty; all columns pass unchanged."""
    return op8_near.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and n_chars, where there, following it. A null text stays null; overlapping findings
    are one mask; texts are scanned whole; repeated rows are masked alike; an empty table stays empty; other columns pass unchanged."""
    return op9_secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its sequence and place there. A null text is an empty document: its closing id alone; long
    texts are cut into pieces and all of them packed; repeated rows are packed each; an empty table gives no rows; only doc_id and text are read."""
    return op6_packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("secret scan", secrets),
    ("packing", packing),
]

#: Not expressible: near-duplicate hashing, a network's scores and the packing search; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's output is deleted when the next one's is written."""
    docs, last = common.read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{common.shared_folder(spark)}/stage{k}-{uuid.uuid4().hex}"
        with common.scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        common.delete(spark, [last] if last else [])
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
