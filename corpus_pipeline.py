"""A training-data pipeline over `documents`: toxicity, line dedup, n-gram Jaccard join, secret scans and
best-fit packing, each over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import _text, jaccard, lines, packing, queries, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.3; the others go."""
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, model, 0.3)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs elsewhere. A document goes if nothing but such
    lines was in it; one that was empty before stays."""
    kept = lines.drop_recurring_lines(docs)
    empty = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(~F.coalesce(empty, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (0.8 or more of their 5-word shingles in common): the
    one with the smallest id. Of rows that agree in id and text one stays."""
    found = jaccard.jaccard_components(docs, size=5, percent=80)
    keepers = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keepers, "doc_id", "left_semi").withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by the kind in brackets."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, queries.WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact),
    ("best-fit packing", pack),
]

#: SQL can't express the model, the tokenizer or the packing; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each over the whole output of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _text.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
