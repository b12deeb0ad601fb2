"""The queries opN_<name>: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import bpe, collocations, embeddings, fingerprints, jaccard, licenses, lines, merkle, packing, quality, secrets, sql, substring, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_documents(spark, sf_dir))
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
        F.size("spans").alias("n_spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.apply_policy(quality.quality_ledger(_documents(spark, sf_dir)), "v2")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.policy_mask("v1"))) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits",
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.bpe_encode(_documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN, decode=True)
    return decoded.select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_documents(spark, sf_dir))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.drop_repeated_substrings(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_recurring_lines(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.BASE]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), WORDS)


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    model = toxicity.fit_toxicity(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(documents, model).select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against leaves of which a third were tampered with."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle.leaf_digest([merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in fields])
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    claimed = F.when(changed, tampered).otherwise(merkle.leaf_digest([F.col(c) for c in fields]))
    found = merkle.merkle_manifest(_documents(spark, sf_dir), fields, claims={"claimed": claimed})
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    return fingerprints.compare_edits(_documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best pairs and triples of each language."""
    return collocations.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (op1_licenses, op2_quality, op3_bpe, op4_jaccard, op5_substrings, op6_lines, op7_secrets, op8_packing, op9_embeddings, op10_toxicity, op11_merkle, op12_fingerprints, op13_collocations)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
