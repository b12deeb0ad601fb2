"""Quality rules as a bitmask ledger: every rule is evaluated once for each document, its failure bit
and measurements are kept, and versioned policies and ablations are bit arithmetic over the ledger.

The ledger is built inside the tasks that read the documents, without a shuffle. A null text counts as
empty; an empty text fails the rule too_few_words. Rows are independent of each other, so repeated
and null ids give one row for each input row."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _text

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs"]
_ARROW = pa.schema([(c, pa.int64()) for c in ["doc_id", *MEASURES]])



#: Rules in the order of their bits; new ones go at the end.
RULE_NAMES = ["too_few_words", "repeated_windows", "many_symbols", "many_duplicate_lines", "odd_word_length", "many_exclamations"]


def rules() -> dict[str, Column]:
    """Rule name -> condition of failure, in the order of their bits."""
    c = F.col
    return {
        "too_few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "many_symbols": 10 * c("n_symbols") > c("n_words"),
        "many_duplicate_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "odd_word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words")),
        "many_exclamations": 2 * c("n_bangs") > c("n_words"),
    }


#: Versioned policies: the rules that reject a document.
POLICIES = {
    "v1": ["too_few_words", "repeated_windows"],
    "v2": ["too_few_words", "repeated_windows", "many_symbols", "many_duplicate_lines", "odd_word_length", "many_exclamations"],
}


def policy_mask(version: str) -> int:
    """The bits of a policy's rules."""
    return sum(1 << RULE_NAMES.index(x) for x in POLICIES[version])


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words in windows of `size` words that occur twice or more in the text, first ones included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    first = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    runs = first[:n]
    for k in range(1, size):
        runs = np.unique(runs, return_inverse=True)[1] * len(seen) + first[k : k + n]
    _, back, counts = np.unique(runs, return_inverse=True, return_counts=True)
    often = np.flatnonzero(counts[back] > 1)
    if not len(often):
        return 0
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, often, 1)
    np.add.at(edges, often + size, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure_text(text: bytes) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    words = text.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        sum(text.count(s.encode()) for s in SYMBOLS),
        dup,
        repeated_words(words),
        lines,
        text.count(b"!"),
    )


def quality_ledger(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its measures and fail_bits, one bit for each failed rule."""

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        rows = [measure_text(t) for t in _text.as_bytes(batch.column("text"))]
        columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
        return {"doc_id": batch.column("doc_id").to_pylist(), **{c: list(v) for c, v in zip(MEASURES, columns, strict=True)}}

    schema = ", ".join(f"{c} long" for c in _ARROW.names)
    measured = _text.map_texts(_text.texts_of(documents, id_col, text_col), kernel, schema, _ARROW)
    bits = [F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)) for k, failed in enumerate(rules()[name] for name in RULE_NAMES)]
    return measured.withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(ledger: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with `kept`: whether no rule of the policy failed. Texts are not read again."""
    return ledger.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablation(ledger: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects.
    An empty ledger gives zeros."""
    mask = policy_mask(version)
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask))
    sums = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(failed.bitwiseAND(F.lit(1 << k)) != 0).alias("n_failed"),
            F.count_if(failed == (1 << k)).alias("n_only"),
        )
        for k, name in enumerate(RULE_NAMES)
        if mask >> k & 1
    ]
    return ledger.agg(F.array(*sums).alias("r")).select(F.inline("r"))
