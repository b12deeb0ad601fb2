"""Helpers shared by the text operators: Arrow batches of texts and word hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.tables import written  # noqa: F401


#: Bytes of text that a task handles at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20

#: Bytes [^\x20\x09-\x0D] belong to words; this is also what bytes.split() splits by.
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM_BASE = np.uint64(0xD1342543DE82EF95)
_HASH_STEP = 1 << 19
#: Bytes of a word from which on a digest tells it: powers modulo 2^64 collide on long words of two letters
#: (Thue-Morse words of 1,024).
_LONG_WORD = 64


def slices(batch: pa.RecordBatch, text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about that many bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def as_strings(column: pa.Array) -> list[str]:
    """Each text; a null text is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def map_texts(
    frame: DataFrame,
    kernel: Callable[[pa.RecordBatch], dict[str, list]],
    schema: str,
    arrow: pa.Schema,
) -> DataFrame:
    """Runs kernel over slices of Arrow batches inside each task; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(kernel(part), schema=arrow)

    return frame.mapInArrow(run, schema)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_UP = _powers(_BASE, _HASH_STEP + 1)
_DOWN = _powers(_INVERSE, _HASH_STEP + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and each text's first index in them
    (one index more than texts)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    is_word = _IS_WORD[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word)).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    first = np.searchsorted(starts, at)
    hashes = np.zeros(len(starts), dtype=np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            begin = starts[done]
            upto = int(np.searchsorted(ends, begin + _HASH_STEP, "right"))
            if upto <= done:  # one word longer than a step, see below
                done += 1
                continue
            part = data[begin : ends[upto - 1]]
            codes = _BYTE_CODE[_LOWER[part] if lower else part] * _UP[: len(part)]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)))
            s, e = starts[done:upto] - begin, ends[done:upto] - begin
            hashes[done:upto] = (sums[e] - sums[s]) * _DOWN[s]
            done = upto
        hashes = mix(hashes)
    for k in np.flatnonzero(ends - starts > _LONG_WORD).tolist():
        word = data[starts[k] : ends[k]]
        hashes[k] = int.from_bytes(hashlib.blake2b(_LOWER[word] if lower else word, digest_size=8).digest(), "little")
    return hashes, first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words; empty when there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _GRAM_BASE + words[k : k + count]
        return mix(out)


def texts_of(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), so that extra columns can't clash with an operator's own."""
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def shards_for(frame: DataFrame) -> int:
    """The session's number of shuffle partitions, at least 1."""
    return max(1, int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket(column: Column, n: int) -> Column:
    """An even bucket 0..n-1 of a key."""
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
