"""Lempel-Ziv fingerprints of documents: a text is parsed into dictionary phrases (LZ78: each phrase is the longest
one known so far and one more character), the set of phrases is hashed, and the `size` smallest hashes are its
signature. The likeness of two signatures is the share of common hashes among the `size` smallest of both, an
estimate of the Jaccard similarity of the phrase sets: texts that compress well together share their phrases.

A signature is a string: 8 hex digits for each hash, ascending. Equal texts have equal fingerprints. An empty or null
text has no phrase and an empty fingerprint, which is like another empty one (1) and unlike all others (0). A text
with fewer phrases than `size` keeps them all, so its likeness to another such text is exact.

Documents follow each other by id (null first), those with one id by a hash of the text; after the last comes the
first, and a single document follows itself. Texts are shuffled once, into ranges of ids whose bounds are the
only thing that the driver holds (a few for each shuffle partition). The first document of a range is also dealt to the range before, so
each task sees every document's successor; it holds two texts and one dictionary at a time. Parsing takes time in
proportion to the text, and only the replaced part of an edited text is parsed anew."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _text

SIZE = 128
#: Ranges of ids for each shuffle partition, so that hashing ranges to tasks deals evenly.
RANGES = 8
#: Fixed values of the phrase hash: a polynomial of the characters modulo a Mersenne prime.
_PRIME, _BASE, _EMPTY = (1 << 61) - 1, 0x1B873593CC9E2D51 >> 3, 0x2545F4914F6CDD1D >> 3


class Parse:
    """An LZ78 parse that can be taken back to a mark, to go on with another text."""

    def __init__(self):
        self.children: dict[int, int] = {}  # phrase number and next character -> phrase number, both shifted by 21 bits
        self.hashes: list[int] = [_EMPTY]
        self.node = 0

    def feed(self, text: str) -> None:
        children, hashes, node = self.children, self.hashes, self.node
        get, append = children.get, hashes.append
        base, prime, made = _BASE, _PRIME, len(hashes) << 21
        for c in np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist():
            key = node | c
            known = get(key)
            if known:
                node = known
            else:
                children[key] = made
                made += 2097152  # 1 << 21
                append((hashes[node >> 21] * base + c + 1) % prime)
                node = 0
        self.node = node

    def mark(self) -> tuple[int, int]:
        return len(self.children), self.node

    def back(self, mark: tuple[int, int]) -> None:
        held, self.node = mark
        for _ in range(len(self.children) - held):
            self.children.popitem()  # the last one made
        del self.hashes[held + 1 :]

    def signature(self, size: int, since: int = 0, held: np.ndarray | None = None) -> np.ndarray:
        """The signature of the phrases from a number on, together with that of those before, if held."""
        found = (_text.mix(np.array(self.hashes[since + 1 :], dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
        found.sort()
        if held is not None:
            found = np.concatenate((held, found[: _first_distinct(found, size)]))
            found.sort()
        return found[np.concatenate(([True], found[1:] != found[:-1]))][:size] if len(found) else found


def _first_distinct(ordered: np.ndarray, size: int) -> int:
    """How many leading values hold the first `size` distinct ones, or all."""
    if len(ordered) <= size:
        return len(ordered)
    starts = np.flatnonzero(ordered[1:] != ordered[:-1])
    return int(starts[size - 1]) + 1 if len(starts) >= size else len(ordered)


def signature(text: str | None, size: int = SIZE) -> np.ndarray:
    """The signature of a whole text."""
    parse = Parse()
    parse.feed(text or "")
    return parse.signature(size)


def as_fingerprint(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of common hashes among the `size` smallest of two signatures."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    first = np.concatenate(([True], both[1:] != both[:-1]))
    cut = min(size, int(np.count_nonzero(first)))
    common = np.cumsum(first)[~first] <= cut  # a repeated value, by its place among the distinct ones
    return float(np.count_nonzero(common) / cut)


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each document; no shuffle."""
    rows = _text.texts_of(documents, id_col, text_col)
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _text.as_strings(batch.column("text"))
            found = [as_fingerprint(signature(t, size)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n_chars long, fingerprint string")


def range_starts(keys: DataFrame, ranges: int) -> list[tuple]:
    """The first key (id, hash) of each range of ids, in order: at most `ranges` rows."""
    ranged = keys.repartitionByRange(ranges, "doc_id", "hash").withColumn("part", F.spark_partition_id())
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "hash")).alias("first")).select("first.*").distinct().collect()
    return sorted(((r["doc_id"], r["hash"]) for r in firsts), key=lambda k: (k[0] is not None, k))


def range_of(starts: Column, n: int, key: Column) -> Column:
    """The number of the last range that starts at the key or before it, by halving."""
    steps = [F.lit(1 << k) for k in reversed(range(max(1, n.bit_length())))]

    def halve(at: Column, step: Column) -> Column:
        ahead = at + step
        return F.when((ahead < n) & (F.get(starts, ahead) <= key), ahead).otherwise(at)

    return F.aggregate(F.array(*steps), F.lit(0), halve)


def with_successors(documents: DataFrame) -> DataFrame:
    """(part, borrowed, doc_id, hash, text) of (doc_id, text), each part in order in one task; a part ends with the
    first document of the next one, which is marked as borrowed."""
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")
    shards = _text.shards_for(rows)
    starts = range_starts(rows.select("doc_id", "hash"), RANGES * shards)
    if not starts:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("borrowed"), "doc_id", "hash", "text")
    kind = rows.schema["doc_id"].dataType
    held = F.array(*[F.struct(F.lit(i).cast(kind).alias("doc_id"), F.lit(h).cast("long").alias("hash")) for i, h in starts])
    key, n = F.struct("doc_id", "hash"), len(starts)
    part = range_of(held, n, key)
    placed = rows.withColumn("part", part)
    # A range's first key is its start; such a document is also dealt to the range before, and the very first to the last.
    places = F.when(F.get(held, F.col("part")) == key, F.array(F.col("part"), F.pmod(F.col("part") - 1, F.lit(n)))).otherwise(F.array("part"))
    dealt = placed.select(F.posexplode(places).alias("copy", "part"), "doc_id", "hash", "text")
    dealt = dealt.select("part", (F.col("copy") > 0).alias("borrowed"), "doc_id", "hash", "text")
    return dealt.repartition(shards, "part").sortWithinPartitions("part", "borrowed", "doc_id", "hash")


def compare_edits(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, share: int = 4) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document: the
    edited text has its last n_chars div `share` characters replaced by the first as many of the document that
    follows (or all that it has); near_next compares with that document. See the module for order and edge cases."""
    rows = with_successors(_text.texts_of(documents, id_col, text_col))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document before: part, id, text, signature, and its parse and signature up to where an edit starts
        ended = None  # the part whose borrowed document has come
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for part, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "borrowed", "doc_id", "text")), strict=True):
                if borrowed and part == ended:
                    continue  # a repeated row of the next part's first document
                text = text or ""
                kept = len(text) - len(text) // share
                parse = Parse()
                parse.feed(text[:kept])
                mark = parse.mark()
                stable = parse.signature(size)
                parse.feed(text[kept:])
                own = parse.signature(size, mark[0], stable)
                if held is not None and held[0] == part:
                    _, before_id, before, before_own, before_parse, before_stable = held
                    stay = len(before) - len(before) // share
                    new = text[: len(before) - stay]
                    phrases, _ = before_parse.mark()
                    before_parse.feed(new)
                    edited = before_parse.signature(size, phrases, before_stable)
                    out["doc_id"].append(before_id)
                    out["n_chars"].append(len(before))
                    out["edited_sha256"].append(hashlib.sha256((before[:stay] + new).encode()).hexdigest())
                    out["fingerprint"].append(as_fingerprint(before_own))
                    out["edited_fingerprint"].append(as_fingerprint(edited))
                    out["near_edited"].append(likeness(before_own, edited, size))
                    out["near_next"].append(likeness(before_own, own, size))
                if borrowed:
                    held, ended = None, part
                else:
                    parse.back(mark)
                    held = (part, doc_id, text, own, parse, stable)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            arrays = [pa.array(out["doc_id"], batch.schema.field("doc_id").type), *[pa.array(out[c], k) for c, k in zip(list(out)[1:], kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, list(out))

    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema)
