"""Byte-level BPE encoding and decoding by corpus-level merge replay: the words of a corpus slice are
laid out together, an inverted index leads from the token that a pair makes to the pair's positions,
and merges are applied in rank order, touching only the neighbours of merged positions.

The documents a task reads are its corpus: no shuffle, and each distinct word is merged once as long
as the memo of encoded words (at most MEMO_WORDS) holds. A null text counts as empty: no tokens. Rows
are independent, so repeated and null ids give one row for each input row."""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from trackloom.llm import _text

#: Bound on the words whose encoding a task remembers from one corpus slice to the next.
MEMO_WORDS = 100_000
#: Words whose merges are replayed together, and bytes of the texts they come from.
REPLAY_WORDS, CORPUS_BYTES = 150_000, 8 << 20

#: ASCII white space and what follows up to the next; a piece never crosses the start of such a run
#: when the character before it isn't white space.
_SEGMENT = re.compile(r"[\x09-\x0d\x20]*[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+")
#: White space beyond ASCII: texts with any go through the pattern as a whole.
_OTHER_SPACE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many words at once by the ranks of byte-level tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs, merged = array("q"), array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    merged.append(rank)
        order = np.argsort(pairs)
        self.pairs, self.merged = np.asarray(pairs)[order], np.asarray(merged)[order]
        self.memo: dict[str, bytes] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that pairs of tokens make, -1 if none."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, none of them empty, in turn, and how many each has. Of the pairs in
        a word the one with the lowest rank, leftmost first, is merged until none has a rank. A rank
        takes one place in each word at a time, so that lower ranks that a merge has made possible
        come before the word's next place."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        token = self.byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, dtype=bool)
        rank_at = np.full(n, -1, dtype=np.int32)  # of the pair that starts at a position
        rank_at[:-1] = self.rank_of(token[:-1], token[1:])
        rank_at[ends - 1] = -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            starts = [0, *cuts.tolist()]
            for rank, a, b in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
                held = index.get(rank)
                if held is None:
                    index[rank] = [places[a:b]]
                    heapq.heappush(queue, rank)
                else:
                    held.append(places[a:b])

        possible = np.flatnonzero(rank_at >= 0).astype(np.int32)
        if len(possible):
            add(rank_at[possible], possible)
        while queue:
            rank = heapq.heappop(queue)
            held = index.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[rank_at[at] == rank]  # others have a neighbour that has been merged since
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                of = word[at]
                again = of[1:] == of[:-1]
                if again.any():
                    first = np.concatenate(([True], ~again))
                    rest, at = at[~first], at[first]
                    index[rank] = [rest]
                    heapq.heappush(queue, rank)
            right, near = after[at], before[at]
            far = after[right]
            after[at] = far
            token[at] = rank
            rank_at[right] = -1
            alive[right] = False
            rank_at[at] = -1
            new_ranks, new_places = [], []
            inner = np.flatnonzero(far >= 0)
            if len(inner):
                far, left = far[inner], at[inner]
                before[far] = left
                made = self.rank_of(token[left], token[far])
                rank_at[left] = made
                new_ranks.append(made)
                new_places.append(left)
            inner = np.flatnonzero(near >= 0)
            if len(inner):
                near, mid = near[inner], at[inner]
                made = self.rank_of(token[near], token[mid])
                rank_at[near] = made
                new_ranks.append(made)
                new_places.append(near)
            if new_ranks:
                ranks, places = np.concatenate(new_ranks), np.concatenate(new_places)
                some = ranks >= 0
                if some.any():
                    add(ranks[some], places[some])
        return token[alive], np.add.reduceat(alive, ends - sizes, dtype=np.int64)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of distinct pieces; a piece that is a token itself stays whole."""
        out: dict[str, bytes] = {}
        split: list[str] = []
        for piece in pieces:
            whole = self.ranks.get(piece.encode())
            if whole is None:
                split.append(piece)
            else:
                out[piece] = whole.to_bytes(4, "little")
        for k in range(0, len(split), REPLAY_WORDS):
            part = split[k : k + REPLAY_WORDS]
            tokens, counts = self.replay([p.encode() for p in part])
            packed, cuts = tokens.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            out.update((p, packed[a:b]) for p, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True))
        return out

    def split(self, text: str) -> list[str]:
        """Segments of a text that the pattern never matches across."""
        return [text] if _OTHER_SPACE.search(text) else _SEGMENT.findall(text)

    def study(self, texts: Iterable[str]) -> None:
        """Replays the merges of all words of the texts that aren't remembered yet."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new: set[str] = set()
        for text in texts:
            new.update(s for s in self.split(text) if len(s) <= 64 and s not in self.memo)
        self._remember(new, self.memo)

    def _remember(self, segments: Iterable[str], memo: dict[str, bytes]) -> None:
        found = {s: self.pattern.findall(s) for s in segments}
        learned = self.learn(list({p for pieces in found.values() for p in pieces}))
        memo.update((s, learned[pieces[0]] if len(pieces) == 1 else b"".join([learned[p] for p in pieces])) for s, pieces in found.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for text in texts:
            segments = self.split(text)
            try:
                out.append(b"".join([memo[s] for s in segments]))
            except KeyError:
                own: dict[str, bytes] = {}
                self._remember({s for s in segments if s not in memo}, own)
                out.append(b"".join([own[s] if s in own else memo[s] for s in segments]))
        return out


class TokenBytes:
    """Decodes packed ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {v: k for k, v in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_LOADED: dict[tuple, MergeReplay | TokenBytes] = {}


def _codec(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = MergeReplay(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def _decoder(path: str) -> TokenBytes:
    if (path,) not in _LOADED:
        _LOADED[path,] = TokenBytes(read_ranks(path))
    return _LOADED[path,]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def bpe_encode(documents: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(doc_id, ids): the ids of each text, packed as little-endian unsigned 32-bit integers. With decode,
    also `decoded`, the bytes that these ids stand for, without passing the ids through another Python
    worker. rank_path must be readable by the executors."""
    schema = _DECODED if decode else _ENCODED

    def run(batches):
        held, size = [], 0
        for batch in chain(batches, [None]):
            for part in [] if batch is None else _text.slices(batch):
                held.append(part)
                size += part.nbytes
            if held and (batch is None or size >= CORPUS_BYTES):
                codec = _codec(rank_path, pattern)
                codec.study(t for part in held for t in _text.as_strings(part.column("text")))
                for part in held:
                    out = {"doc_id": part.column("doc_id").to_pylist(), "ids": codec.encode(_text.as_strings(part.column("text")))}
                    if decode:
                        decoder = _decoder(rank_path)
                        out["decoded"] = [decoder.decode(x) for x in out["ids"]]
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                held, size = [], 0
        _codec(rank_path, pattern).memo.clear()  # workers outlive their tasks

    return _text.texts_of(documents, id_col, text_col).mapInArrow(run, "doc_id long, ids binary" + ", decoded binary" * decode)


_DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def bpe_decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that packed ids stand for. Null ids decode to nothing."""

    def run(batches):
        for batch in batches:
            codec = _decoder(rank_path)
            ids = batch.column("ids").to_pylist()
            decoded = [codec.decode(x or b"") for x in ids]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").to_pylist(), "ids": ids, "decoded": decoded}, schema=_DECODED
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
