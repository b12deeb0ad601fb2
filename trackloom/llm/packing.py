"""Best-fit packing of tokenised documents into sequences: best-fit decreasing, where a segment tree
over remaining capacities finds the tightest open sequence in logarithmic time.

Only documents longer than a sequence are cut, into full pieces; full pieces fill a sequence alone.
The others are dealt evenly into groups of about GROUP_PIECES, and each group is packed by itself, so
that no task holds more; at most the last sequences of each group are not full. Pieces are dealt by a
number of their own, so equal rows spread as well. Ties are broken by document and piece, so a group's
packing doesn't depend on the order of its rows. A null text counts as empty; an empty text still has
its end token. Repeated ids are packed as documents of their own. A text that holds the string of an
added token, such as <|endoftext|>, gets the ids that the tokenizer gives by default, that token's own."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

from trackloom.llm import _text

#: Pieces packed together by one task.
GROUP_PIECES = 40_000
#: Bound on the words whose ids a task remembers.
MEMO_WORDS = 600_000


#: Fixed value: how the tokenizer splits normalised words before its merges.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


_LOADED: dict[str, tuple[Tokenizer, Tokenizer, np.ndarray, list[bytes]]] = {}


def _tokenizers(path: str) -> tuple[Tokenizer, Tokenizer, np.ndarray, list[bytes]]:
    """The tokenizer; one with the same merges for parts that are normalised and split already; which
    tokens end a word; and the strings of added tokens, which are matched in a text as written. Read
    once by a Python worker."""
    if path not in _LOADED:
        both = [Tokenizer.from_file(path), Tokenizer.from_file(path)]
        both[1].encode_special_tokens = True
        added = [t.content.encode() for t in both[0].get_added_tokens_decoder().values()]
        both[1].normalizer = None
        both[1].pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        is_last = np.zeros(both[0].get_vocab_size() + 1, dtype=bool)
        is_last[[i for t, i in both[0].get_vocab().items() if t.endswith("</w>")]] = True
        _LOADED[path] = (*both, is_last, added)
    return _LOADED[path]


class WordMemoTokenizer:
    """A tokenizer whose ids of a text are those of its white-space separated words in turn; words are
    encoded once, and so are the parts that they share."""

    def __init__(self, path: str):
        self.tokenizer, self.merger, self.is_last, self.added = _tokenizers(path)
        self.memo: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def learn_parts(self, parts: list[str]) -> None:
        """Ids of parts that stay whole up to the merges: each ends with its only word-end token."""
        for k in range(0, len(parts), 400):
            part = parts[k : k + 400]
            (found,) = self.merger.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.is_last[ids]) + 1) * 4).tolist()
            packed = ids.tobytes()
            self.parts.update((w, packed[a:b]) for w, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True))

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words. Words of plain Latin letters are split here, where normalising is
        only lower case; others are left to the tokenizer as a whole."""
        out: dict[bytes, bytes] = {}
        plain: list[tuple[bytes, str]] = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            text = b" ".join(part).decode("utf-8", "replace")
            if max(text) < "\u0250" and "\u0130" not in text:
                plain += zip(part, text.lower().split(" "), strict=True)
                continue
            for word in part:
                text = word.decode("utf-8", "replace")
                if max(text) < "\u0250" and "\u0130" not in text:
                    plain.append((word, text.lower()))
                else:
                    out[word] = self.whole(word)
        mixed = {t: _PRETOKEN.findall(t) for _, t in plain if not t.isalpha()}
        if len(self.parts) > MEMO_WORDS:
            self.parts.clear()
        known = self.parts
        wanted = {t for _, t in plain if t.isalpha()}.union(*mixed.values())
        self.learn_parts([p for p in wanted if p not in known])
        for word, text in plain:
            parts = mixed.get(text)
            out[word] = known[text] if parts is None else b"".join([known[p] for p in parts])
        return out

    def whole(self, text: bytes) -> bytes:
        """Packed ids of a text that isn't taken apart."""
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        whole = {k: self.whole(t) for k, t in enumerate(texts) if any(a in t for a in self.added)}
        split = [[] if k in whole else t.split() for k, t in enumerate(texts)]
        memo = self.memo
        new = self.learn(list(set(chain.from_iterable(split)).difference(memo)))
        long = {w for w in new if len(w) > 64}
        memo.update(new)
        out = [whole[k] if k in whole else b"".join(map(memo.__getitem__, words)) for k, words in enumerate(split)]
        for word in long:  # not worth the memory
            del memo[word]
        return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def token_pieces(
    documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of each document with their packed ids (little-endian unsigned 32-bit integers).
    tokenizer_path must be readable by the executors."""
    end = np.array([end_id], dtype="<u4").tobytes()

    own: list[WordMemoTokenizer] = []  # of a task; what it remembers goes with it

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        if not own:
            own.append(WordMemoTokenizer(tokenizer_path))
        encoded = own[0].encode(_text.as_bytes(batch.column("text")))
        out: dict[str, list] = {c: [] for c in _PIECES.names}
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                out["doc_id"].append(doc_id)
                out["piece"].append(piece)
                out["start"].append(at // 4)
                out["length"].append(len(part) // 4)
                out["ids"].append(part)
        return out

    schema = "doc_id long, piece int, start long, length long, ids binary"
    return _text.map_texts(_text.texts_of(documents, id_col, text_col), kernel, schema, _PIECES)


class OpenSequences:
    """Open sequences by remaining capacity; a segment tree over capacities counts them."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.fill: list[int] = []

    def _add(self, room: int, by: int) -> None:
        k = room + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, length: int) -> int:
        """The smallest remaining capacity of at least `length` that some open sequence has, or -1."""
        count, k = self.count, length + self.size
        if count[k]:
            return length
        while k > 1 and (k & 1 or not count[k + 1]):  # up until there is something to the right
            k >>= 1
        if k <= 1:
            return -1
        k += 1
        while k < self.size:
            k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.size

    def place(self, length: int) -> tuple[int, int]:
        """Puts a piece into the tightest sequence that has room; its number and the piece's offset."""
        room = self.tightest(length)
        if room < 0:
            sequence, room = len(self.fill), self.capacity
            self.fill.append(0)
        else:
            sequence = self.open[room].pop()
            self._add(room, -1)
        offset = self.fill[sequence]
        self.fill[sequence] += length
        if room - length > 0:
            self.open[room - length].append(sequence)
            self._add(room - length, 1)
        return sequence, offset


def best_fit(pieces: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity). The pieces
    are written to the shared folder first: they are counted to deal them into even groups, and read
    again."""
    # The number a piece is dealt by is written with it, so that it is the same whenever a task is repeated.
    held = _text.written(pieces.withColumn("__deal", F.monotonically_increasing_id()))
    groups = max(1, -(-held.count() // group_pieces))
    columns = pieces.columns
    key = F.pmod(F.xxhash64("__deal"), F.lit(groups)).cast("long")

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "__deal"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sequences = OpenSequences(capacity)
        placed = [sequences.place(int(n)) for n in part["length"]]
        part["sequence_id"] = np.array([s for s, _ in placed], dtype="int64") + (int(key[0]) << 32)
        part["offset"] = np.array([o for _, o in placed], dtype="int64")
        return part.drop(columns=["pack_group", "__deal"])

    kinds = dict(held.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return held.withColumn("pack_group", key).groupBy("pack_group").applyInPandas(pack, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. The ids themselves are those of token_pieces."""
    pieces = token_pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col)
    return best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)
