"""Substring dedup: suffix automata of reference shards, past which passages of the documents are streamed
for their matching statistics; windows of consecutive words that also start in a document with a
smaller id are removed.

The reference is the corpus itself, so it has no size bound that would allow a broadcast of all shards
to all documents. Instead each window is routed to one shard by its anchor, the smallest hash among its
short word runs: equal windows have equal anchors, and neighbouring windows mostly share one, so that
whole passages travel together. First it is found which anchors occur in more than one document; only
passages of such anchors travel, equal passages of a document group once. The passages of a shard are
its reference: they are dealt into automata of at most about SHARD_WORDS words, whose states know the
smallest document that has their strings, and all passages of the shard are streamed past each automaton:
where the statistics reach a window's length, the state of those words gives the smallest document.
Windows of anchors that very many document groups share don't go to a shard, which would grow with a frequent
phrase: rows of equal words, one for each document group at most, are compared by their smallest document.

Words are runs of [^\\x20\\x09-\\x0D]. A null text has no words. Rows with null ids are left whole and
aren't referred to. Rows with equal ids don't remove words from each other. Words, anchors and
passages are compared by 64-bit hashes to find passages, and equal passages of a document group share
the decision of the group's smallest document; automata and frequent anchors' windows compare the words themselves. A window is at
most 62 words longer than RUN."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import _text
from trackloom.llm.automaton import SuffixAutomaton

#: Words of the runs that anchors are chosen from.
RUN = 4
#: Bytes of text in a document group, and in the passages of a shard, about.
GROUP_BYTES, SHARD_BYTES = 2 << 20, 3 << 20
#: Words of one automaton; a larger shard has several.
SHARD_WORDS = 1_000_000
#: Anchors of a range of the anchor count, about.
RANGE_ANCHORS = 2_000_000
#: Document groups that share an anchor, beyond which its windows are compared one by one.
HOT_GROUPS = 64
_STEP = 1 << 18
_SCALE = np.uint64(0xA24BAED4963EE407)
_DESCALE = np.uint64(pow(int(_SCALE), -1, 1 << 64))


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor place: the anchors, the first windows and the ends."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = _text.gram_hashes(words, RUN)
    width = window - RUN + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    place = np.concatenate([view[k : k + _STEP].argmin(1) + np.arange(k, min(k + _STEP, n)) for k in range(0, n, _STEP)])
    first = np.flatnonzero(np.diff(place, prepend=-1))
    return grams[place[first]], first, np.append(first[1:], n)


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, byte plane by byte plane."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _slices(table: pa.Table):
    """Of a group's rows, slice by slice: ids, texts, word hashes, and each text's first word."""
    for batch in table.combine_chunks().to_batches():
        for part in _text.slices(batch):
            texts = _text.as_bytes(part.column("text"))
            hashes, first = _text.word_hashes(texts)
            yield part.column("doc_id").to_pylist(), texts, hashes, first


_ANCHORS = pa.schema([("part", pa.int32()), ("p", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_REPEATED = pa.schema([("p", pa.int32()), ("repeated", pa.binary()), ("hot", pa.binary())])
_PASSAGES = pa.schema([("shard", pa.int32()), ("p", pa.int32()), ("key", pa.int64()), ("words", pa.binary()), ("least", pa.int64()), ("single", pa.bool_())])
_FOUND = pa.schema([("p", pa.int32()), ("key", pa.int64()), ("mask", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def group_anchors(window: int, n_ranges: int):
    """For a document group: its anchors by range, those of one document and those of several."""

    def run(table: pa.Table) -> pa.Table:
        own = [
            np.unique(anchors(hashes[first[k] : first[k + 1]], window)[0])
            for ids, _, hashes, first in _slices(table)
            for k, doc_id in enumerate(ids)
            if doc_id is not None
        ]
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *own]), return_counts=True)
        part = (values >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)
        out: dict[str, list] = {c: [] for c in _ANCHORS.names}
        cuts = np.searchsorted(part, np.arange(n_ranges + 1, dtype=np.uint64))
        for k in range(n_ranges):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                once = counts[a:b] == 1
                out["part"].append(k)
                out["p"].append(table.column("p")[0].as_py())
                out["once"].append(pack(values[a:b][once]))
                out["more"].append(pack(values[a:b][~once]))
        return pa.table(out, schema=_ANCHORS)

    return run


def repeated_anchors(hot_groups: int):
    """For a range of anchors: those in more than one document, for each group that has any."""

    def run(table: pa.Table) -> pa.Table:
        groups, values, weights = [], [], []
        for p, once, more in zip(*(table.column(c).to_pylist() for c in ("p", "once", "more")), strict=True):
            for blob, weight in ((once, 1), (more, 2)):
                held = unpack(blob)
                values.append(held)
                groups.append(np.full(len(held), p, dtype=np.int32))
                weights.append(np.full(len(held), weight, dtype=np.int64))
        value, group, weight = np.concatenate(values), np.concatenate(groups), np.concatenate(weights)
        order = np.lexsort((group, value))
        value, group, weight = value[order], group[order], weight[order]
        starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        sizes = np.diff(np.append(starts, len(value)))
        often = np.repeat(np.add.reduceat(weight, starts) > 1, sizes)
        hot = np.repeat(sizes > hot_groups, sizes)
        value, group, hot = value[often], group[often], hot[often]
        order = np.lexsort((value, group))
        value, group, hot = value[order], group[order], hot[order]
        out: dict[str, list] = {c: [] for c in _REPEATED.names}
        for a, b in _spans(group):
            out["p"].append(int(group[a]))
            out["repeated"].append(pack(value[a:b]))
            out["hot"].append(pack(value[a:b][hot[a:b]]))
        return pa.table(out, schema=_REPEATED)

    return run


def _spans(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The repeated and the hot anchors that a group was told of."""
    return tuple(np.sort(np.concatenate([np.empty(0, np.uint64), *[unpack(b) for b in table.column(c).to_pylist() if b is not None]])) for c in ("repeated", "hot"))


@dataclass
class Passages:
    """Passages of a slice: the text they are in, their first and last window's word (end exclusive), a
    hash of their words, the hash that routes them, and whether they are single windows of a hot anchor."""

    text: np.ndarray
    first: np.ndarray
    end: np.ndarray
    key: np.ndarray
    route: np.ndarray
    single: np.ndarray


def passages(ids: list, hashes: np.ndarray, first: np.ndarray, window: int, repeated: np.ndarray, hot: np.ndarray) -> Passages:
    """The passages of a slice's texts that travel; positions are words of the slice."""
    parts: list[tuple] = []
    for k, doc_id in enumerate(ids):
        if doc_id is None or not len(repeated):
            continue
        found, a, b = anchors(hashes[first[k] : first[k + 1]], window)
        some = _member(found, repeated)
        if some.any():
            found, a, b = found[some], a[some] + first[k], b[some] + first[k]
            single = _member(found, hot)
            if single.any():
                size = np.where(single, b - a, 1)
                at = np.repeat(a, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                single, found, b = np.repeat(single, size), np.repeat(found, size), np.repeat(b, size)
                a, b = at, np.where(single, at + 1, b)
            parts.append((np.full(len(a), k), a, b, found, single))
    if not parts:
        none = np.empty(0, np.int64)
        return Passages(none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool))
    text, a, b, found, single = (np.concatenate(x) for x in zip(*parts, strict=True))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashes), _SCALE))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(hashes), _DESCALE))), dtype=np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[:-1], dtype=np.uint64)))
        key = _text.mix((sums[b + window - 1] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return Passages(text, a, b, key, np.where(single, key, found), single)


def least_by_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the smallest document of each key, and for each place its key's smallest document."""
    order = np.lexsort((doc, key))
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.empty(0, bool)
    least = np.empty(len(key), dtype=np.int64)
    least[order] = doc[order][new][np.cumsum(new) - 1] if len(key) else least
    return order[new], least


def traveling_passages(window: int, n_shards: int):
    """For a document group and its repeated anchors: its distinct passages by shard, each with the
    smallest document that has it."""

    def run(documents: pa.Table, told: pa.Table) -> pa.Table:
        repeated, hot = _sets(told)
        out: dict[str, list] = {c: [] for c in _PASSAGES.names}
        if len(repeated) and len(documents):
            found = [(ids, texts, first, passages(ids, hashes, first, window, repeated, hot)) for ids, texts, hashes, first in _slices(documents)]
            doc = np.concatenate([np.array([ids[k] for k in p.text], dtype=np.int64) for ids, _, _, p in found])
            key, route, single = (np.concatenate([getattr(p, c) for _, _, _, p in found]) for c in ("key", "route", "single"))
            chosen = np.zeros(len(key), dtype=bool)
            chosen[least_by_key(key, doc)[0]] = True
            words_of: list[bytes] = []
            at = 0
            for _, texts, first, p in found:
                mine = np.flatnonzero(chosen[at : at + len(p.key)])
                at += len(p.key)
                held, words = -1, []
                for k, a, b in zip(p.text[mine].tolist(), p.first[mine].tolist(), p.end[mine].tolist(), strict=True):
                    if k != held:
                        held, words, base = k, texts[k].split(), int(first[k])
                    words_of.append(b" ".join(words[a - base : b - base + window - 1]))
            out["shard"] = ((route[chosen] >> np.uint64(17)) % np.uint64(n_shards)).astype(np.int32)
            out["key"], out["words"], out["least"] = key[chosen].view(np.int64), words_of, doc[chosen]
            out["p"] = np.full(len(words_of), documents.column("p")[0].as_py(), dtype=np.int32)
            out["single"] = single[chosen]
        return pa.table(out, schema=_PASSAGES)

    return run


def smallest_documents(passages: list[list[int]], least: np.ndarray, window: int) -> np.ndarray:
    """For each word of the passages, in turn: the smallest document that has the window ending there; the
    largest integer for a passage's first words. The passages are dealt into automata of about
    SHARD_WORDS words, and all of them are streamed past each."""
    sizes = np.fromiter(map(len, passages), dtype=np.int64, count=len(passages))
    out = np.full(int(sizes.sum()), np.iinfo(np.int64).max)
    upto = np.cumsum(sizes)
    first = 0
    while first < len(passages):
        done = upto[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(upto, done + SHARD_WORDS, "right")))
        automaton = SuffixAutomaton(passages[first:last])
        smallest = automaton.merged(np.repeat(least[first:last], sizes[first:last]), np.iinfo(np.int64).max, np.minimum)
        states, matched = (np.array(x, dtype=np.int64) for x in automaton.stream(passages))
        reached = matched >= window
        windows = automaton.suffix_states(window)[states[reached]]
        out[reached] = np.minimum(out[reached], smallest[windows])
        first = last
    return out


def shard_matches(window: int):
    """For a shard: which windows of a passage also start in a smaller document than the group's own
    smallest one with it, as bits from the first window; passages without any are left out."""

    def run(table: pa.Table) -> pa.Table:
        token: dict[bytes, int] = {}
        place_of: dict[bytes, int] = {}
        place = np.array([place_of.setdefault(w, len(place_of)) for w in table.column("words").to_pylist()], dtype=np.int64)
        least = np.asarray(table.column("least"))
        own = np.full(len(place_of), np.iinfo(np.int64).max)
        np.minimum.at(own, place, least)
        coded = [[token.setdefault(x, len(token)) for x in w.split(b" ")] for w in place_of]
        sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        by_word = smallest_documents(coded, own, window)
        starts = np.cumsum(sizes) - sizes
        mask = np.zeros(len(table), dtype=np.int64)
        for bit in range(int(sizes.max()) - window + 1):
            has = sizes[place] >= bit + window
            rows = np.flatnonzero(has)
            mask[rows] |= (by_word[starts[place[rows]] + bit + window - 1] < least[rows]).astype(np.int64) << bit
        some = np.flatnonzero(mask)
        return pa.table({"p": table.column("p").take(some), "key": table.column("key").take(some), "mask": mask[some]}, schema=_FOUND)

    return run


def keep_words(window: int):
    """For a document group, its repeated anchors and what the shards found: the words that stay. In the
    group's smallest document with a passage the found windows go; in others all of them, as they
    also start in that document."""

    def run(documents: pa.Table, told: pa.Table) -> pa.Table:
        repeated, hot = _sets(told)
        rows = [(k, m) for k, m in zip(told.column("key").to_pylist(), told.column("mask").to_pylist(), strict=True) if k is not None]
        keys = np.array([k for k, _ in rows], dtype=np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, masks = keys[order], np.array([m for _, m in rows], dtype=np.int64)[order]
        held = [(ids, texts, first, passages(ids, hashes, first, window, repeated, hot)) for ids, texts, hashes, first in _slices(documents)]
        doc = [np.array([ids[k] for k in p.text], dtype=np.int64) for ids, _, _, p in held]
        key = np.concatenate([p.key for _, _, _, p in held]) if held else keys
        least = least_by_key(key, np.concatenate(doc) if doc else masks)[1]
        at = 0
        out: dict[str, list] = {c: [] for c in _KEPT.names}
        for (ids, texts, first, p), own in zip(held, doc, strict=True):
            size = p.end - p.first
            mask = (np.int64(1) << size) - 1
            smallest = own == least[at : at + len(own)]
            at += len(own)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, p.key), len(keys) - 1)
                mask[smallest] = np.where(keys[place] == p.key, masks[place], 0)[smallest]
            else:
                mask[smallest] = 0
            edges = np.zeros(int(first[-1]) + 1, dtype=np.int64)
            for bit in range(int(size.max()) if len(size) else 0):
                start = p.first[mask >> bit & 1 == 1] + bit
                np.add.at(edges, start, 1)
                np.add.at(edges, start + window, -1)
            stays = np.cumsum(edges) == 0
            for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
                words = text.split()
                n, own_words = len(words), stays[first[k] : first[k + 1]]
                if not own_words.all():
                    words = list(compress(words, own_words.tolist()))
                out["doc_id"].append(doc_id)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept"].append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table(out, schema=_KEPT)

    return run


def drop_repeated_substrings(documents: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept words are joined by one space. A word is
    removed if a window of consecutive words that covers it also starts in a document with a smaller
    id; windows are judged on the input. `window` is above RUN. See the module for edge cases."""
    texts = _text.texts_of(documents, id_col, text_col)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fewest = _text.shards_for(documents)
    n_groups = max(fewest, total // GROUP_BYTES)
    n_ranges = int(max(fewest, total // 30 // RANGE_ANCHORS))
    n_shards = int(max(fewest, total // SHARD_BYTES * 2))
    grouped = texts.withColumn("p", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int"))
    # One exchange of the texts, which all three passes read.
    n_parts = int(max(fewest, total // (8 * GROUP_BYTES)))
    grouped = grouped.select("p", "doc_id", "text").repartition(n_parts, "p")
    by_range = grouped.groupBy("p").applyInArrow(group_anchors(window, n_ranges), "part int, p int, once binary, more binary")
    repeated = by_range.groupBy("part").applyInArrow(repeated_anchors(HOT_GROUPS), "p int, repeated binary, hot binary")
    repeated = _text.written(repeated)
    schema = "shard int, p int, key long, words binary, least long, single boolean"
    traveling = grouped.groupBy("p").cogroup(repeated.repartition(n_parts, "p").groupBy("p")).applyInArrow(traveling_passages(window, n_shards), schema)
    traveling = _text.written(traveling)
    rows = traveling.where("not single").select("shard", "p", "key", "words", "least")
    found = rows.groupBy("shard").applyInArrow(shard_matches(window), "p int, key long, mask long")
    smallest = F.min("least").over(Window.partitionBy("key", "words"))
    smaller = traveling.where("single").select("p", "key", "least", smallest.alias("smallest")).where("smallest < least")
    found = _text.written(found.unionByName(smaller.select("p", "key", F.lit(1).cast("long").alias("mask"))))
    told = repeated.withColumns({"key": F.lit(None).cast("long"), "mask": F.lit(None).cast("long")}).unionByName(
        found.withColumns({"repeated": F.lit(None).cast("binary"), "hot": F.lit(None).cast("binary")})
    )
    kept = grouped.groupBy("p").cogroup(told.repartition(n_parts, "p").groupBy("p")).applyInArrow(keep_words(window), "doc_id long, n_words long, n_removed long, kept string")
    return kept
