"""Phrase collocations of each language by Rabin-Karp fingerprints.

A text is lower-cased in A-Z and split at [.,;:!?\\x0A-\\x0D] into pieces, and these into words [^\\x20\\x09]+. Numpy
prefix polynomials hash all words and n-grams of a slice of texts at once (64 bits modulo 2^64, and a second,
independent hash modulo 2^31 - 1 as a check). Each slice sends every n-gram's fingerprint once, with its number
of occurrences; fingerprints that are frequent in all are then resolved to text:

1. The sieve counts fingerprints of words and pairs, and turns the frequent ones into a bit table of bounded size.
   A bit may be set for several fingerprints, which costs work and changes no result.
2. The count pass sends words, pairs and triples whose words and pairs all have their bits, with count,
   smallest and largest check, and a pointer to an occurrence (document, place).
3. Fingerprints with min_count occurrences are materialised: their pointers are looked up in the texts.
   Where the checks of a fingerprint differ, phrases collide: those are counted once more by their texts.

A phrase (words a) of 2 or 3 words is cut after its first k words into parts with l and r occurrences; its score is
floor(1000000 a a / (l r)), exact, for the lowest cut (then the smallest k). A phrase goes when a longer candidate
contains it and has at least cover_percent of its occurrences.

Defined results: a null text is empty, a null language is `und` (as is the language of that name), a null id is as
good as any; ids may repeat (a pointer is checked against the fingerprint where it leads). A text
longer than a slice is cut where a piece ends. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackloom.llm import _text

LONGEST = 3
#: Text that a task hashes at once, in bytes; its arrays take about 25 times as much.
SLICE = 2 << 20
#: Rows of a batch that a task hands on.
BATCH_ROWS = 1 << 16
#: Bits of the table of frequent words and pairs (16 MB), sent to the driver in words of WORD bits.
TABLE_BITS, WORD = 1 << 27, 32
#: Parts that each language's candidates are dealt to when the best are chosen, step by step.
DEALS = (512, 8, 1)

_PRIME = np.int64((1 << 31) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_random = np.random.default_rng(20250117)
_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHECKS = _random.integers(1, int(_PRIME), 256, dtype=np.int64)
_BASE, _CHECK_BASE = 0xB5026F5AA96619E9, 48271
_GRAM, _CHECK_GRAM = np.uint64(0x9FB21C651E98DF25), np.int64(16807)
_STEP = 1 << 18


def _powers(base: int, modulus: int, kind: type) -> np.ndarray:
    out = np.empty(_STEP + 1, dtype=kind)
    value = 1
    for k in range(_STEP + 1):
        out[k] = value
        value = value * base % modulus
    return out


class Powers:
    """Powers of both bases up to a step, and their inverses; made once in each worker."""

    made: Powers | None = None

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 64, np.uint64), _powers(pow(_BASE, -1, 1 << 64), 1 << 64, np.uint64)
        p = int(_PRIME)
        self.check_up, self.check_down = _powers(_CHECK_BASE, p, np.int64), _powers(pow(_CHECK_BASE, -1, p), p, np.int64)

    @classmethod
    def get(cls) -> Powers:
        cls.made = cls.made or cls()
        return cls.made


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both polynomial hashes of data[start:end] for ascending ranges, from prefix sums."""
    powers = Powers.get()
    hashes, checks = np.empty(len(starts), np.uint64), np.empty(len(starts), np.int64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            begin = starts[done]
            upto = int(np.searchsorted(ends, begin + _STEP, "right"))
            if upto <= done:  # one word longer than a step
                hashes[done], checks[done] = _long_hashes(data[begin : ends[done]], powers)
                done += 1
                continue
            part = data[begin : ends[upto - 1]]
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[part] * powers.up[: len(part)], dtype=np.uint64)))
            # At most 2^18 terms below 2^31, so that the sums stay below 2^49.
            checked = np.concatenate((np.zeros(1, np.int64), np.cumsum(_CHECKS[part] * powers.check_up[: len(part)] % _PRIME)))
            s, e = starts[done:upto] - begin, ends[done:upto] - begin
            hashes[done:upto] = (sums[e] - sums[s]) * powers.down[s]
            checks[done:upto] = (checked[e] - checked[s]) % _PRIME * powers.check_down[s] % _PRIME
            done = upto
    return hashes, checks


def _long_hashes(data: np.ndarray, powers: Powers) -> tuple[np.uint64, np.int64]:
    total, scale = np.uint64(0), np.uint64(1)
    checked, check_scale = 0, 1
    for k in range(0, len(data), _STEP):
        part = data[k : k + _STEP]
        total += np.sum(_CODES[part] * powers.up[: len(part)], dtype=np.uint64) * scale
        scale *= powers.up[_STEP]
        checked += int(np.sum(_CHECKS[part] * powers.check_up[: len(part)] % _PRIME)) * check_scale
        check_scale = check_scale * int(powers.check_up[_STEP]) % int(_PRIME)
    return total, np.int64(checked % int(_PRIME))


class Words:
    """The words of some texts of one language, lower-cased: hashes, pieces, and where each text's words start."""

    def __init__(self, texts: list[bytes], bits: int):
        self.data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], _WORD[self.data])).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.pieces = np.cumsum(_ENDS[self.data], dtype=np.int64)[self.starts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.firsts = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes + 1))))
        self.bits = bits
        self.hashes, self.checks = range_hashes(self.data, self.starts, self.ends)

    def grams(self, n: int, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, fingerprint and check of every n-gram within a piece. The salt tells languages apart."""
        count = max(0, len(self.starts) - n + 1)
        at = np.flatnonzero(self.pieces[:count] == self.pieces[n - 1 :][:count])
        prints = np.full(len(at), salt + np.uint64(n), np.uint64)
        checks = np.zeros(len(at), np.int64)
        with np.errstate(over="ignore"):
            for k in range(n):
                prints = _text.mix(prints) * _GRAM + self.hashes[at + k]
                checks = (checks * _CHECK_GRAM + self.checks[at + k] + 1) % _PRIME
            prints = _text.mix(prints)
        return at, prints & np.uint64((1 << self.bits) - 1), checks

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True)).decode()


def salt_of(lang: str) -> np.uint64:
    """A number for a language; those that agree by chance are told apart where counts are added up."""
    return np.uint64(hash_bytes(lang.encode()))


def hash_bytes(data: bytes) -> int:
    out = 0xCBF29CE484222325
    for c in data:
        out = (out ^ c) * 0x100000001B3 % (1 << 64)
    return out


def in_slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list, list[bytes], list[int]]]:
    """(language, ids, texts, skipped) with about `size` bytes of text of one language each; a longer text is cut after
    the end of a piece, and `skipped` counts its words in the parts before."""
    held: dict[str, tuple[list, list[bytes], list[int]]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in (part for whole in batches for part in _text.slices(whole, size=size)):
        columns = (batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist(), _text.as_bytes(batch.column("text")))
        for lang, doc_id, text in zip(*columns, strict=True):
            skipped = 0
            for part in cut_text(text, size):
                ids, texts, skips = held.setdefault(lang, ([], [], []))
                ids.append(doc_id)
                texts.append(part)
                skips.append(skipped)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                total += len(part) + 1
                if len(part) < len(text):
                    skipped += count_words(part)
                if total > size:  # the language with the most text goes
                    most = max(sizes, key=sizes.get)
                    total -= sizes.pop(most)
                    yield (most, *held.pop(most))
    for lang, rest in held.items():
        yield (lang, *rest)


def count_words(text: bytes) -> int:
    word = _WORD[np.frombuffer(text, np.uint8)]
    return int(np.count_nonzero(word[1:] & ~word[:-1]) + word[:1].sum())


def cut_text(text: bytes, size: int) -> list[bytes]:
    """Parts of about `size` bytes that end where a piece ends; a longer piece stays whole."""
    if len(text) <= size:
        return [text]
    cuts = np.flatnonzero(_ENDS[np.frombuffer(text, np.uint8)]) + 1
    out, begin = [], 0
    while len(text) - begin > size:
        k = np.searchsorted(cuts, begin + size, "right")
        end = int(cuts[k - 1]) if k and cuts[k - 1] > begin else int(cuts[k]) if k < len(cuts) else len(text)
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]] if begin < len(text) else out


def _rows_of(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _signed(prints: np.ndarray) -> pa.Array:
    return pa.array(prints.view(np.int64))


def sieve(rows: DataFrame, min_count: int, bits: int) -> DataFrame:
    """(fp): fingerprints of words and pairs with min_count occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, texts, _ in in_slices(batches, SLICE):
            words = Words(texts, bits)
            for n in range(1, LONGEST):
                found, counts = np.unique(words.grams(n, salt_of(lang))[1], return_counts=True)
                for k in range(0, len(found), BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([_signed(found[k : k + BATCH_ROWS]), pa.array(counts[k : k + BATCH_ROWS])], ["fp", "a"])

    return rows.mapInArrow(run, "fp long, a long").groupBy("fp").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count).select("fp")


def bit_table(fingerprints: DataFrame, n_bits: int) -> np.ndarray:
    """A table in which the bit of each fingerprint is set; at most n_bits / WORD rows come to the driver."""
    place = F.pmod("fp", F.lit(n_bits))
    words = fingerprints.select(F.expr(f"{n_bits}L").alias("n"), F.shiftright(place, 5).cast("int").alias("word"), F.pmod(place, F.lit(WORD)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    table = np.zeros(n_bits // WORD, np.uint32)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return table


def has_bit(table: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = np.mod(prints.view(np.int64), np.int64(len(table) * WORD))
    return (table[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1) == 1


def counted(rows: DataFrame, frequent: Broadcast, min_count: int, bits: int) -> DataFrame:
    """(lang, n, fp, a, low, high, pointer): fingerprints with their occurrences, checks and the first
    occurrence by document and place; n = 0 holds the number of all words of a language."""
    kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def rows_of(lang: str, ids: list, docs: np.ndarray, *numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        for k in range(0, len(docs), BATCH_ROWS):
            own = docs[k : k + BATCH_ROWS]
            arrays = [pa.array(x[k : k + BATCH_ROWS], t) for x, t in zip(numbers, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), *arrays, pa.array([ids[d] for d in own], kind)], ["lang", "n", "fp", "a", "low", "high", "place", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, texts, skipped in in_slices(batches, SLICE):
            words, salt = Words(texts, bits), salt_of(lang)
            yield from rows_of(lang, ids, np.zeros(1, np.int64), *([x] for x in (0, 0, len(words.starts), 0, 0, 0)))
            wide = None  # places where a frequent pair starts
            for n in range(1, LONGEST + 1):
                at, prints, checks = words.grams(n, salt)
                if n < LONGEST:
                    keep = has_bit(frequent.value, prints)
                else:
                    keep = wide[at] & wide[at + 1]
                at, prints, checks = at[keep], prints[keep], checks[keep]
                if n == 2:
                    wide = np.zeros(len(words.starts) + 1, bool)
                    wide[at] = True
                if not len(at):
                    continue
                by = np.argsort(prints, kind="stable")
                prints, checks, at = prints[by], checks[by], at[by]
                first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
                doc = np.searchsorted(words.firsts, at[first], "right") - 1
                place = at[first] - words.firsts[doc] + np.asarray(skipped)[doc]
                counts = np.diff(np.append(first, len(prints)))
                checked = np.minimum.reduceat(checks, first), np.maximum.reduceat(checks, first)
                yield from rows_of(lang, ids, doc, np.full(len(first), n), prints[first].view(np.int64), counts, *checked, place)

    found = rows.mapInArrow(run, f"lang string, n int, fp long, a long, low int, high int, place long, doc_id {rows.schema['doc_id'].dataType.simpleString()}")
    total = found.groupBy("lang", "n", "fp").agg(F.sum("a").alias("a"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("doc_id", "place")).alias("pointer"))
    return total.where((F.col("n") == 0) | (F.col("a") >= min_count))


def resolved(rows: DataFrame, pointers: DataFrame, bits: int) -> DataFrame:
    """(lang, n, fp, phrase) of pointers (lang, n, fp, pointer): the text where each one leads. Documents to which no
    pointer leads are left out before the shuffle; a document's pointers are no more than its words."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    spark = rows.sparkSession
    by_doc = pointers.groupBy("lang", F.col("pointer.doc_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("pointer.place", "n", "fp"))).alias("asked"))
    led = spark.sparkContext.broadcast(bit_table(pointers.select(_id_hash(F.col("pointer.doc_id")).alias("fp")), TABLE_BITS // 8))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = has_bit(led.value, batch.column("id_hash").to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(keep))

    held = rows.withColumn("id_hash", _id_hash(F.col("doc_id"))).mapInArrow(some, f"lang string, doc_id {kind}, text string, id_hash long")
    same = (held["lang"] == by_doc["lang"]) & held["doc_id"].eqNullSafe(by_doc["doc_id"])
    tied = held.join(by_doc, same).select(held["lang"], held["text"], "asked")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            texts = _text.as_bytes(batch.column("text"))
            for lang, text, asked in zip(batch.column("lang").to_pylist(), texts, batch.column("asked").to_pylist(), strict=True):
                words = Words([text], bits)
                known = {n: dict(zip(*(x.tolist() for x in words.grams(n, salt_of(lang))[:2]), strict=True)) for n in {a["n"] for a in asked}}
                for a in asked:
                    if known[a["n"]].get(a["place"]) == a["fp"] % (1 << 64):  # else another document with this id is meant
                        for column, x in zip(out, (lang, a["n"], a["fp"], words.phrase(a["place"], a["n"])), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["lang", "n", "fp", "phrase"])

    # Repeated ids may answer a pointer twice, with the same phrase unless it collides; those are counted anew.
    return tied.mapInArrow(read, "lang string, n int, fp long, phrase string").groupBy("lang", "n", "fp").agg(F.min("phrase").alias("phrase"))


def _id_hash(doc_id: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")))


def recounted(rows: DataFrame, collided: DataFrame, min_count: int, bits: int) -> DataFrame:
    """(lang, n, phrase, a): the phrases of fingerprints (lang, n, fp) that collide, counted by their texts."""
    meant = rows.sparkSession.sparkContext.broadcast(bit_table(collided.select("fp"), TABLE_BITS // 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, texts, _ in in_slices(batches, SLICE):
            words = Words(texts, bits)
            for n in range(1, LONGEST + 1):
                at, prints, _ = words.grams(n, salt_of(lang))
                keep = has_bit(meant.value, prints)
                found: dict[tuple[int, str], int] = {}
                for k, fp in zip(at[keep].tolist(), prints[keep].view(np.int64).tolist(), strict=True):
                    key = (fp, words.phrase(k, n))
                    found[key] = found.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array([f for f, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["lang", "n", "fp", "phrase", "a"],
                )

    found = rows.mapInArrow(run, "lang string, n int, fp long, phrase string, a long").groupBy("lang", "n", "fp", "phrase").agg(F.sum("a").alias("a"))
    return found.join(collided, ["lang", "n", "fp"], "left_semi").where(F.col("a") >= min_count).select("lang", "n", "phrase", "a")


def frequent_phrases(documents: DataFrame, min_count: int = 10, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bits: int = 64) -> DataFrame:
    """(lang, n, phrase, a): all words, pairs and triples with min_count occurrences or more in a language,
    and a row with n = 0 for each language with the number of its words. Fewer bits make fingerprints collide,
    which changes no result."""
    rows = _rows_of(documents, id_col, text_col, lang_col)
    context = rows.sparkSession.sparkContext
    frequent = context.broadcast(bit_table(sieve(rows, min_count, bits), TABLE_BITS))
    counts = _text.written(counted(rows, frequent, min_count, bits))
    words, grams = counts.where("n = 0").select("lang", "n", F.lit("").alias("phrase"), "a"), counts.where("n > 0")
    single = grams.where("low = high")
    phrases = single.select("lang", "n", "fp", "a").join(resolved(rows, single.select("lang", "n", "fp", "pointer"), bits), ["lang", "n", "fp"])
    out = words.unionByName(phrases.select("lang", "n", "phrase", "a"))
    collided = grams.where("low < high").select("lang", "n", "fp")
    return out if collided.isEmpty() else out.unionByName(recounted(rows, collided, min_count, bits))


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, n_words) of the pairs and triples of frequent_phrases()."""
    grams = frequent.where("n > 1").select("lang", "phrase", F.col("n").alias("n_words"), "a")
    cuts = grams.select("*", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    parts = frequent.where("n > 0").select("lang", F.col("phrase").alias("part"), F.col("a").alias("b"))
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(16,0)") for c in ("a", "l", "r"))
    cuts = cuts.withColumn("aa", a * a * F.lit(1000000).cast("decimal(7,0)")).withColumn("lr", l * r).withColumn("score", F.expr("aa div lr"))
    best = cuts.groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, cover_percent: int) -> DataFrame:
    """The scored phrases without those that lie in a longer one with cover_percent of their occurrences or more."""
    longer = phrases.where(f"n_words = {LONGEST}").select("lang", F.split("phrase", " ").alias("w"), F.col("a").alias("b"))
    inside = longer.select("lang", "b", F.explode(F.array(*[F.array_join(F.slice("w", k, LONGEST - 1), " ") for k in (1, 2)])).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("b").alias("most"))
    return phrases.join(most, ["lang", "phrase"], "left").where((F.col("n_words") == LONGEST) | F.col("most").isNull() | (100 * F.col("most") < cover_percent * F.col("a"))).drop("most")


def collocations(
    documents: DataFrame,
    min_count: int = 10,
    cover_percent: int = 50,
    top: int = 2000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    bits: int = 64,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases by score, occurrences and text; n is
    the language's number of words. The best of each language are chosen in parts first, with all ties."""
    frequent = _text.written(frequent_phrases(documents, min_count, id_col, text_col, lang_col, bits))
    phrases = _text.written(scored(frequent))
    kept = uncovered(phrases, cover_percent)
    by = Window.partitionBy("lang", "deal").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    for deals in DEALS:
        kept = kept.withColumn("deal", _text.bucket(F.col("phrase"), deals)).withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= top)
    totals = frequent.where("n = 0").select("lang", F.col("a").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
