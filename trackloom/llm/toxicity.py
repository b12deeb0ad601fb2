"""Toxicity by a noisy channel: words that look disguised (leetspeak, spaced letters, repeated letters)
become character lattices, Viterbi decodes them under a character bigram model of the corpus, and
the restored words are scored.

Signs that can stand for letters, runs of one letter and separators between letters are alternatives of
one lattice: a separator is left out or ends a word, so spaced letters are put together where the
letter model says so. Words of any length are decoded, in time and memory linear in the length.

The bigram model counts every document. It knows the letters of all alphabets below LETTERS; pairs are
told apart within a script, so it holds at most 1.5 million of them (see SCRIPTS). Ideographs and other
signs from LETTERS on count as no letter, as no sign stands for them. The classifier is fitted on a
bounded sample: the MAX_TRAIN labelled training rows of smallest id hash, whole texts; every feature
that passes the tests is kept. Scoring runs inside the tasks that read the documents. A null text counts
as empty and gets the score of a text without any known word. A null label isn't learned from; of
several labels for an id the largest counts; without a toxic and a clean training row every score is
0. Repeated and null ids give one row for each input row."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm import _text

#: Code points below this can be letters of the model; 0 stands for anything else.
LETTERS = 0x2000
#: Where scripts begin: Latin, phonetic signs, Greek, Cyrillic, then blocks of 128 code points.
SCRIPTS = np.array([0, 0x250, 0x370, 0x400, 0x530, *range(0x580, LETTERS, 0x80)])
#: Latin letters, whose pairs are counted in a dense table.
LATIN = 0x250
#: Bound on the labelled rows the classifier is fitted on.
MAX_TRAIN = 20_000
#: Bound on the words whose weight a Python worker remembers, and on the features it counts before it passes them on.
MEMO_WORDS = 400_000
#: Lengths of word starts that are features.
STARTS = (4, 5, 6)

#: Letters that a sign can stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "*": "aeiou"}
#: Signs put between the letters of a word; the log probability of each so used is -1.
SEPARATORS = " ._-*"
_LEET_CLASS = "".join(re.escape(c) for c in LEET)
_EDGE = ".,;:?!\"'()[]{}«»#%&*|<>"
_SIGN = rf"(?:[^\W\d_]|[{_LEET_CLASS}])"
_DISGUISED = re.compile(
    rf"[^\W\d_][{_LEET_CLASS}]+[^\W\d_]|^[{_LEET_CLASS}][^\W\d_]{{2,}}|[^\W\d_]{{2,}}[{_LEET_CLASS}]|([^\W\d_])\1\1|{_SIGN}[ ._*-]{{1,3}}[^\W\d_]|[^\W\d_][ ._*-]{{1,3}}{_SIGN}"
)
_SPACED = re.compile(rf"(?<!\S)(?:{_SIGN}[ ._*-]{{1,3}}){{2,}}{_SIGN}(?![^\s.,;:?!])")
_LETTER_TABLE = np.array([c if chr(c).isalpha() and chr(c) == chr(c).lower() else 0 for c in range(LETTERS)] + [0], dtype=np.int32)
_SCRIPT = np.searchsorted(SCRIPTS, np.arange(LETTERS), "right").astype(np.uint8)
#: Signs whose pairs are counted in one go.
_STEP = 1 << 18


def letter(sign: str) -> int:
    """The sign as a letter of the model."""
    return int(_LETTER_TABLE[min(ord(sign), LETTERS)])


def letter_pairs(texts: list[str]) -> Iterator[np.ndarray]:
    """before * LETTERS + after for all neighbouring signs of lower-cased texts, step by step; a letter of
    another script than the one before follows no letter."""
    text = " ".join(["", *texts, ""]).lower()
    for k in range(0, len(text) - 1, _STEP):
        codes = np.frombuffer(text[k : k + _STEP + 1].encode("utf-32-le", "replace"), dtype=np.uint32)
        letters = _LETTER_TABLE[np.minimum(codes, LETTERS)]
        before, after = letters[:-1], letters[1:]
        yield np.where((after == 0) | (_SCRIPT[before] == _SCRIPT[after]), before, 0) * np.int32(LETTERS) + after


def bigram_counts(documents: DataFrame) -> DataFrame:
    """(pair, n): how often letters follow each other in (doc_id, text), over all documents."""
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])

    def run(batches):
        latin = np.zeros(LATIN * LATIN, dtype=np.int64)
        other: Counter[int] = Counter()
        for batch in batches:
            for part in _text.slices(batch):
                for pairs in letter_pairs(_text.as_strings(part.column("text"))):
                    before, after = pairs // LETTERS, pairs % LETTERS
                    plain = (before < LATIN) & (after < LATIN)
                    latin += np.bincount((before * LATIN + after)[plain], minlength=LATIN * LATIN)
                    for pair, n in zip(*map(np.ndarray.tolist, np.unique(pairs[~plain], return_counts=True)), strict=True):
                        other[pair] += n
        at = np.flatnonzero(latin)
        pair = [*(at // LATIN * LETTERS + at % LATIN).tolist(), *other]
        yield pa.RecordBatch.from_pydict({"pair": pair, "n": [*latin[at].tolist(), *other.values()]}, schema=schema)

    return documents.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LetterModel:
    """Log probabilities of a letter after another: of pairs that occur, and of others by the letter before."""

    pairs: dict[int, float]
    unseen: dict[int, float]
    nowhere: float

    def follow(self, before: int, after: int) -> float:
        held = self.pairs.get(before * LETTERS + after)
        return self.unseen.get(before, self.nowhere) if held is None else held


def bigram_model(counts: DataFrame) -> LetterModel:
    """The model of counted pairs, smoothed by adding a half to each letter that occurs."""
    table = counts.toArrow()  # at most 1.5 million rows, as pairs are within a script
    pair, n = np.asarray(table["pair"], dtype=np.int64), np.asarray(table["n"], dtype=np.float64)
    letters, at = np.unique(pair // LETTERS, return_inverse=True)
    size = 0.5 * (len(np.unique(pair % LETTERS)) + 1)
    total = np.bincount(at, weights=n, minlength=len(letters)) + size
    logs = np.log((n + 0.5) / total[at]) if len(pair) else n
    unseen = dict(zip(letters.tolist(), np.log(0.5 / total).tolist(), strict=True))
    return LetterModel(dict(zip(pair.tolist(), logs.tolist(), strict=True)), unseen, math.log(0.5 / size))


def lattice(word: str, joined: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of one sign in a disguised word: what it may stand for, and the log probability of
    writing it so. A blank ends a word; `joined` leaves out the readings where a single separator does."""
    out = []
    for run in re.finditer(r"(.)\1*", word, re.DOTALL):
        sign, n = run.group(1), len(run.group(0))
        letters = [(sign, 0.0)] if sign.isalpha() else [(c, -1.0) for c in LEET.get(sign, "")]
        if sign in SEPARATORS:
            ends, dropped = (" ", 0.0), ("", -1.0 * n)
            out.append([dropped, *letters] if joined and n == 1 else [ends, dropped, *(letters if n == 1 else [])])
        elif not letters:
            out.append([("", -2.0)])
        elif n < 3:
            out.append([(c * n, cost) for c, cost in letters])
        else:
            out.append([(c * k, cost - 0.5 * k) for c, cost in letters for k in (1, 2)])
    return out


def decode(word: str, model: LetterModel, joined: bool = False) -> str:
    """The likeliest restored text: Viterbi over the lattice, by the last letter. Where one state is left,
    what led to it is final, so only the open part of the path is kept."""
    done: list[str] = []
    best: dict[int, float] = {0: 0.0}
    trail: list[dict[int, tuple[int, str]]] = []  # for each open run: the state before, and the letters

    def path(last: int) -> str:
        parts = []
        for back in reversed(trail):
            last, letters = back[last]
            parts.append(letters)
        return "".join(reversed(parts))

    for options in lattice(word, joined):
        new: dict[int, float] = {}
        back: dict[int, tuple[int, str]] = {}
        for last, score in best.items():
            for letters, cost in options:
                total, at = score + cost, last
                for c in letters:
                    code = letter(c)
                    total += model.follow(at if _SCRIPT[at] == _SCRIPT[code] or not code else 0, code)
                    at = code
                if at not in new or total > new[at]:
                    new[at], back[at] = total, (last, letters)
        trail.append(back)
        if len(new) == 1:
            done.append(path(*new))
            trail.clear()
        best = new
    last = max(best, key=lambda at: best[at] + model.follow(at, 0))
    return "".join(done) + path(last)


def restored(word: str, model: LetterModel) -> list[str]:
    """The words that a lower-case word, or a stretch of spaced letters, may have been meant to be: those of
    the likeliest reading, then others of the likeliest one that joins what single separators part."""
    core = word.rstrip(_EDGE).lstrip(".,;:?\"'()[]{}«»#%&*<>")
    if not core:
        return []
    if not _DISGUISED.search(core):
        return [core]
    found = decode(core, model).split()
    if any(c in SEPARATORS for c in core):
        found += [w for w in decode(core, model, joined=True).split() if w not in found]
    return found


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a text as written, and its stretches of spaced letters."""
    text = text.lower()
    return set(text.split()).union(run for run in _SPACED.findall(text) if any(map(str.isalpha, run)))


def features(word: str) -> list[str]:
    """The whole word, and its starts."""
    return ["=" + word, *[word[:k] for k in STARTS if len(word) >= k]]


@dataclass(frozen=True)
class ToxicityModel:
    """Bigram model, feature weights, and slope and offset of the logistic curve."""

    bigrams: LetterModel
    weights: dict[str, float]
    slope: float
    offset: float

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for core in restored(word, self.bigrams) for f in features(core)), default=0.0)

    def evidence(self, text: str, memo: dict[str, float]) -> float:
        """The sum of the weights of a text's distinct words, each by its best feature."""
        found = []
        for word in words_of(text):
            w = memo.get(word)
            if w is None:
                w = self.weight(word)
                if len(word) <= 64:
                    memo[word] = w
            if w:
                found.append(w)
        return math.fsum(found)  # whatever the order of the words

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * evidence + self.offset))))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(text, toxic) of at most max_train labelled ids that aren't held out."""
    ids = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("toxic")).where("doc_id is not null and toxic is not null")
    ids = ids.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return documents.join(F.broadcast(ids), "doc_id").select("text", "toxic")  # max_train rows at most


def feature_counts(train: DataFrame, bigrams) -> DataFrame:
    """(feature, toxic, clean): in how many toxic and clean rows of (text, toxic) each feature occurs."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def counted():
            names = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_pydict({"feature": names, "toxic": [counts[1][f] for f in names], "clean": [counts[0][f] for f in names]}, schema=schema)
            for held in counts:
                held.clear()
            return out

        for batch in batches:
            for text, toxic in zip(_text.as_strings(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic > 0].update({f for word in words_of(text) for core in restored(word, bigrams.value) for f in features(core)})
                if len(counts[0]) + len(counts[1]) > MEMO_WORDS:
                    yield counted()
        yield counted()

    found = train.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def surprise(a: Column, n_a: int, b: Column, n_b: int) -> Column:
    """The log-likelihood ratio of features in a of n_a toxic and b of n_b clean rows."""
    total = (a + b) / F.lit(float(n_a + n_b))

    def part(k, n, p):
        return F.when(k > 0, k * F.log(k / (F.lit(float(n)) * p))).otherwise(0.0)

    return 2 * (part(a, n_a, total) + part(b, n_b, total) + part(n_a - a, n_a, 1 - total) + part(n_b - b, n_b, 1 - total))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    beta, rows = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        ridge = 1e-2 * np.eye(2)
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + ridge, rows.T @ (y - p) - ridge @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def fit_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, min_rows: int = 3) -> ToxicityModel:
    """Learns the bigram model from all documents and the weights from labelled ones that aren't held
    out. A feature needs min_rows toxic rows and a log-likelihood ratio of 12."""
    texts = _text.texts_of(documents, id_col, text_col)
    context = texts.sparkSession.sparkContext
    model = bigram_model(bigram_counts(texts))
    train = _text.written(training_rows(texts, labels, max_train))
    sizes = {r.toxic: r.n for r in train.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(model, {}, 0.0, -30.0)
    bigrams = context.broadcast(model)
    toxic, clean = F.col("toxic").cast("double"), F.col("clean").cast("double")
    odds = F.log((toxic + 0.1) / (n_toxic + 0.2)) - F.log((clean + 0.5) / (n_clean + 1))
    telling = feature_counts(train, bigrams).where(toxic >= min_rows).where((odds > 1) & (surprise(toxic, n_toxic, clean, n_clean) > 12))
    # The sample's telling features: their number is bounded by the texts of max_train rows.
    weights = {r.feature: r.odds for r in telling.select("feature", odds.alias("odds")).orderBy("feature").collect()}
    plain = context.broadcast(ToxicityModel(model, weights, 1.0, 0.0))

    def evidence(batches):
        memo: dict[str, float] = {}
        for part in batches:
            yield pd.DataFrame({"x": [plain.value.evidence(t or "", memo) for t in part["text"]], "y": (part["toxic"] > 0).astype(float)})

    pairs = train.mapInPandas(evidence, "x double, y double").toPandas()  # max_train rows at most
    return ToxicityModel(model, weights, *_logistic(pairs["x"].to_numpy(), pairs["y"].to_numpy()))


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_toxicity(documents: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, float] = {}

    def kernel(batch: pa.RecordBatch) -> dict[str, list]:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        held = shared.value
        scores = [held.score(held.evidence(t, memo)) for t in _text.as_strings(batch.column("text"))]
        return {"doc_id": batch.column("doc_id").to_pylist(), "score": scores}

    return _text.map_texts(_text.texts_of(documents, id_col, text_col), kernel, "doc_id long, score double", _SCORED)


def reject_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, that score below the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo: dict[str, float] = {}
        for batch in batches:
            for part in _text.slices(batch, text_col):
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                held = shared.value
                keep = [held.score(held.evidence(t, memo)) < threshold for t in _text.as_strings(part.column(text_col))]
                yield part.filter(pa.array(keep, type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
