"""Manifests, fingerprints and collocations against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import collocations as col
from trackloom.llm import fingerprints as fp
from trackloom.llm import merkle
from trackloom.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row: dict) -> str:
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def prove(digests: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of a list of digests, and each one's siblings (before, after), level by level."""
    paths = [[] for _ in digests]
    under = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        runs = [range(k, min(k + arity, len(digests))) for k in range(0, len(digests), arity)]
        for run in runs:
            for k in run:
                step = "".join(digests[j] for j in run if j < k), "".join(digests[j] for j in run if j > k)
                for leaf in under[k]:
                    paths[leaf].append(step)
        under = [[x for k in run for x in under[k]] for run in runs]
        digests = [sha("".join(digests[k] for k in run)) for run in runs]
    return digests[0], paths


def brute_manifest(rows: list[dict], arity: int) -> list[tuple]:
    groups = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = []
    for g in groups:
        mine = sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        held.append((mine, *prove([leaf_of(r) for r in mine], arity)))
    root, above = prove([h[1] for h in held], arity) if held else (None, [])
    return sorted(
        ((r["doc_id"], leaf_of(r), sub, root, [*path, *up]) for (mine, sub, paths), up in zip(held, above, strict=True) for r, path in zip(mine, paths, strict=True)),
        key=str,
    )


def some_rows(n: int, seed: int) -> list[dict]:
    rng = random.Random(seed)
    return [
        {
            "doc_id": rng.choice([None, rng.randrange(50), k]),
            "text": rng.choice([None, "", f"Text {k} é", "x" * rng.randrange(400)]),
            "lang": rng.choice([None, "", "de", "en", "en", "en", "ü"]),
            "source": rng.choice([None, "web"]),
            "n_chars": rng.choice([None, 0, k]),
        }
        for k in range(n)
    ]


@pytest.mark.parametrize(("n", "arity"), [(0, 8), (1, 8), (9, 8), (150, 8), (40, 2), (60, 3)])
def test_manifest(spark, n, arity):
    rows = some_rows(n, n)
    docs = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    docs = docs.withColumns({c: F.lit(1) for c in ("tree", "at", "n", "path", "digest", "leaf")})
    got = merkle.merkle_manifest(docs, FIELDS, arity=arity).collect()
    want = brute_manifest(rows, arity)
    have = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["path"]]) for r in got), key=str)
    assert have == want


def test_claims(spark):
    """A changed text no longer leads to the root; a text that stays the same does."""
    docs = spark.createDataFrame([(k, "Ab" if k % 2 else "ab", "en", None, 2) for k in range(20)], SCHEMA)
    claim = merkle.leaf_digest([merkle.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    found = merkle.merkle_manifest(docs, FIELDS, claims={"claim": claim})
    ok = {r["doc_id"]: r["ok"] for r in found.select("doc_id", (merkle.folded(F.col("claim"), F.col("path")) == F.col("root")).alias("ok")).collect()}
    assert ok == {k: k % 2 == 0 for k in range(20)}


def brute_signature(text: str, size: int) -> list[int]:
    """Phrases as a set of strings; hashes by the operator's own polynomial."""
    phrases, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in phrases:
            phrases.add(text[start:end])
            start = end
    hashes = []
    for p in phrases:
        h = fp._EMPTY
        for c in p:
            h = (h * fp._BASE + ord(c) + 1) % fp._PRIME
        hashes.append(h)
    import numpy as np

    return np.unique(fp._text.mix(np.array(hashes, dtype=np.uint64)) >> np.uint64(32))[:size].tolist()


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaaaa", "abababababab", "the cat the cat the dog", "\U0001f600é" * 9, "x" * 5000])
def test_signature(text):
    assert fp.signature(text).tolist() == brute_signature(text, fp.SIZE)
    assert fp.likeness(fp.signature(text), fp.signature(text)) == 1.0


def brute_edits(rows: list[tuple], size: int = fp.SIZE) -> list[tuple]:
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = (set(brute_signature(t, 10**9)) for t in (text, edited, after))
        a128, b128, c128 = (sorted(x)[:size] for x in (a, b, c))

        def like(x, y):
            least = sorted(set(x) | set(y))[:size]
            return float(not x and not y) if not x or not y else len([h for h in least if h in x and h in y]) / len(least)

        out.append((doc_id, len(text), sha(edited), "".join(f"{h:08x}" for h in a128), "".join(f"{h:08x}" for h in b128), like(a128, b128), like(a128, c128)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 60])
def test_edits(spark, n):
    rng = random.Random(n)
    rows = [(None if k == 0 else 7 * k - 30, rng.choice([None, "", "b", "word " * rng.randrange(900), " ".join(rng.choices("the of a in é\U0001f600 lorem".split(), k=rng.randrange(700)))])) for k in range(n)]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("part", "hash", "borrowed", "n_chars")})
    got = fp.compare_edits(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_edits(rows)
    kept = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprint_documents(docs).collect()}
    assert kept == {r["doc_id"]: r["fingerprint"] for r in got.collect()}


def test_edits_of_repeated_rows(spark):
    """Rows that agree in id and text stand next to each other; each still has one successor."""
    docs = spark.createDataFrame([(1, "some text here")] * 30 + [(2, "other words")] * 30, "doc_id long, text string").repartition(5)
    got = fp.compare_edits(docs).collect()
    assert len(got) == 60 and sum(r["near_next"] < 1 for r in got) == 2


def brute_collocations(docs: list[tuple], least: int, cover: int, top: int) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for _, text, lang in docs:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                own.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        total = sum(v for k, v in f.items() if len(k) == 1)
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            longer = [b for t, b in cands.items() if len(t) > len(p) and any(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1))]
            if any(100 * b >= cover * a for b in longer):
                continue
            score, _, lft, rgt = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), lft, rgt))
        for rank, (score, a, phrase, lft, rgt) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, lft, rgt, total, -score))
    return sorted(out)


def some_texts(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["The", "the", "of", "New", "York", "é", "a b", "x" * 40, *[f"w{k}" for k in range(12)]]
    out = []
    for k in range(n):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice([None, k, 3]), rng.choice([None, "", body, body, body]), rng.choice([None, "und", "en", "en", "fr"])))
    return out


@pytest.mark.parametrize("bits", [64, 12, 4])
def test_collocations(spark, bits):
    """Also where fingerprints collide."""
    docs = some_texts(300, 5)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("n", "fp", "a", "rank", "phrase")}).repartition(6)
    for least, cover, top in ((10, 50, 2000), (2, 80, 7)):
        got = col.collocations(frame, least, cover, top, bits=bits)
        assert sorted(tuple(r) for r in got.collect()) == brute_collocations(docs, least, cover, top)


def test_collocations_hand_on_small_batches(spark, monkeypatch):
    """A slice's rows leave a task in batches of bounded size, with the same counts."""
    rows = col._rows_of(spark.createDataFrame([(k, " ".join(f"w{k * j % 97}" for j in range(300)), "en") for k in range(20)], "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    table, batches = rows.toArrow().to_batches(), {}

    class Taken:
        schema = rows.schema

        def mapInArrow(self, run, kind):
            taken.extend(run(iter(table)))
            raise StopIteration

    class Bits:
        value = np.full(1 << 10, 0xFFFFFFFF, np.uint32)

    for size in (10**6, 100):
        monkeypatch.setattr(col, "BATCH_ROWS", size)
        taken = []
        with pytest.raises(StopIteration):
            col.counted(Taken(), Bits, 1, 64)
        assert max(b.num_rows for b in taken) <= size
        batches[size] = sorted((tuple(r.values()) for b in taken for r in b.to_pylist()), key=repr)
    assert batches[100] == batches[10**6]


def test_collocations_of_nothing(spark):
    assert col.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    assert col.collocations(spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")).count() == 0


def test_cut_texts():
    text = b"ab cd. ef gh, " * 50 + b"x" * 300 + b". tail"
    parts = col.cut_text(text, 40)
    assert b"".join(parts) == text and all(p[-1:] in b".," for p in parts[:-1])
    assert sum(col.count_words(p) for p in parts) == len(re.findall(rb"[^\x20\x09.,]+", text))


def test_long_texts_are_cut():
    """Pointers into later parts of a cut text lead to the right words."""
    docs = [(k, "New York is big. " * 9 + "over the sea, " * 7, "en") for k in range(4)]

    def local(batches):  # in the driver, where the slice is small
        return list(col.in_slices(batches, 64))

    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t, "lang": x} for d, t, x in docs])
    for _, ids, texts, skipped in local([batch]):
        for i, t, s in zip(ids, texts, skipped, strict=True):
            whole = re.findall(rb"[^\x20\x09.,]+", docs[i][1].encode().lower())
            part = re.findall(rb"[^\x20\x09.,]+", t.lower())
            assert whole[s : s + len(part)] == part


@pytest.mark.parametrize("name", ["op11_merkle", "op12_fingerprints", "op13_collocations"])
def test_whole_query(spark, name):
    """The queries over a whole small table: a row for each document, or ranks without gaps."""
    sf = "/root/testdata/sf0.001"
    got = q.queries()[name](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    if name == "op13_collocations":
        for _, part in got.groupby("lang"):
            assert sorted(part["rank"]) == list(range(1, len(part) + 1))
        return
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    if name == "op12_fingerprints":
        rows = sorted(zip(docs["doc_id"].tolist(), docs["text"].tolist(), strict=True))
        assert sorted((tuple(r) for r in got.itertuples(index=False)), key=str) == brute_edits(rows)
