"""Substring dedup against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from trackloom.llm import queries as q
from trackloom.llm import substring


def brute(docs, n=13):
    least = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (d, _), w in zip(docs, split, strict=True):
        if d is not None:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(docs, split, strict=True):
        gone = set()
        if d is not None:
            for k in range(len(w) - n + 1):
                if least[tuple(w[k : k + n])] < d:
                    gone.update(range(k, k + n))
        out.append((d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in q.op5_substrings(spark, f"/root/testdata/{sf}").collect()), key=str)
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(docs)]
    assert got == sorted(want, key=str) and sum(k for _, _, k, _ in want) > 0


def test_smallest_documents(monkeypatch):
    """Streamed past one automaton or many, each window gets the smallest document that has it."""
    rng = random.Random(2)
    passages = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(60)]
    least = np.array([rng.randrange(40) for _ in passages], dtype=np.int64)
    want = []
    for p in passages:
        for end in range(1, len(p) + 1):
            w = p[end - 4 : end] if end >= 4 else None
            want.append(min((d for q, d in zip(passages, least, strict=True) for k in range(len(q) - 3) if w and q[k : k + 4] == w), default=np.iinfo(np.int64).max))
    for words in (10**6, 50, 1):
        monkeypatch.setattr(substring, "SHARD_WORDS", words)
        assert substring.smallest_documents(passages, least, 4).tolist() == want


@pytest.mark.parametrize("hot", [64, 1, 0])
def test_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT_GROUPS", hot)
    monkeypatch.setattr(substring, "SHARD_WORDS", [10**6, 200, 1000][hot % 3])
    monkeypatch.setattr(substring, "GROUP_BYTES", 2000)
    rng = random.Random(9)
    word = lambda k=200: f"w{rng.randrange(k)}"
    passages = [[word() for _ in range(rng.randrange(10, 60))] for _ in range(8)] + [["la"] * 30]
    texts = []
    for _ in range(150):
        t = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(0, len(p) // 2)
            t += [word(10**6) for _ in range(rng.randrange(0, 6))] + p[a : a + rng.randrange(5, 60)]
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    texts += [None, "", " \t", "one two", texts[0], "é " * 40, " ".join(word(3) for _ in range(3000)), "x" * 50000]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    docs += [(None, texts[1]), docs[0], (7, texts[2])]
    frame = spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, p int, shard string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.drop_repeated_substrings(frame).collect()), key=str)
    assert got == brute(docs)
    assert substring.drop_repeated_substrings(frame.limit(0)).collect() == []


def test_windows_of_frequent_anchors_reach_no_shard(spark, monkeypatch):
    """With every anchor frequent, windows are compared by their words alone; a shard that got rows would fail."""

    def failing(window):
        def run(table):
            raise AssertionError(f"{len(table)} rows in a shard")

        return run

    monkeypatch.setattr(substring, "HOT_GROUPS", 0)
    monkeypatch.setattr(substring, "shard_matches", failing)
    docs = [(k, " ".join(f"w{(k % 3) * j % 50}" for j in range(40)) + f" own{k} " + " ".join(["la"] * 20)) for k in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.drop_repeated_substrings(frame).collect()), key=str)
    assert got == brute(docs)
