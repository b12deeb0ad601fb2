"""Queries held against brute force on sf0.001 and small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trackloom.llm import bpe, licenses, packing, quality
from trackloom.llm import queries as q

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words int, labels string, ids int"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def odd_rows():
    """Nulls, empty and long texts, repeated rows, columns with clashing names."""
    long = "Gnu General public LICENSE " * 3000 + "x" * 20000
    texts = [None, "", "  \n\t ", "one", long, long, "é\xa0ü  \x1c z\x85 '", "The MIT License\nThe MIT License", "CC BY 4.0", "same same same same same same same same same same"]
    rows = [(k, t, 1, "x", 2) for k, t in enumerate(texts)] + [(None, "null id text", 1, "x", 2), (3, "one", 1, "x", 2)]
    return rows


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def test_licenses(spark, docs):
    got = {r["doc_id"]: r for r in rows(q.op1_licenses(spark, SF))}
    assert len(got) == len(docs)
    seen = Counter()
    for d, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        base = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == (min([k for k, _ in base], default=None), max([k for k, _ in base], default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert {x for _, x in base} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        seen.update(x for _, x in base)
    assert seen


def test_license_spans(spark):
    text = "permission is hereby granted free of charge to any person FOO obtaining a copy of this software and associated documentation files"
    frame = spark.createDataFrame([(1, text), (2, "unrelated words only")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(frame, min_share=0.3))}
    (span,) = got[1]["spans"]
    assert (span["label"], span["start"], span["end"], span["covered"]) == ("mit", 0, 21, 20) and not got[2]["spans"]


def test_many_templates(spark):
    rng = random.Random(4)
    templates = {f"l{k}": [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 30)))] for k in range(150)}
    picked = [(k, f"before {templates[f'l{k}'][0].upper()} after") for k in range(150)]
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(spark.createDataFrame(picked, "doc_id long, text string"), templates=templates))}
    for k, text in picked:
        n = len(text.split()) - 2
        assert (f"l{k}", 1, 1 + n, n, 1.0) in {(s["label"], s["start"], s["end"], s["covered"], s["share"]) for s in got[k]["spans"]}


def test_whole_licence_texts(spark):
    texts = [(k, "intro words\n" + t) for k, t in enumerate(licenses.FULL_TEXTS.values())]
    got = {r["doc_id"]: r for r in rows(licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")))}
    for k, (label, text) in enumerate(licenses.FULL_TEXTS.items()):
        n = len(licenses.tokens_of(text))
        assert (label, 2, 2 + n, 1.0) in {(s["label"], s["start"], s["end"], s["share"]) for s in got[k]["spans"]}


def brute_quality(text):
    words = WORD.findall(text)
    counts = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    often = {j for k in range(len(words) - 4) if counts[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(often)


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in rows(q.op2_quality(spark, SF))}
    for d, text in docs:
        r, want = got[d], brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert quality.repeated_words([w.encode() for w in words]) == brute_quality(" ".join(words))[4]


def test_quality_ablation(spark):
    ledger = spark.createDataFrame([(1,), (3,), (4,), (0,)], "fail_bits long")
    got = {r["rule"]: (r["n_failed"], r["n_only"]) for r in rows(quality.ablation(ledger, "v2"))}
    assert got["too_few_words"] == (2, 1) and got["repeated_windows"] == (1, 0) and got["many_symbols"] == (1, 1)
    assert set(got) == set(quality.POLICIES["v2"])


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(q.RANKS), special_tokens={})


def test_bpe(spark, docs, tik):
    got = {r["doc_id"]: r for r in rows(q.op3_bpe(spark, SF))}
    for d, text in docs:
        ids = tik.encode_ordinary(text)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(packed).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_round_trip(spark):
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    encoded = bpe.bpe_encode(frame, q.RANKS, public_tokenizers.PATTERN)
    got = sorted((bytes(r.decoded) for r in bpe.bpe_decode(encoded, q.RANKS).collect()))
    assert got == sorted((t or "").encode() for _, t, *_ in odd_rows())
    assert bpe.bpe_encode(frame.limit(0), q.RANKS, public_tokenizers.PATTERN, decode=True).collect() == []


def test_odd_rows(spark):
    frame = spark.createDataFrame(odd_rows(), SCHEMA)
    n = frame.count()
    assert licenses.scan_licenses(frame).count() == n and licenses.scan_licenses(frame.limit(0)).collect() == []
    ledger = {(r.doc_id, r.n_words): r for r in quality.quality_ledger(frame).collect()}
    assert len(quality.quality_ledger(frame).collect()) == n and quality.quality_ledger(frame.limit(0)).collect() == []
    assert ledger[0, 0].n_repeat_words == 0 and ledger[9, 10].n_repeat_words == 10
    pieces = packing.pack_documents(frame, q.WORDS).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in odd_rows()} and all(0 < r.length <= 4096 for r in pieces)
    assert sum(r.doc_id == 3 for r in pieces) == 2 and sum(r.doc_id == 0 for r in pieces) == 1
    assert packing.pack_documents(frame.limit(0), q.WORDS).collect() == []


@pytest.fixture(scope="module")
def codec():
    return bpe.MergeReplay(bpe.read_ranks(q.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def decoder():
    return bpe.TokenBytes(bpe.read_ranks(q.RANKS))


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aab ehlo't\n  \t\x1c\x85\xa0 é12!"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_any_text(codec, decoder, tik, text):
    (ids,) = codec.encode([text])
    assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == tik.encode_ordinary(text)
    assert decoder.decode(ids) == text.encode()


def test_packing(spark, docs):
    tokenizer = Tokenizer.from_file(q.WORDS)
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in rows(q.op8_packing(spark, SF)):
        got[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for d, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        pieces = sorted(got[d], key=lambda r: r["piece"])
        total += len(ids)
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, k * 4096, len(ids[k * 4096 : (k + 1) * 4096])) for k in range(-(-len(ids) // 4096))]
        for r in pieces:
            part = b"".join(i.to_bytes(4, "little") for i in ids[r["start"] : r["start"] + r["length"]])
            assert r["ids_crc32"] == zlib.crc32(part)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-total // 4096) * 1.05 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_tightest_open_sequence(lengths):
    tree, fill = packing.OpenSequences(32), []
    for n in sorted(lengths, reverse=True):
        room = [32 - f for f in fill if 32 - f >= n]
        assert tree.tightest(n) == min(room, default=-1)
        sequence, offset = tree.place(n)
        if sequence == len(fill):
            fill.append(0)
        assert fill[sequence] == offset and (not room or 32 - offset == min(room))
        fill[sequence] += n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab Éé'1!\ńΣσ"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_word_memo(texts):
    memo, tokenizer = packing.WordMemoTokenizer(q.WORDS), Tokenizer.from_file(q.WORDS)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [[int.from_bytes(x[k : k + 4], "little") for k in range(0, len(x), 4)] for x in memo.encode([t.encode() for t in texts])] == want
