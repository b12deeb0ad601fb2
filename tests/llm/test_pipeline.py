"""The pipeline's stages against brute force, each on the input it had."""

import re
import zlib
from collections import defaultdict

from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_more import brute_lines, brute_spans
from trackloom.llm import _text, toxicity
from trackloom.llm import queries as q

SF = "/root/testdata/sf0.001"


def redacted(text):
    merged, want, done = [], "", 0
    for a, _, kind, b in sorted(brute_spans(text), key=lambda s: (s[0], s[3], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([a, kind, b])
    for a, kind, b in merged:
        want, done = want + text[done:a] + f"[{kind}]", b
    return want + text[done:]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(_text.written(stage(spark, tables[-1], SF)))
    held = [{r.doc_id: r.asDict() for r in t.collect()} for t in tables[:5]]
    assert all(t.columns == columns for t in tables[:5])
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def toxic(text):
        return model.score(sum(model.weight(w) for w in toxicity.words_of(text))) >= 0.3

    assert set(held[1]) == {d for d, r in held[0].items() if not toxic(r["text"])} and len(held[1]) < len(held[0])
    docs1 = [(d, r["text"]) for d, r in held[1].items()]
    want = {d: t for (d, _), (t, _, n) in zip(docs1, brute_lines(docs1), strict=True) if not n or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {d: r["text"] for d, r in held[2].items()} == want
    want = {d for d, _, c in brute_components([(d, r["text"]) for d, r in held[2].items()]) if d == c}
    assert set(held[3]) == want
    assert {d: r["text"] for d, r in held[4].items()} == {d: redacted(r["text"]) for d, r in held[3].items()}
    assert all(r["n_chars"] == len(r["text"]) for r in held[4].values())
    tokenizer, pieces = Tokenizer.from_file(q.WORDS), defaultdict(list)
    for r in tables[5].collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(held[4])
    for d, r in held[4].items():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        assert sum(p.length for p in pieces[d]) == len(ids)
        for p in pieces[d]:
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[p.start : p.start + p.length]))
    assert corpus_pipeline.run(spark, SF).count() == tables[5].count()


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "no id here", "en", "s", 0), (3, "same text twice over", "en", "s", 0), (3, "same text twice over", "en", "s", 0), (4, "same text twice over", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = _text.written(stage(spark, docs, SF))
        assert {r.doc_id for r in docs.collect()} >= {None, 1, 2, 3}, name
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 2, 3]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0) if "text" in docs.columns else docs, SF).count() == 0


def brute_keepers(docs, size=5, percent=80):
    """Ids that stay of [(doc_id, text)]: the smallest of each component of near copies."""
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    least, where = {d: d for d, _ in docs}, defaultdict(list)
    pairs = set()
    for i, s in enumerate(sets):
        pairs |= {(j, i) for t in s for j in where[t]}
        for t in s:
            where[t].append(i)
    links = [(docs[i][0], docs[j][0]) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return {d for d, low in least.items() if d == low}


def test_near_copies_of_five_words(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    words = [f"w{k}" for k in range(100)]
    edited = [*words[:30], "x", *words[31:70], "y", *words[71:]]  # 86 of 106 shingles of 5 words, 89 of 105 of 4 words
    docs += [(10**6, " ".join(words)), (10**6 + 1, " ".join(edited))]
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, frame, SF).collect()}
    assert got == brute_keepers(docs) and 10**6 in got and 10**6 + 1 not in got
