"""Toxicity against full enumeration of lattices and a plain-Python fit and score."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pyarrow as pa
import pytest

from trackloom.llm import queries as q
from trackloom.llm import toxicity as tox

SF = "/root/testdata/sf0.001"
WORDS = "idiot stupid worthless pathetic i hate you and the of thing i like you i am you are dumb with is on he in er i have i hate them " * 50


class Counted:
    """Counted pairs, as the table that the model is made from."""

    def __init__(self, texts):
        self.n = Counter()
        for text in texts:
            self.n.update(x for pairs in tox.letter_pairs([text]) for x in pairs.tolist())

    def toArrow(self):
        return pa.table({"pair": list(self.n.keys()), "n": list(self.n.values())})


@pytest.fixture(scope="module")
def model():
    return tox.bigram_model(Counted([WORDS, "идиот дурак и ты идиот " * 50]))


def log_probability(text, model):
    total, at = 0.0, 0
    for c in [*text, " "]:
        code = tox.letter(c)
        same = not at or not code or (at < 0x250) == (code < 0x250)
        total, at = total + model.follow(at if same else 0, code), code
    return total


def test_decode_is_the_best_of_all_readings(model):
    for word in ["1d10t", "h.4.t.e", "i h a t e", "st-u-p1d", "f*ck", "1*1*1", "moooron", "иди0т", "a  b c", "$$$a$$", "w0rthle$$", "€1|+"]:
        for joined in (False, True):
            readings = [("".join(t for t, _ in path), sum(c for _, c in path)) for path in product(*tox.lattice(word, joined))]
            best = max(log_probability(text, model) + cost for text, cost in readings)
            got = tox.decode(word, model, joined)
            assert max(log_probability(text, model) + cost for text, cost in readings if text == got) == pytest.approx(best, abs=1e-9), word


def test_restored(model):
    wanted = {
        "1d10t": ["idiot"], "stup1d": ["stupid"], "$tupid": ["stupid"], "w0rthless!!": ["worthless"], "thing,": ["thing"], "12345": ["12345"], "!?": [],
        "h4t" + "e" * 60: ["hate"], "st.up.id": ["stupid"], "h.4.t.e": ["hate"], "i h a t e": ["i", "hate"], "1 d 1 0 t": ["idiot"], "y o u  a r e  d u m b": ["you", "are", "dumb"],
        "и д и о т": ["идиот"], "h_a_t_e": ["hate"],
    }
    for written, meant in wanted.items():
        got = tox.restored(written, model)
        assert got == meant if "." not in written and " " not in written else set(meant) <= set(got), (written, got)
    assert "i d i o t" in tox.words_of("you I d i o t , go") and "hate" in tox.restored(*[w for w in tox.words_of("I h a t e you") if " " in w], model)
    assert tox.words_of("1 2 3 4 5") == set("12345")


def test_very_long_words(model):
    assert tox.restored("h4te" * 20_000, model) == ["hate" * 20_000] == tox.restored("h4te" * 20_000 + "!!", model)
    assert "".join(tox.restored("4 b " * 20_000 + "c", model)).endswith("ab" * 20_000 + "c")


def brute_decode(word, model, joined):
    """The best reading, by trying every option of every run from each last letter."""
    runs = tox.lattice(word, joined)
    best = {0: (0.0, "")}
    for options in runs:
        found = defaultdict(list)
        for last, (score, text) in best.items():
            for letters, cost in options:
                total, at = score + cost, last
                for c in letters:
                    code = tox.letter(c)
                    before = at if not at or not code or (at < 0x250) == (code < 0x250) else 0
                    total, at = total + model[before, code], code
                found[at].append((total, text + letters))
        best = {at: max(x) for at, x in found.items()}
    return max((score + model[at, 0], text) for at, (score, text) in best.items())[1]


class BruteModel(dict):
    """Bigrams counted letter by letter."""

    def __init__(self, texts):
        counts, follow, letters = Counter(), Counter(), set()
        for text in texts:
            at = 0
            for c in " " + (text or "").lower() + " ":
                code = ord(c) if ord(c) < 0x2000 and c.isalpha() and c.lower() == c else 0
                counts[at if not code or (at < 0x250) == (code < 0x250) else 0, code] += 1
                at = code
            letters.add(0)
        for (a, _), n in counts.items():
            follow[a] += n
        size = 0.5 * (len({b for _, b in counts}) + 1)
        super().__init__({(a, b): math.log((n + 0.5) / (follow[a] + size)) for (a, b), n in counts.items()})
        self.follow, self.size = follow, size

    def __missing__(self, key):
        return math.log(0.5 / (self.follow[key[0]] + self.size))


def brute_scores(docs, labels):
    """{doc_id: score} by plain loops over [(doc_id, text)] and [(doc_id, toxic)]."""
    model = BruteModel([t for _, t in docs])
    held = {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    y = {d: t > 0 for d, t in labels if d not in held}
    seen = {}

    def meant(text):
        out = set()
        for w in tox.words_of(text or ""):
            if w not in seen:
                core = w.rstrip(tox._EDGE).lstrip(".,;:?\"'()[]{}«»#%&*<>")
                both = {x for joined in (False, True) for x in brute_decode(core, model, joined).split()} if tox._DISGUISED.search(core) else {core} - {""}
                seen[w] = (sorted(both), w)
            out.add((tuple(seen[w][0]), w))
        return out

    def feats(words):
        return {f for x in words for f in ["=" + x, *[x[:k] for k in (4, 5, 6) if len(x) >= k]]}

    texts = {d: meant(t) for d, t in docs}
    rows = {True: [], False: []}
    for d, t in y.items():
        if d in texts:
            rows[t].append({f for words, _ in texts[d] for f in feats(words)})
    n1, n0 = len(rows[True]), len(rows[False])
    a, b = (Counter(f for r in rows[k] for f in r) for k in (True, False))

    def part(k, n, p):
        return k * math.log(k / (n * p)) if k else 0.0

    weights = {}
    for f, x in a.items():
        z, p = b[f], (x + b[f]) / (n1 + n0)
        odds = math.log((x + 0.1) / (n1 + 0.2)) - math.log((z + 0.5) / (n0 + 1))
        ratio = 2 * (part(x, n1, p) + part(z, n0, p) + part(n1 - x, n1, 1 - p) + part(n0 - z, n0, 1 - p))
        if x >= 3 and odds > 1 and ratio > 12:
            weights[f] = odds
    evidence = {d: sum(max([weights.get(f, 0.0) for f in feats(words)], default=0.0) for words, _ in found) for d, found in texts.items()}
    slope = offset = 0.0
    for _ in range(60):  # Newton's method for the ridge-penalised likelihood
        g0 = g1 = h00 = h01 = h11 = 0.0
        for d, t in y.items():
            if d in evidence:
                x = evidence[d]
                p = 1 / (1 + math.exp(-(slope * x + offset)))
                g0, g1 = g0 + (t - p) * x, g1 + (t - p)
                w = p * (1 - p)
                h00, h01, h11 = h00 + w * x * x, h01 + w * x, h11 + w
        g0, g1, h00, h11 = g0 - 0.01 * slope, g1 - 0.01 * offset, h00 + 0.01, h11 + 0.01
        det = h00 * h11 - h01 * h01
        slope, offset = slope + (h11 * g0 - h01 * g1) / det, offset + (h00 * g1 - h01 * g0) / det
    slope = max(slope, 0.0)
    return {d: 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset)))) for d, x in evidence.items()}


def test_whole_fit_and_score(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()]
    want = brute_scores(docs, labels)
    got = q.op10_toxicity(spark, sf).collect()
    assert len(got) == len(docs) and sum(r.predicted for r in got) > 0
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_very_long_text(spark):
    text = "clean words " * 100_000 + "h4te " + "a1" * 200_000
    docs = spark.createDataFrame([(k, f"you {'stupid' if k % 3 else 'clean'} thing number w{k} {re.sub('x', 'y', 'xx')}") for k in range(60)] + [(100, text)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in tox.score_toxicity(docs, tox.fit_toxicity(docs, labels)).collect()}
    assert scores[100] < 0.3 < scores[1]
