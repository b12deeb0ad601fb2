"""Signatures put together from parts, and likeness by one sort, against their plain definitions."""

import random

import numpy as np
import pytest

from trackloom.llm import fingerprints


@pytest.mark.parametrize("size", [1, 5, 128])
def test_signature_of_parts(size):
    rng = random.Random(size)
    for n in (0, 1, 7, 300, 2000):
        text = "".join(rng.choice("abcd é") for _ in range(n))
        cut = n - n // 4
        parse = fingerprints.Parse()
        parse.feed(text[:cut])
        mark, stable = parse.mark(), parse.signature(size)
        parse.feed(text[cut:])
        assert np.array_equal(parse.signature(size, mark[0], stable), fingerprints.signature(text, size))
        parse.back(mark)
        assert np.array_equal(parse.signature(size), stable)
        parse.feed("zz" + text)
        whole = fingerprints.signature(text[:cut] + "zz" + text, size)
        assert np.array_equal(parse.signature(size, mark[0], stable), whole)


def test_likeness():
    rng = random.Random(9)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(60), rng.randrange(1, 30))), dtype=np.uint32) for _ in "ab")
        least = sorted({*a.tolist(), *b.tolist()})[:20]
        assert fingerprints.likeness(a, b, 20) == sum(v in a and v in b for v in least) / len(least)
