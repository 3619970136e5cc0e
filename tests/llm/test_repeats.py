import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import documents, words

from tagloom.llm import repeats, suffixes


def brute(texts, width=200):
    docs = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(x[k : k + width] for _, x in docs for k in range(len(x) - width + 1))
    out = []
    for i, x in docs:
        cut = bytearray(len(x))
        for k in range(len(x) - width + 1):
            if seen[x[k : k + width]] > 1:
                cut[k : k + width] = b"\1" * width
        kept = bytes(b for b, c in zip(x, cut, strict=True) if not c)
        runs = sum(1 for k, c in enumerate(cut) if c and (k == 0 or not cut[k - 1]))
        out.append((i, len(x), sum(cut), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    shared, other = words(rng, 60, 10**5), words(rng, 45, 10**5)
    t = [words(rng, 90, 10**5) for _ in range(12)]
    texts = [t[0] + shared + t[1], t[2] + shared, shared + t[3], t[4], t[4], t[5] + "é" * 150 + t[6], t[7] + "é" * 150 + t[8], "a" * 450, "ab" * 150 + t[9], t[10] + other + t[11] + other, "", None, "short", shared[:199], other[5:206]]
    texts += [t[k] + shared[: 150 + 10 * k] for k in range(8)]
    return list(enumerate(texts))


def test_against_brute_force(spark, rng):
    texts = corpus(rng)
    texts += [texts[2], (None, texts[0][1])]
    got = sorted((tuple(r) for r in repeats.remove_repeats(documents(spark, texts)).collect()), key=str)
    assert got == brute(texts)


@pytest.mark.parametrize("share", [1, 3, 40])
def test_frequent_grams_are_exact_too(spark, rng, monkeypatch, share):
    monkeypatch.setattr(repeats, "SHARE", share)
    texts = corpus(rng)
    got = sorted((tuple(r) for r in repeats.remove_repeats(documents(spark, texts)).collect()), key=str)
    assert got == brute(texts)
    assert repeats.frequent_grams(spark.createDataFrame([(i % 7,) for i in range(70)] + [(9,)] * 60, "fp long"), share).count() <= 2 * share


def test_wide_groups_are_exact_too(spark, rng, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 300)
    texts = corpus(rng)
    got = sorted((tuple(r) for r in repeats.remove_repeats(documents(spark, texts)).collect()), key=str)
    assert got == brute(texts)


@pytest.mark.parametrize("piece", [64, 1000, 5000])
def test_documents_in_parts_are_exact_too(spark, rng, monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    texts = corpus(rng) + [(99, words(rng, 900, 10**5) + "é" * 2000), (98, "x" * 64 * 30)]
    texts.append((97, texts[-2][1][333:4000]))
    got = sorted((tuple(r) for r in repeats.remove_repeats(documents(spark, texts)).collect()), key=str)
    assert got == brute(texts)


def test_arrays_of_a_long_text_are_bounded(rng):
    long = words(rng, 40_000, 10**6) * 20
    size = [(len(data), int(offset[0])) for _, offset, data, _ in repeats._pieces([long, "short", long[:500]])]
    assert len(long) > 5_000_000 and max(n for n, _ in size) <= repeats.PIECE + 2 * repeats.WIDTH and [k for _, k in size[:2]] == [0, repeats.PIECE]


def test_long_text_that_repeats_itself(spark):
    """Five million letters: a passage without repeats, and another one twice."""
    r = np.random.RandomState(3)
    once, twice = ("".join(map(chr, r.randint(97, 123, n))) for n in (4_000_000, 500_000))
    (got,) = repeats.remove_repeats(documents(spark, [(1, twice + once + twice)])).collect()
    assert tuple(got)[1:] == (5_000_000, 1_000_000, 2, hashlib.sha256(once.encode()).hexdigest())


def test_empty_table(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("k", "n"), [(1, 80), (2, 60), (2, 4000), (3, 500), (40, 4000), (250, 3000)])
def test_suffix_array(k, n):
    r = np.random.RandomState(k * n)
    t = np.r_[r.randint(1, k + 1, n), 0].astype(np.uint16)
    b = t.astype(">u2").tobytes()
    sa = suffixes.suffix_array(t, k + 1, 10**9)
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: b[2 * i :])
    lcp = suffixes.common_prefixes(t, sa, 24)
    for i in range(1, len(sa)):
        a, c, m = sa[i - 1], sa[i], 0
        while m < 24 and max(a, c) + m < len(t) and t[a + m] == t[c + m]:
            m += 1
        assert lcp[c] == m


def test_contexts_cover_each_window_once(rng):
    x = [words(rng, 200, 10**5).encode(), b"a" * 300, b"x" * 199, words(rng, 40, 10**5).encode()]
    data, ends = np.frombuffer(b"".join(x), np.uint8), np.cumsum([len(v) for v in x])
    _, _, start, n = repeats.contexts(data, ends)
    got = sorted(int(s) + k for s, m in zip(start, n, strict=True) for k in range(int(m)))
    begins = [0, *ends[:-1].tolist()]
    assert got == [i for b, e in zip(begins, ends.tolist(), strict=True) for i in range(b, e - 199)]
