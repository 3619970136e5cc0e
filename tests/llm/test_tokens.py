import time

import numpy as np
import pytest
from llm_helpers import documents

from tagloom.llm import segment, tokencount
from tagloom.llm.pieces import vocabulary

ODD = ["", "Hello  world\n\n x", "  a", "a  ", "é́", "ﬁ Ⅳ　x", "a\tb\r\nc", "▁x ▁▁y", "😀é<s></s><0x41>", "    ", "\n \n  \n", " " * 40, "naïve café " * 2000, "the" * 300]


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def made(rng, n):
    return ["".join(rng.choices("ab ▁\n\té😀x<s>0A  \rthe", k=rng.randint(1, 40))) for _ in range(n)]


def test_encoding_is_the_librarys(model, library, rng):
    m = segment.machine(model)
    for t in ODD + made(rng, 1500):
        ids = np.frombuffer(segment.encode(t, m), np.int32).tolist()
        assert ids == library.encode(t), t
        assert segment.decode(ids, m.v) == library.decode(ids), t


def test_counts_are_the_librarys(model, library, rng):
    t = tokencount.trie(model)
    for x in ODD + made(rng, 1500):
        assert sum(t.terminal[w] if w in t.terminal else t.insert(w) for w in t.v.pretokens(x)) == len(library.encode(x)), x


def test_pairs_against_merging(model, rng):
    v = vocabulary(model)
    names = [p for p in v.ids if not v.has_tied(p)]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        if not v.has_tied(a + b):
            assert v.follows(a, b) == (v.merge(a + b) == [a, b]), (a, b)


class Unigram:
    """A small unigram vocabulary with the attributes that the machines read."""

    bpe, fallback, tied = False, False, []
    ids = {p: i for i, p in enumerate(["a", "b", "ab", "abc", "c", "bc", "ca"], 1)}
    cost = dict(zip(ids, [2.0, 2.1, 3.0, 6.5, 1.9, 2.5, 5.0], strict=True))
    _pairs: dict = {}

    def unknown_ids(self, c):
        return [0]


def cheapest(v, w):
    best = [0.0] + [float("inf")] * len(w)
    n = [0] * (len(w) + 1)
    for j in range(1, len(w) + 1):
        for i in range(j):
            p = w[i:j]
            c = v.cost.get(p, 16.5 if len(p) == 1 else float("inf"))
            if best[i] + c < best[j] - 1e-12:
                best[j], n[j] = best[i] + c, n[i] + 1
    return best[-1], n[-1]


def test_shortest_paths_of_a_unigram_model(rng):
    v = Unigram()
    m, t = segment.Machine(v), tokencount.Trie(v)
    named = {i: p for p, i in v.ids.items()}
    for _ in range(500):
        w = "".join(rng.choices("abcx", k=rng.randint(1, 12)))
        cost, n = cheapest(v, w)
        ids = m.shortest_path(w)
        assert sum(v.cost[named[i]] if i else 16.5 for i in ids) == pytest.approx(cost)
        assert len(ids) == n == t.insert(w)


def test_full_tries_and_caches_start_anew(model, library, monkeypatch):
    monkeypatch.setattr(tokencount, "NODES", 50)
    t = tokencount.Trie(vocabulary(model))
    for x in ["many different words make a small trie full again and again"] * 3:
        assert sum(t.insert(w) for w in t.v.pretokens(x)) == len(library.encode(x))


def test_very_long_words_take_bounded_memory_and_linear_time(model, library, rng):
    m, t = segment.machine(model), tokencount.Trie(vocabulary(model))
    word = "".join(rng.choices("etaoinshrdluébc", k=5_000_000))
    want = library.encode(word[:20_000])
    assert np.frombuffer(segment.encode(word[:20_000], m), np.int32).tolist() == want
    nodes = len(t.count)
    assert sum(t.insert(w) for w in t.v.pretokens(word[:20_000])) == len(want) and len(t.count) == nodes
    # pieces of a long word are those of its parts but at the seam
    began = time.time()
    n = len(segment.encode(word, m)) // 4
    assert sum(t.insert(w) for w in t.v.pretokens(word)) == n and len(t.count) == nodes and not any(len(w) > segment.KEPT for w in m)
    assert time.time() - began < 240


def test_long_words_are_counted_as_short_ones(model, monkeypatch, rng):
    t = tokencount.Trie(vocabulary(model))
    texts = ["".join(rng.choices("ab the éin", k=rng.randint(1, 200))) for _ in range(300)]
    want = [[t.insert(w) for w in t.v.pretokens(x)] for x in texts]
    monkeypatch.setattr(tokencount, "LONG", 3)
    assert [[t.insert(w) for w in t.v.pretokens(x)] for x in texts] == want
    u = tokencount.Trie(Unigram())
    monkeypatch.setattr(tokencount, "LONG", 1)
    for _ in range(200):
        w = "".join(rng.choices("abcx", k=rng.randint(1, 30)))
        assert u.insert(w) == cheapest(u.v, w)[1]


def test_frames(spark, model, library):
    texts = [*enumerate(ODD), (0, None), (None, "x y"), (1, ODD[1])]
    df = documents(spark, texts)
    coded = segment.encode_column(df, model)
    rows = coded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r["doc_id"] not in (None, 0):
            t = ODD[r["doc_id"]]
            assert r["ids"] == library.encode(t) and r["n_pieces"] == len(r["ids"]) and r["round_trip"] == ("▁" not in t)
    back = {r["doc_id"]: r["text"] for r in segment.decode_column(coded.filter("doc_id > 0"), model).collect()}
    assert all(back[i] == t for i, t in enumerate(ODD) if i and "▁" not in t)
    counts = tokencount.count_tokens(df, model).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"]) for r in counts if r["doc_id"]) == sorted((False, i, len(library.encode(t))) for i, t in [*enumerate(ODD), (1, ODD[1])] if i)
    assert segment.encode_column(documents(spark, []), model).count() == 0 and tokencount.count_tokens(documents(spark, []), model).count() == 0
