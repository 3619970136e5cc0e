import numpy as np
from llm_helpers import documents, words

from tagloom.llm import neardup


def brute(texts, least=0.8):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().split()
        if i is not None and w:
            sets[i] = {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))}
    ids = sorted(sets)
    parent = {i: i for i, _ in texts if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in parent}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(rng):
    base = [words(rng, 150, 5000) for _ in range(12)]
    texts = list(base)
    for b in base[:8]:
        texts += [b, edited(rng, b, 1), edited(rng, b, 2), edited(rng, b, 3), edited(rng, b, 4), edited(rng, b, 6)]
    hot = [edited(rng, base[8], rng.randint(0, 5)) for _ in range(150)]
    texts += hot + ["", None, "one", "one", "two words", "a b c d", "a b c d e", base[9] + " " + words(rng, 3000, 10**6)]
    return [(k * 3 + 1, t) for k, t in enumerate(texts)]


def test_classes_against_brute_force(spark, rng):
    texts = corpus(rng)
    df = documents(spark, [*texts, texts[0], (None, texts[0][1])])
    for block in (128, 16):
        got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, block=block).collect()}
        assert got.pop(None) is None
        assert got == brute(texts)


def test_one_of_each_class_stays(spark, rng):
    texts = corpus(rng)
    classes = brute(texts)
    kept = neardup.drop_near_duplicates(documents(spark, [*texts, texts[0], (None, "x")]))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(i for i, c in classes.items() if i == c)
    assert kept.filter("doc_id IS NULL").count() == 1


def test_texts_that_share_an_id(spark, rng):
    a, b, c = (words(rng, 80, 5000) for _ in range(3))
    df = documents(spark, [(1, a), (2, a), (5, b), (5, a), (6, b), (7, c), (7, c), (8, c + " end"), (9, " "), (9, " ")])
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 9}
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df).collect())
    assert kept == sorted([(1, a), (5, b), (7, c), (9, " "), (9, " ")])


def test_blocks_of_a_component(spark, rng, monkeypatch):
    monkeypatch.setattr(neardup, "LARGEST", 20)
    texts = corpus(rng)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, texts), block=8).collect()}
    assert got == brute(texts)


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_signatures_estimate_weighted_similarity():
    r = np.random.RandomState(0)
    e = r.randint(1, 2**62, 60).astype(np.uint64)
    a, b = r.rand(60) * 6, r.rand(60) * 6
    b[:30] = a[:30]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    sig = neardup.dart_signatures(np.r_[e, e], np.r_[a, b], np.repeat([0, 1], 60), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_signature_does_not_depend_on_the_batch():
    r = np.random.RandomState(1)
    parts = [r.randint(1, 2**62, n).astype(np.uint64) for n in (1, 3, 200, 5000)]
    doc = np.repeat(np.arange(4), [len(p) for p in parts])
    both = neardup.dart_signatures(np.concatenate(parts), np.ones(len(doc)), doc, 4, 130)
    for k, p in enumerate(parts):
        alone = neardup.dart_signatures(p, np.ones(len(p)), np.zeros(len(p), np.int64), 1, 130)
        assert (alone[0] == both[k]).all() and (both[k] != 0).all()


def test_weighted_mode_groups_copies(spark, rng):
    t = words(rng, 80)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents(spark, [(1, t), (2, t), (3, words(rng, 80))]), weighting="count").collect()}
    assert got == {1: 1, 2: 1, 3: 3}
