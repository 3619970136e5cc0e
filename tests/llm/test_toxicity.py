import zlib

import numpy as np
from llm_helpers import documents, words
from pyspark.sql import functions as F

from tagloom.llm import toxicity

BAD = ["vile", "rotten", "filth", "scorn"]


def corpus(rng, n=900):
    texts, labels = [], []
    for i in range(n):
        w = words(rng, rng.randint(40, 160), 300).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(max(3, len(w) // 30)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def frames(spark, texts, labels):
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_labels_unseen(spark, rng):
    texts, labels = corpus(rng)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(*frames(spark, texts, labels)).collect()}
    held = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == int(i % 6 == 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    flipped = [(i, q, 1 - t if i in set(held) else t) for i, q, t in labels]
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(*frames(spark, texts, flipped)).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in again)


def test_edges(spark, rng):
    texts, labels = corpus(rng, 300)
    texts += [(5000, None), (5001, ""), (None, "w1 w2"), (5, texts[5][1]), (5002, texts[0][1] * 200)]
    docs, lab = frames(spark, texts, [*labels, (7, 1, None), (None, 1, 1)])
    got = toxicity.score_toxicity(docs, lab).collect()
    assert len(got) == len(texts) and all(r["score"] is not None for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None]
    docs = docs.withColumn("__score", F.lit(1)).withColumn("__predicted", F.lit("x"))
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and 0 < kept.count() < len(texts)


def test_no_labels_and_no_documents(spark, rng):
    texts, labels = corpus(rng, 40)
    docs, lab = frames(spark, texts, labels)
    assert toxicity.score_toxicity(docs, lab.limit(0)).filter("score < 0.5").count() == 40
    assert toxicity.score_toxicity(docs, lab.filter("toxic = 1")).filter("score < 0.5").count() == 40
    assert toxicity.score_toxicity(docs.filter(F.lit(False)), lab).count() == 0


def test_distributions_sum_to_one(spark, rng):
    texts, labels = corpus(rng, 300)
    m = toxicity.train(*frames(spark, texts, labels), fewest=1)
    p = m.unigram(np.arange(toxicity.BUCKETS)).sum(1)
    assert abs(p - 1).max() < 1e-3 and len(m.history)
    for c in (0, 1):
        mine = m.pairs >> toxicity.BITS == m.history[0]
        assert abs(m.pair_p[c][mine].sum() + m.back[c][0] * p[c] - 1) < 1e-3


def test_probabilities_against_plain_loops(spark, rng):
    """Counts, continuation counts, discounts and both interpolations, from dictionaries."""
    texts = {c: [[rng.randrange(6 + 3 * c) for _ in range(rng.randint(2, 14))] for _ in range(12)] for c in (0, 1)}
    pairs, holders = {}, {}
    for c, docs in texts.items():
        for w in docs:
            for a, b in zip(w, w[1:]):  # noqa: B905
                pairs[c, a, b] = pairs.get((c, a, b), 0) + 1
            for x in set(w):
                holders[c, x] = holders.get((c, x), 0) + 1
    p = spark.createDataFrame([(*k, n) for k, n in pairs.items()], "cls int, h long, w long, n long")
    d = spark.createDataFrame([(*k, n) for k, n in holders.items()], "cls int, w long, n long")
    df = np.zeros(toxicity.BUCKETS, np.float32)
    df[:9] = np.arange(9) + 1
    fewest = 3
    m = toxicity.fit_model(toxicity.class_counts(p, d, fewest), df)

    def discount(counts):
        n1, n2 = counts.count(1), counts.count(2)
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    cont = {}
    for c in (0, 1):
        for w in {w for k, _, w in pairs if k == c}:
            cont[c, w] = min(sum((k, x) == (c, w) for k, _, x in pairs), holders[c, w])
    known = {w for _, w in cont if cont.get((0, w), 0) + cont.get((1, w), 0) >= fewest}
    good = {(h, w) for _, h, w in pairs if {h, w} <= known and pairs.get((0, h, w), 0) + pairs.get((1, h, w), 0) >= fewest}

    def prob(c, h, w):
        own = {x: n for (k, x), n in cont.items() if k == c}
        part = {x: max(own.get(x, 0) - discount(list(own.values())), 0) / sum(own.values()) for x in known}
        uni = part.get(w, 0) + (1 - sum(part.values())) * (df[w] + 1) / (df.sum() + toxicity.BUCKETS)
        if h is None:
            return uni
        times = {(a, b): n for (k, a, b), n in pairs.items() if k == c}
        seen = sum(n for (a, _), n in times.items() if a == h)
        two = {(a, b): max(times.get((a, b), 0) - discount(list(times.values())), 0) / max(seen, 1) for a, b in good if a == h}
        return two.get((h, w), 0) + (max(1 - sum(two.values()), 1e-6)) * uni

    for _ in range(40):
        w = [rng.randrange(10) for _ in range(6)]
        want = [np.log(prob(1, h, x)) - np.log(prob(0, h, x)) for h, x in zip([None, *w], w)]  # noqa: B905
        assert np.allclose(m.difference(np.array(w)), want, atol=1e-5), w
