import numpy as np

from tagloom.llm import ann
from tagloom.llm.hilbert import hilbert_keys

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, v string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x") for i, v in pairs], SCHEMA)


def brute(pairs, i, k=10):
    own = {a: np.array(v, np.float32).astype(float) for a, v in pairs}
    d = sorted((float(np.sqrt(((own[i] - v) ** 2).sum())), a) for a, v in own.items() if a != i)
    return d[:k]


def test_curve_is_continuous_and_complete():
    g = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = hilbert_keys(g, 3)
    order = np.lexsort(keys.T[::-1])
    assert len({k.tobytes() for k in keys}) == 512
    assert (np.abs(np.diff(g[order], axis=0)).sum(1) == 1).all()


def test_recall_and_distances(spark):
    r = np.random.RandomState(3)
    pairs = [(i, v.tolist()) for i, v in enumerate(r.randn(1500, 16))]
    got = ann.nearest_neighbours(frame(spark, pairs)).collect()
    hit = 0
    for q in range(0, 1500, 100):
        mine = sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == q)
        assert [a for a, _, _ in mine] == list(range(1, 11))
        want = brute(pairs, q)
        hit += len({v for _, v, _ in mine} & {a for _, a in want})
        at = dict((a, d) for d, a in brute(pairs, q, 1500))
        assert all(abs(at[v] - s) < 1e-12 for _, v, s in mine)
    assert hit >= 0.9 * 150


def test_a_common_offset_changes_nothing(spark):
    r = np.random.RandomState(5)
    base = np.round(r.randn(800, 24) * 256) / 256
    found = []
    for offset in (0.0, float(1 << 27)):  # doubles hold the sums exactly
        df = spark.createDataFrame([(i, (v + offset).tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
        found.append({(x["query_id"], x["vec_id"]) for x in ann.nearest_neighbours(df, every=20).collect()})
    want = {(q, int(v)) for q in range(0, 800, 20) for v in np.lexsort((np.arange(800), ((base - base[q]) ** 2).sum(1)))[1:11]}
    assert all(len(f & want) >= 0.9 * len(want) for f in found)


def test_ties_beyond_k_go_to_smaller_ids(spark):
    """600 vectors at one distance of the query: as many as one block holds."""
    pairs = [(0, [1.0] * 300)] + [(k, [1.0 + (0 if j != k % 300 else 1 if k <= 300 else -1) for j in range(300)]) for k in range(1, 601)]
    got = ann.nearest_neighbours(frame(spark, pairs), every=1000).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(k, k, 1.0) for k in range(1, 11)]


def test_clustered_vectors_get_narrow_windows(spark, monkeypatch):
    """Of vectors around 40 centres a query looks at few: the window, on both sides and in all orders, is a fraction of the table."""
    r = np.random.RandomState(6)
    centres = r.randn(40, 32) * 4
    v = centres[r.randint(0, 40, 3000)] + r.randn(3000, 32) * 0.3
    seen, real = [], ann._fit_window
    monkeypatch.setattr(ann, "_fit_window", lambda *a: seen.append(real(*a)) or seen[-1])
    got = ann.nearest_neighbours(frame(spark, list(enumerate(v.tolist()))), every=30).collect()
    v = v.astype(np.float32).astype(float)
    want = {(q, int(x)) for q in range(0, 3000, 30) for x in np.argsort(((v - v[q]) ** 2).sum(1), kind="stable")[1:11]}
    assert len({(x["query_id"], x["vec_id"]) for x in got} & want) >= 0.9 * len(want)
    assert 2 * seen[0] < 3000 / 40 * 2


def test_small_blocks_and_parts_find_the_same(spark):
    r = np.random.RandomState(4)
    df = frame(spark, list(enumerate(r.randn(600, 8).tolist())))
    rows = lambda **k: sorted(map(tuple, ann.nearest_neighbours(df, every=10, **k).collect()))
    assert rows() == rows(block=50, asked_at_once=7)


def test_equal_vectors_ties_and_unusable_ones(spark):
    same = [(i, [1.0, 0.0, 0.0]) for i in range(0, 60)]
    other = [(100, [0.0, 1.0, 0.0]), (201, [0.0, 0.9, 0.0])]
    bad = [(300, None), (400, [0.0, 0.0, 0.0]), (500, [float("nan"), 1.0, 1.0]), (600, [None, 1.0, 1.0]), (700, []), (None, [1.0, 1.0, 1.0]), (800, [float("inf"), 0.0, 0.0])]
    got = ann.nearest_neighbours(frame(spark, same + other + bad + [same[3]])).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    assert sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0) == [(k, k) for k in range(1, 11)]
    mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 100)
    assert mine == [(1, 201), *((k + 2, k) for k in range(9))]


def test_few_and_none(spark):
    got = ann.nearest_neighbours(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]
    assert ann.nearest_neighbours(frame(spark, [])).count() == 0
    assert ann.nearest_neighbours(frame(spark, [(0, [1.0])])).count() == 0
