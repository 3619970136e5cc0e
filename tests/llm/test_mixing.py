import math
import re

from llm_helpers import documents, words

from tagloom.llm import mixing


def fill(sizes, share=1.5, epochs=2.0):
    """Targets by repeated clamping."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(epochs * sizes[s] for s in capped)
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return {s: t.get(s, epochs * sizes[s]) for s in order}
        capped |= over


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def corpus(rng):
    texts, sources = [], []
    for k, s in enumerate(["b", "a", "é", None, "a", "Z"] * 60):
        texts.append((k, words(rng, rng.randint(0, 60))))
        sources.append(s if s != "a" or k % 4 else "hot")
    texts += [(9000, None), (9001, ""), (None, "x\x1cy z\u00a0w"), (5, texts[5][1]), (5, texts[5][1]), (9002, "p q")]
    sources += ["b", "empty", "b", sources[5], sources[5], "tiny"]
    return texts, sources


def test_targets_and_sampling(spark, rng):
    texts, sources = corpus(rng)
    got = mixing.mix_report(documents(spark, texts, sources)).collect()
    assert len(got) == len(texts)
    sizes = {}
    for (_, t), s in zip(texts, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + size(t)
    want = fill(sizes)
    plan = {r["source"]: r for r in mixing.mix_plan(mixing.sized(documents(spark, texts, sources))).collect()}
    assert {s: r["source_size"] for s, r in plan.items()} == sizes
    for s, t in want.items():
        assert math.isclose(plan[s]["target"], t, rel_tol=1e-9, abs_tol=1e-9)
    assert sorted((r["size"]) for r in got) == sorted(size(t) for _, t in texts)
    assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["target"], [0, 0])
        by[r["target"]][0] += r["taken"]
        by[r["target"]][1] = max(by[r["target"]][1], r["size"])
    for target, (taken, longest) in by.items():
        n = sum(math.isclose(t, target) for t in want.values())
        assert abs(taken - n * target) <= n * 3 * longest + 1e-6


def test_rows_of_one_place_are_split(spark, rng):
    texts = [(None, " ".join(f"w{rng.randrange(9)}" for _ in range(3))) for _ in range(400)] + [(1, words(rng, 450))]
    df = documents(spark, texts, ["a"] * 400 + ["b"])
    rows = mixing.mix_report(df).collect()
    target = next(r["target"] for r in rows if r["doc_id"] is None)
    assert target == 1856.25
    assert abs(sum(r["taken"] for r in rows if r["doc_id"] is None) - target) <= 3
    rows_of = lambda d: sorted(map(str, mixing.mix_documents(d).collect()))
    assert rows_of(df) == rows_of(df.repartition(5))
    assert sum(size(r["text"]) for r in mixing.mix_documents(df).collect()) == sum(r["taken"] for r in rows)


def test_reruns_and_partitions_agree(spark, rng):
    texts, sources = corpus(rng)
    df = documents(spark, texts, sources)
    rows = lambda d: sorted(map(str, mixing.mix_report(d).collect()))
    assert rows(df) == rows(df.repartition(7))


def test_documents_are_repeated_as_reported(spark, rng):
    texts, sources = corpus(rng)
    df = documents(spark, texts, sources)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    taken = sum(r["taken"] for r in mixing.mix_report(df).collect())
    assert sum(size(r["text"]) for r in out.collect()) == taken


def test_empty_table_and_no_python(spark):
    df = documents(spark, [])
    assert mixing.mix_report(df).count() == 0 and mixing.mix_documents(df).count() == 0
    assert "Python" not in mixing.mix_documents(df)._jdf.queryExecution().executedPlan().toString()
