import itertools
import math
import random
import re

import duckdb
import pytest
from llm_helpers import documents, words

from tagloom.llm import audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    """The rows of the audit by going through every order, document by document. docs: (doc_id, lang, text)."""
    by = {}
    for i, lang, t in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs)
        good, toxic = (any(i is not None and l[0] == i and l[k] == 1 for l in labels) for k in (1, 2))
        by.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, good, toxic))
    out = []
    for part, rows in by.items():
        shapley = dict.fromkeys("ABCDE", 0)
        mine = []
        for order in itertools.permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                cut = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                all_f = sum(f in r[0] for r in rows)
                shapley[f] += len(cut)
                mine.append([part, "".join(order), step, len(left), len(cut), all_f - len(cut), sum(r[0] == {f} for r in rows), sum(r[1] for r in cut), sum(r[2] for r in cut)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in mine]
    return sorted(out)


def test_against_brute_force(spark, rng):
    long = words(rng, 230, 900)
    texts = [long, long + " #", words(rng, 260, 40), "A B C d", None, "", "", "x" * 50, long.upper(), "a\x1cb c " * 120, words(rng, 300, 100) + "|"]
    rows = [(k, "en" if k % 3 else None, texts[k % len(texts)]) for k in range(40)] + [(3, "de", long), (3, "de", long), (None, "de", long), (None, "", None), (7, "fr", "Q & A")]
    labels = [(k, (k // 2) % 2, k % 2) for k in range(0, 40, 3)] + [(3, None, 1), (3, 1, None), (None, 1, 1)]
    df = spark.createDataFrame([(i, t, g, "s", 0, "m") for i, g, t in rows], "doc_id long, text string, lang string, source string, same long, mask string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.filter_audit(audit.document_masks(df, lab)).collect())
    assert got == brute(rows, labels)
    assert got == sorted(tuple(r) for r in audit.filter_audit(audit.document_masks(df.repartition(7), lab)).collect())


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = queries.op13_filter_audit(spark, sf).select(*cols).collect()
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()['op13_filter_audit']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) % 600 == 0


@pytest.mark.parametrize("k", [1, 2, 3, 6])
def test_diagrams_of_any_number_of_filters(k):
    rng = random.Random(k)
    counts = {m: (rng.randrange(1, 9), rng.randrange(3), 0) for m in range(1 << k) if rng.random() < 0.6} or {0: (1, 0, 0)}
    names = "PQRSTU"[:k]
    rows = {(r[0], r[1]): r for r in audit.audit_rows(counts, names)}
    assert len(rows) == math.factorial(k) * k
    for order in itertools.permutations(range(k)):
        left = dict(counts)
        for step, bit in enumerate(order, 1):
            cut = {m: c for m, c in left.items() if m >> bit & 1}
            left = {m: c for m, c in left.items() if not m >> bit & 1}
            got = rows["".join(names[b] for b in order), step]
            assert got[2:4] == (sum(c[0] for c in left.values()), sum(c[0] for c in cut.values())) and got[6] == sum(c[1] for c in cut.values())


def test_equal_parts_of_a_diagram_are_shared():
    d = audit.Diagram(5, {m: (1, 0, 0) for m in range(32)})
    for at in audit.neighbour_swaps(5):
        d.swap(at)
        assert [len(t) for t in d.tables] == [1] * 6 and d.sums[d.root] == (32, 0, 0)


def test_words_of_long_texts(monkeypatch, rng):
    text = " ".join("ab" * rng.randint(1, 9) for _ in range(400)) + "  \t x"
    whole = audit.word_numbers(text.encode())
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(audit, "PIECE", size)
        assert audit.word_numbers(text.encode()) == whole == (401, len(set(text.split())))
    monkeypatch.undo()
    assert audit.word_numbers(b"z" * 5_000_000 + b" z") == (2, 2)


def test_empty_table(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(audit.document_masks(documents(spark, []), lab)).count() == 0
