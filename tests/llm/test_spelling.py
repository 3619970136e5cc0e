import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_helpers import documents

from tagloom.llm import queries, spelling


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def counted(docs):
    c = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def variants(vocabulary):
    """Rows of the report by comparing all pairs."""
    near_of = {w: [v for v in vocabulary if v != w and near(w, v)] for w in vocabulary}
    form = {}
    for w, vs in near_of.items():
        top = min(vs, key=lambda v: (-vocabulary[v], v), default=None)
        form[w] = top if top is not None and vocabulary[top] >= 2 * vocabulary[w] else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near_of[w]), vocabulary.get(form[w])))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_against_brute_force(spark, rng):
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(160)] + ["ÀÿABCde", "Straße", "über÷den", "aaaaa", "aaaaaa", "aaaaaaa"]
    weights = [1 / (1 + k % 40) for k in range(len(base))]
    texts = [(k if k % 9 else None, "".join(rng.choices(base, weights)[0] + rng.choice([" ", ", ", "1", "_", "Ā "]) for _ in range(rng.randint(0, 400)))) for k in range(60)]
    texts += [(900, None), (901, ""), (5, texts[5][1]), (5, texts[5][1])]
    df = documents(spark, texts)
    vocabulary = counted(texts)
    words = spelling.count_words(df, drop_every=97)
    assert {r["word"]: r["n"] for r in words.collect()} == vocabulary
    got = rows(spelling.spelling_variants(words))
    assert got == variants(vocabulary) and sum(r[1] is not None for r in got) > 15 and any(r[1] and r[1] != r[2] for r in got)
    assert got == rows(spelling.spelling_variants(words.repartition(3), most_blocks=1))  # full filters let all pass; the join removes it


def test_query_on_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    vocabulary = counted(docs)
    got = rows(queries.op11_spelling_variants(spark, sf))
    assert {r[0]: r[3] for r in got} == vocabulary
    keys = {}
    for w in vocabulary:  # words that share a deletion, or of which one is the other's deletion, as candidates
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            keys.setdefault(k, []).append(w)
    found = {w: {v for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for v in keys[k] if v != w and near(w, v)} for w in vocabulary}
    assert {r[0]: r[4] for r in got} == {w: len(v) for w, v in found.items()}
    for w, form, root, n, _, form_n in got:
        top = min(found[w], key=lambda v: (-vocabulary[v], v), default=None)
        want = top if top is not None and vocabulary[top] >= 2 * n else None
        assert form == want and form_n == (vocabulary[want] if want else None) and (root == w) == (want is None)


@pytest.mark.parametrize("word", ["abcde", "aabbb", "zzzzz", "ab" * 40, "é\U0001f600xyz"])
def test_edits_have_the_hashes_of_the_edited_words(word, monkeypatch):
    monkeypatch.setattr(spelling, "CELLS", 7)
    alphabet = np.array(sorted(map(ord, set(word + "mé"))), np.uint32)
    got = set()
    for length, row, place, letter, key in spelling.edits(spelling.letters([word]), alphabet):
        for _, p, c, h in zip(row, place, letter, key, strict=True):
            edited = word[:p] + (chr(c) if c else "") + word[p + 1 :]
            assert len(edited) == length and spelling.word_hashes(spelling.letters([edited]))[0] == h
            got.add(edited)
    want = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + chr(c) + word[i + 1 :] for i in range(len(word)) for c in alphabet if chr(c) > word[i]}
    assert got == want


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(20000)]
    f = spelling.Filters({8: len(words)}, 1 << 19)
    h = spelling.word_hashes(spelling.letters(words))
    f.bits = np.zeros((f.total, spelling.LANES), np.uint64)
    block, picks = f.place(8, h)
    for k in range(spelling.LANES):
        np.bitwise_or.at(f.bits[:, k], block, f.lane(picks, k))
    assert len(f.holds(8, h)) == len(h) and len(f.holds(9, h)) == 0
    other = spelling.word_hashes(spelling.letters(["".join(rng.choice("klmnop") for _ in range(8)) for _ in range(20000)]))
    assert len(f.holds(8, other)) < 200


def test_very_long_words(spark):
    long = "abcdefghij" * 2000
    words = spark.createDataFrame([(long, 9), (long[:777] + "x" + long[778:], 3), (long[:-1], 4), (long + "z", 2), ("other", 3)], "word string, n long")
    got = {len(r["word"]) + (r["word"][777:778] == "x") / 2: r for r in spelling.spelling_variants(words).collect()}
    assert got[20000]["n_near"] == 3 and got[20000]["form"] is None
    assert got[20000.5]["form"] == got[19999]["form"] == got[20001]["form"] == long and got[5]["n_near"] == 0


def test_empty_table(spark):
    assert spelling.spelling_variants(spelling.count_words(documents(spark, []))).count() == 0
