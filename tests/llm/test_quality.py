import re
from collections import Counter

from llm_helpers import documents, words

from tagloom.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line) and line in seen:
            dup += 1
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_against_brute_force(rng):
    texts = ["", "\n\n", "a", "a a a a a", "a a a a a a", "a b\na b\n\n \n \na b", "é\x1cx\u00a0y #|<>", "x y z u v " * 300]
    texts += [words(rng, rng.randint(1, 120), rng.choice([2, 3, 8, 50])) + "\n" * rng.randint(0, 2) for _ in range(300)]
    texts.append(" ".join(f"u{i}" for i in range(6000)) + " " + " ".join(f"u{i}" for i in range(100, 140)))
    for t in texts:
        assert quality.text_counts(t) == brute(t), t[:60]


def test_outliers_go_and_clean_documents_stay(spark, rng):
    clean = [(i, words(rng, rng.randint(60, 300), 10**4)) for i in range(300)]
    bad = [(1000 + i, " ".join(rng.choice(["###", "|", "$$$$%", "w" * 60]) + str(rng.randrange(10**6)) for _ in range(100))) for i in range(20)]
    more = [(2000, "few words"), (2001, None), (2002, "a b c d e " * 40), (None, words(rng, 90, 10**4)), (5, clean[5][1])]
    got = quality.quality_verdicts(documents(spark, clean + bad + more)).collect()
    assert len(got) == 325
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert sum(kept[i] for i, _ in clean) >= 297 and not any(kept[i] for i, _ in bad)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["base_failed"] for i in (2000, 2001, 2002)] == [True] * 3 and not any(kept[i] for i in (2000, 2001, 2002))


def test_masked_outliers_need_a_robust_start(spark, rng):
    """A fifth of a group is alike and far away: mean and covariance of all would hide it."""
    clean = [(i, words(rng, rng.randint(80, 200), 10**4)) for i in range(240)]
    bad = [(1000 + i, " ".join(f"## | $$ {rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    df = documents(spark, clean + bad)
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(df).collect()}
    assert sum(kept[i] for i, _ in clean) >= 236 and not any(kept[i] for i, _ in bad)
    again = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(df.repartition(7)).collect()}
    assert again == kept


def test_small_groups_lean_on_all(spark, rng):
    texts = [(i, words(rng, rng.randint(60, 300), 10**4)) for i in range(200)] + [(900, "### $$ | " * 3 + words(rng, 60, 10**4)), (901, words(rng, 100, 10**4))]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(documents(spark, texts, ["big"] * 200 + ["lone", "single"])).collect()}
    assert got[901] and sum(got[i] for i in range(200)) >= 197


def test_small_and_equal_groups(spark, rng):
    df = documents(spark, [(i, "the same ten words over and over but never more " + str(i % 2)) for i in range(60)], ["a"] * 55 + [None] * 5)
    assert quality.quality_verdicts(df).filter("kept").count() == 60
    assert quality.quality_verdicts(documents(spark, [])).count() == 0
