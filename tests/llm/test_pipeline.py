"""The pipeline's stages, each on its predecessor's rows, against what the operators say of the same rows."""

from llm_helpers import words
from pyspark.sql import functions as F

from tagloom.llm import mixing, neardup, secrets

corpus_pipeline = __import__("corpus_pipeline")


def tables(spark, rng, tmp_path):
    texts, labels = [], []
    for i in range(240):
        w = words(rng, 60, 5000).split()
        if i % 6 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "filth"]))
        labels.append((i, 1, int(i % 6 == 0)))
        texts.append((i, " ".join(w)))
    texts += [(300 + k, texts[1 + 6 * k][1]) for k in range(10)] + [(400, texts[2][1] + " password=hunter2hunter2"), (401, None), (402, "")]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, rng, tmp_path, model):
    sf = tables(spark, rng, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, sf)
        path = f"{tmp_path}/stage-{k}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    before, after = seen["toxicity"]
    gone = ids(before) - ids(after)
    assert len(gone & {i for i in range(0, 240, 6)}) >= 38 and len(gone) <= 42
    before, after = seen["near-duplicates"]
    classes = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(before).collect()}
    assert ids(after) == {i for i, c in classes.items() if i == c} and len(ids(before) - ids(after)) >= 10
    before, after = seen["secrets"]
    assert ids(before) == ids(after) and secrets.find_secrets(after).filter(F.size("spans") > 0).count() == 0
    before, after = seen["mixing"]
    assert after.agg(F.sum(mixing.word_count("text"))).first()[0] == mixing.mix_report(before).agg(F.sum("taken")).first()[0]
    before, after = seen["pieces"]
    assert before.count() == after.count() and after.filter("NOT round_trip").count() == 0


def test_run(spark, rng, tmp_path, model):
    out = corpus_pipeline.run(spark, tables(spark, rng, tmp_path))
    assert out.columns[:2] == ["doc_id", "ids"] and out.count() > 0
