import os
import random

import pytest

SF = "/root/testdata/sf0.01"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="session")
def model():
    if not os.path.exists(MODEL):
        pytest.skip("no vocabulary")
    return MODEL


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    return SF


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, size long, rid long, target string"


def documents(spark, texts, sources=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], len(t or ""), 0.5, "x", 1, 2, "y") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)
