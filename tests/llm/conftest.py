import random

import pytest


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(7)
    voc = [f"w{i}" for i in range(500)]
    long = " ".join(rng.choice(voc) for _ in range(60_000))
    solid = "é" * 30_000
    texts = [None, "", " \n\t ", "a", "A  b", "same words in this text here", "same words in this text here", long, long + " tail", solid, "x\x00y <|im_end|> \\ <|", "日本 語 emoji 🎉 done"]
    rows = [(i, t, None if i % 4 == 0 else f"src{i % 3}", "en", None, i, "k", 1.5) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", None, None, None, None, None, None), (50, None, None, None, None, None, None, None)]
    # clashing names: n, key, score
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, n long, key string, score double").cache()


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.limit(0)
