"""Whole documents as BM25 queries: against plain Python, with odd rows, in blocks; what moves is few rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratalex.functions import exprs as X
from stratalex.operators import bags
from stratalex.plans import catalog


def brute(rows, asked, k):
    """(query, id, score, rank): rows of one id are one document; those without an id count, and are never found."""
    held, n = {}, len(rows)
    for i, words in rows:
        held.setdefault(i, Counter()).update(words)
    mean = sum(len(w) for _, w in rows) / n
    df = Counter(t for c in held.values() for t in c)
    out = set()
    for q in asked:
        found = []
        for i, c in held.items():
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * x * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * c.total() / mean)) for t, x in held[q].items() if t in c)
            if i is not None and round(s, 6) > 0:
                found.append((-round(s, 6), i))
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def near(got, want):
    assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want}
    scores = {x[:2]: x[2] for x in want}
    assert all(x[2] == pytest.approx(scores[x[:2]], abs=2e-6) for x in got)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_like_plain_python(spark, monkeypatch, small, kind):
    if small:
        for name, value in {"ENTRIES": 40, "QUERIES": 3, "DENSE": 4, "PAIRS": 8, "PRODUCTS": 16, "TOKENS": 50}.items():
            monkeypatch.setattr(bags, name, value)
    rng, rows = random.Random(5), []
    for i in range(160):
        rows.append((i, [f"w{int(rng.paretovariate(0.5)) % 300}" for _ in range(rng.choice([0, 1, 5, 40]))]))
    rows += [(i, rows[10][1]) for i in range(200, 230)] + [(300 + i, ["only", f"v{i}"]) for i in range(8)]  # copies; more ties than places
    rows += [(20, ["again", "w1"]), (20, []), (None, ["w1", "only"]), (None, ["w1"]), (400, []), (400, [])]
    if kind == "string":
        rows = [(None if i is None else f"d{i}", w) for i, w in rows]
    asked = sorted({i for i, _ in rows if i is not None and int(str(i).removeprefix("d")) % 10 == 0})
    docs = spark.createDataFrame(rows, f"doc_id {kind}, w array<string>").repartition(5)
    held = bags.bags(docs, F.col("w"))
    got = bags.top_batch(held, held.filter(F.col("id").isin(asked)), 5).collect()
    near({tuple(r) for r in got}, brute(rows, asked, 5))
    assert len(got) == len({(r.query_id, r.id) for r in got})


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "doc_id long, w array<string>")
    held = bags.bags(none, F.col("w"))
    assert bags.top_batch(held, held, 5).columns == ["query_id", "id", "score", "rank"] and bags.top_batch(held, held, 5).count() == 0
    held = bags.bags(spark.createDataFrame([(1, []), (2, ["a"])], "doc_id long, w array<string>"), F.col("w"))
    assert bags.top_batch(held, held.filter("id = 1"), 5).count() == 0


def test_token_bag_has_the_tokens(spark):
    odd = ["the CamelCase cache_line", "x y zz é ß añb Ünder über.straße,ÉTÉ", "a1b2 HTTPServer foo-bar _x-", None, "", "  ", "σς Σ ΑΣ ǅ ﬁ ªº", "ab\u0085cd ab\u0085  ab x\x0by", "日本 word日本 ab cd", "don't [a]b {cd}|ef^gh~i&jk"]
    rng = random.Random(1)
    odd += ["".join(rng.choice("abZéÉ1_- .,'́") for _ in range(60)) for _ in range(300)]
    d = spark.createDataFrame([(s,) for s in odd], "text string")
    for r in d.select("text", F.array_sort(X.code_tokens(F.col("text"))).alias("a"), F.array_sort(X.code_token_bag(F.col("text"))).alias("b")).collect():
        assert r.a == r.b, r.text


def moved(spark):
    """Rows written to shuffles so far."""
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_pair_moves(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=80))) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    before = moved(spark)
    got = catalog.queries()["bm25_batch"](spark, f"file://{tmp_path}").collect()
    assert len(got) == 30 * 5 and all(r.score > 0 for r in got)
    # 90,000 pairs share words, and there are over 130,000 postings
    assert moved(spark) - before < 20_000
