"""Language-model scores (op 1), toxicity (op 2), decontamination (op 8), licenses (op 5), token counts (op 10)."""

import functools
import math
import random
import re
from collections import Counter

import pytest

from stratalex.llm import decontaminate, licenses, ppm, toxicity, wordpiece


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_scores_are_those_of_the_definition(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "Zé", "q", "the", "tha"]) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", " a\n\nb "]
    held = ["abc ab", "the é q", "zzzz", "", " x\ty ", "ab" * 50, *texts[:10]]
    schema = "doc_id long, text string"
    rows = {r.doc_id: r for r in ppm.score_texts(spark.createDataFrame(list(enumerate(held)), schema), spark.createDataFrame(list(enumerate(texts)), schema)).collect()}
    logp, count = ppm.brute(texts), Counter()
    for t in texts:
        count.update(tokens(t))
    total, distinct = sum(count.values()), len(count)
    for i, t in enumerate(held):
        assert rows[i].score == pytest.approx(logp(t), abs=1e-3)
        assert rows[i].base_score == pytest.approx(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in tokens(t)))
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), total)


def test_a_bounded_trie_still_gives_probabilities(spark):
    docs = spark.createDataFrame([(i, f"word{i} and word{i % 7} again") for i in range(200)], "doc_id long, text string")
    few = {r.doc_id: r.score for r in ppm.score_texts(docs, docs, heavy=8, entries=600).collect()}
    full = {r.doc_id: r.score for r in ppm.score_texts(docs, docs).collect()}
    assert sum(few.values()) < sum(full.values()) < 0 and max(few.values()) < 0


@pytest.mark.parametrize("cells, tail", [(1, 0), (600, 40), (600, 10**6)])
def test_contexts_beyond_the_automaton_still_count(spark, cells, tail):
    rng = random.Random(4)
    voc = ["ab", "abc", "Zé", "q", "the", "tha", "abq", "hat", "cab"]
    texts = [" ".join(rng.choice(voc) for _ in range(rng.randrange(12))) for _ in range(80)] + [None, "", " a\n\nb "]
    held = ["abc ab", "the é q", "zzzz", "", " x\ty ", "ab" * 50, "catab hatthe qq", "abc zthe ab", *texts[:10]]
    schema = "doc_id long, text string"
    docs, training = (spark.createDataFrame(list(enumerate(x)), schema) for x in (held, texts))
    rows = {r.doc_id: r.score for r in ppm.score_texts(docs, training, cells=cells, tail=tail).collect()}
    logp = ppm.brute(texts)
    assert len(rows) == len(held)
    for i, t in enumerate(held):
        assert rows[i] == pytest.approx(logp(t), abs=1e-3)


def test_scores_of_nasty_rows(nasty, empty):
    rows = ppm.score_texts(nasty, nasty.filter("doc_id % 2 = 0")).collect()
    assert len(rows) == nasty.count() and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert ppm.score_texts(empty, nasty).count() == 0
    assert {r.n_known for r in ppm.score_texts(nasty, empty).collect()} == {0}


def test_folding():
    fold = toxicity.folder()
    assert fold("раthetic wоrthless") == " pathetic worthless "
    assert fold("1diot 5cum st​upid wh@t 2024 hello!") == " idiot scum stupid what 2024 hello "


def corpus(spark, n=400):
    rng = random.Random(2)
    voc = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "ame") for b in ("a", "um", "or", "et", "is")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(voc) for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["vilething", "gr0tfool", "nastyx"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(spark)
    model = toxicity.learn(docs.filter("doc_id % 4 <> 0"), labels.filter("doc_id % 4 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if i % 4 == 0]
    assert sum((got[i] >= 0.5) == (truth[i] == 1) for i in held) / len(held) >= 0.98
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= 310


def test_an_exception_phrase_is_learnt(spark):
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        rows.append((i, ["plain words only here", "you grumblefoot go away", "the wise grumblefoot bird sings"][kind] + f" t{i}"))
        labels.append((i, int(kind == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 1) for i in got)


def test_toxicity_of_nasty_rows(spark, nasty, empty):
    docs, labels = corpus(spark)
    out = toxicity.score(nasty, toxicity.learn(docs, labels))
    assert out.count() == nasty.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, toxicity.learn(docs, labels)).count() == 0
    left = toxicity.remove_toxic(nasty, labels.limit(0))
    assert left.columns == nasty.columns and sorted(map(str, left.collect())) == sorted(map(str, nasty.collect()))


def score_by_hand(text, model):
    """The score of one text by looking for each entry at each place."""
    import unicodedata

    folded = ""
    for ch in text or "":
        for c in unicodedata.normalize("NFKC", ch).lower():
            c = toxicity.HOMOGLYPHS.get(c, c)
            if unicodedata.category(c) not in ("Cf", "Mn"):
                folded += c if c.isalpha() or c.isdigit() or c in toxicity.DIGITS else " "
    assert not re.search(toxicity.LEET, folded)  # these texts have no digits
    folded = " " + " ".join(folded.split()) + " "
    prior = math.log(model["prior"] / (1 - model["prior"]))
    free = [(m, m + len(p)) for p in model["exceptions"] for m in range(len(folded)) if folded.startswith(p, m)]
    found = {}
    for e, w in model["weights"].items():
        for a in range(len(folded)):
            if folded.startswith(e, a) and not any(x <= a and a + len(e) <= y for x, y in free):
                found[a] = max(found.get(a, 0.0), w)
    if not found:
        return 1 / (1 + math.exp(min(30.0, 3.0 - prior)))
    total = sum(w / (k + 1) for k, w in enumerate(sorted(found.values(), reverse=True)))
    words_ = len(folded.split())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total - toxicity.OFFSET - 0.25 * math.log(max(1.0, words_ / len(found) / 20))))))


def test_scores_are_those_by_hand(spark):
    rng = random.Random(5)
    voc = ["calm", "river", "grumblefoot", "vilething", "vile", "stone", "wise", "bird", "éclair", "Vilething"]
    rows = []
    for i in range(240):
        w = [rng.choice(voc[:2] + voc[5:9]) for _ in range(rng.randrange(1, 30))]
        kind = i % 4
        w[rng.randrange(len(w)) : 0] = [["vilething"], ["wise", "grumblefoot", "bird"], ["you", "grumblefoot", "go"], []][kind]
        rows.append((i, " ".join(w), int(kind in (0, 2))))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    # several labels: toxic if one says so; null labels and ids say nothing
    labels = [(i, y) for i, _, y in rows] + [(0, 0), (0, None), (None, 1), (1, None)]
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model["weights"]
    asked = [" ".join(rng.choice(voc) for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "wise grumblefoot bird", "ｖｉｌｅthing vi\u200blething"]
    for name in ("score", "toxic"):
        out = toxicity.score(spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(asked)], f"doc_id long, text string, {name} double"), model, name=name)
        assert {r.doc_id: round(r[name], 9) for r in out.collect()} == {i: round(score_by_hand(t, model), 9) for i, t in enumerate(asked)}


def test_entries_that_can_prove_nothing_are_not_counted():
    few, tests = toxicity.least_texts({1: 100_000, 2: 5_000, 5: 300, 9: 40}, 0.1)
    assert few * math.log(10) > math.log(tests) + 1 and (few - 1) * math.log(10) <= math.log(sum(n for k, n in {1: 100_000, 2: 5_000, 5: 300, 9: 40}.items() if k >= few - 1)) + 1


def words(rng, n):
    return [rng.choice(["an", "the", "é1", "ly", "re", "x", "thon", "of"]) for _ in range(n)]


@pytest.mark.parametrize("limit", [16_000_000, 300])
def test_decontamination_against_brute_force(spark, limit):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([13, 14, 30, 5, 1, 60, 25])] + [(90, None), (91, "..."), (3, "an the re thon of ly")]
    docs = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 120))
        if i % 3 == 0:
            own = (items[i % 7][1] or "").split()
            a = rng.randrange(0, max(1, len(own) - 12))
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = own[a : a + rng.randrange(5, 40)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 2 else " ".join(w)))
    found = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=limit)
    for r in found.collect():
        n, hit, ids = decontaminate.brute(r.text, items)
        assert (r.n_words, r.n_hit, list(r["items"])) == (n, hit, ids)
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_decontamination_of_nasty_rows(spark, nasty, empty):
    items = spark.createDataFrame([(1, "same words in this text here")], "item_id long, text string")
    out = decontaminate.find_contamination(nasty, items)
    assert out.count() == nasty.count() and out.filter("contaminated").count() == 4
    clash = nasty.withColumnRenamed("n", "n_words").withColumnRenamed("score", "items")
    left = decontaminate.remove_contaminated(clash, items)
    assert left.columns == clash.columns and set(map(str, left.collect())) < set(map(str, clash.collect()))
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.find_contamination(nasty, items.limit(0)).filter("contaminated").count() == 0


def test_licenses_are_found_where_they_are(spark):
    rng = random.Random(1)
    rows = []
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = text.split()
        fill = [rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(40 + i)]
        rows.append((i, " ".join(fill + w + fill[:17]), name))
        if len(w) > 40:
            w[rng.randrange(len(w))] = "zzz"
            w[rng.randrange(len(w))] = "yyy"
            rows.append((100 + i, " ".join(fill[:i] + w + fill), name))
    rows += [(900, None, None), (901, "lorem ipsum " * 50, None), (902, "released under the mit", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    found = {r.doc_id: list(r.licenses) for r in licenses.scan(docs).collect()}
    assert all(name in found[i] for i, _, name in rows if name)
    assert found[900] == found[901] == found[902] == []


@functools.cache
def shingles(text):
    w = licenses.words_of(text)
    return {tuple(w[i : i + licenses.K]) for i in range(len(w) - licenses.K + 1)}


def contained(text, templates):
    """(words, sorted names, largest share) by exact containment of shingles."""
    w = licenses.words_of(text or "")
    own = shingles(text or "")
    share = {name: len(own & shingles(t)) / len(shingles(t)) for name, t in templates.items()}
    names = sorted(n for n, v in share.items() if v >= licenses.CONTAINMENT)
    return len(w), names, max((share[n] for n in names), default=0.0)


def told(rows):
    return {r.doc_id: (r.n_words, list(r.licenses), pytest.approx(r.containment)) for r in rows}


def test_licenses_of_nasty_rows(nasty, empty):
    rows = licenses.scan(nasty).collect()
    assert sorted(map(str, ((r.doc_id, r.n_words, list(r.licenses)) for r in rows))) == sorted(str((r.doc_id, *contained(r.text, licenses.TEMPLATES)[:2])) for r in nasty.collect())
    assert licenses.scan(empty).count() == 0 and licenses.scan_tables(empty, empty.sparkSession.createDataFrame(sorted(licenses.TEMPLATES.items()), "license string, body string")).count() == 0


def test_five_hundred_templates(spark):
    """More templates than literals may be: by tables, the same as by hand, and as by literals for the templates of both."""
    rng = random.Random(12)
    voc = [f"w{i}" for i in range(4000)]
    many = {f"t{i:03}": " ".join(rng.choice(voc) for _ in range(rng.randrange(5, 130))) for i in range(500)}
    assert sum(len(t.split()) for t in many.values()) > licenses.TEMPLATE_WORDS
    names, rows = sorted(many), []
    for i in range(60):
        w = [rng.choice(voc) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            own = many[rng.choice(names)].split()
            if rng.random() < 0.3:
                own[rng.randrange(len(own))] = "changed"
            w[rng.randrange(len(w) + 1) : 0] = own
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, many).collect()
    want = {i: contained(t, many) for i, t in rows}
    assert len(got) == len(rows) and sum(len(x[1]) for x in want.values()) > 20
    lost = sum(len(set(want[r.doc_id][1]) - set(r.licenses)) for r in got)
    assert all(set(r.licenses) <= set(want[r.doc_id][1]) for r in got) and lost <= 0.02 * sum(len(x[1]) for x in want.values())
    few = {n: many[n] for n in names[:6]}
    a, b = licenses.scan(docs, few), licenses.scan_tables(docs, spark.createDataFrame(sorted(few.items()), "license string, body string"))
    shown = lambda df: sorted((str(r.doc_id), r.n_words, tuple(r.licenses), round(r.containment, 9)) for r in df.collect())
    assert shown(a) == shown(b)


def test_recall_of_the_bands(spark):
    """Windows of similarity 0.8 share a band with the stated probability, measured over 2,000 pairs."""
    rng = random.Random(3)
    rows = []
    for _ in range(2000):
        both = [rng.getrandbits(62) for _ in range(16)]
        extra = [rng.getrandbits(62) for _ in range(2)]
        rows.append((both + extra, both[:14] + both[14:] + [rng.getrandbits(62) for _ in range(2)]))  # 16 of 20
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    keys = [F.array(*licenses.band_keys(licenses.least(F.col(c)))) for c in "ab"]
    recall = df.select(F.arrays_overlap(*keys).cast("double").alias("x")).agg(F.avg("x")).first()[0]
    assert recall >= 1 - (1 - 0.8**licenses.ROWS) ** licenses.BANDS - 0.02


def test_license_scan_has_no_python(spark, sf):
    plan = licenses.op5_license_scans(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_token_counts_against_greedy_matching(spark, nasty, empty):
    pieces = [b" a", b"ab", b" ab", b"abc", b" abcde", b"cd", b"e", b"def", b" d", b"fabab", b"bab"]
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 30)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in wordpiece.count_tokens(docs, pieces).collect():
        assert (r.n_words, r.n_tokens) == wordpiece.brute(r.text, pieces)
    known = wordpiece.vocabulary()
    for r in wordpiece.count_tokens(nasty).collect():
        assert (r.n_words, r.n_tokens) == wordpiece.brute(r.text, known)
    assert wordpiece.count_tokens(empty).count() == 0
