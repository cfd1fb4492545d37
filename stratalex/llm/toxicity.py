"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: lower case, homoglyphs of other scripts to Latin
letters, digits and signs between letters to the letters they stand for. Runs
of anything else become one space, so a lexicon entry that begins with a space
matches at the start of a word only, and one that ends with a space matches
whole words.

The lexicon is learnt from labelled rows: whole words and word beginnings of
STEMS characters that go with the label beyond chance, whatever number of
entries was looked at, weighted by their smoothed log odds. Exception phrases are learnt too: pairs of words around an entry
that occur in clean texts only; an entry inside such a phrase doesn't count.
The score is the logistic of the matched weight: the k-th strongest word adds
a k-th of its weight, and the logarithm of the words per match, beyond 20, is
taken off, so long texts must gather more.

Labels are read from training rows only and are bounded: at most SAMPLE
labelled training rows, the ones of smallest hash, take part in learning, so
what the driver sees, the entries and phrases that these rows prove, is bounded
(documented parameter). No entry and no phrase is left out for its number, and
everything else covers all rows.

Defined cases: null and empty texts match nothing and get the score of a text
without matches; a document with several labels counts as toxic if one says
so; null labels are ignored; no labelled rows: every score is PRIOR; repeated
rows are scored each; extra columns are carried.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalex.llm.textkit import bounded, shingle_sets, slices, small_batches, table, words

SAMPLE = 20_000
STEMS = (4, 5, 6)
PRIOR = 0.05
#: Matched weight at which a text of 20 words per match is as likely toxic as not.
OFFSET = 3.5

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴏ": "o",
}
#: Digits and signs that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
LEET = r"[0-9@$!|]"


def fold_table():
    """str.translate's table: what each character becomes."""

    class Table(dict):
        def __missing__(self, code):
            ch = chr(code)
            out = []
            for c in unicodedata.normalize("NFKC", ch).lower():
                c = HOMOGLYPHS.get(c, c)
                kind = unicodedata.category(c)
                if kind in ("Cf", "Mn"):  # zero-width and combining marks
                    continue
                out.append(c if c.isalpha() or c in DIGITS or c.isdigit() else " ")
            self[code] = out = "".join(out)
            return out

    return Table()


def folder():
    """fold(text): lower-cased words of letters between single spaces, with a space at either end."""
    import re

    table_ = fold_table()
    inner = re.compile(rf"(?<=[^\W\d_]){LEET}+(?=[^\W\d_])|(?<![\w@$!|]){LEET}+(?=[^\W\d_]{{2}})|(?<=[^\W\d_]{{2}}){LEET}+(?![\w@$!|])")
    signs = re.compile(r"[@$!|]+")
    letters = str.maketrans(DIGITS)
    likely = re.compile(LEET)

    def fold(text):
        t = text.translate(table_)

        def letter(m):
            if m.end() < len(t) and t[m.end()].isalpha():
                return m[0].translate(letters)
            core = m[0].rstrip("@$!|")  # signs that end a word are punctuation
            return core.translate(letters) + " " * (core != m[0])

        if likely.search(t):
            t = signs.sub(" ", inner.sub(letter, t))
        return " " + " ".join(t.split()) + " "

    return fold


def features(folded):
    """Entries that a folded text holds: whole words and word beginnings."""
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in STEMS if len(w) > k)
    return found


def _least(batches):
    """Adds the least hash of each text's three-word shingles."""
    for batch, data, offs in slices(batches):
        hashes, first = words(data, offs)
        sets, at = shingle_sets(hashes, first, 3)
        least = np.zeros(len(offs) - 1, np.uint64)
        some = at[1:] > at[:-1]
        least[some] = sets[at[:-1][some]]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], names=[*batch.schema.names, "least"])


def _counts(batches):
    """(entry, toxic texts, texts) that hold each entry, summed within the task."""
    fold, all_, bad = folder(), Counter(), Counter()

    def send():
        keys = list(all_)
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([bad[x] for x in part], pa.int64()), pa.array([all_[x] for x in part], pa.int64())], names=["entry", "k1", "k"])

    for batch in batches:
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = features(fold(t or ""))
            all_.update(found)
            if y:
                bad.update(found)
            if len(all_) > 150_000:
                yield from send()
                all_.clear()
                bad.clear()
    yield from send()


def _phrases(entries):
    """Word pairs around entries, in the labelled rows: (phrase, entry, toxic)."""

    def run(batches):
        fold, match = folder(), matcher(entries.value)
        for batch in batches:
            out = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = fold(t or "")
                seen = set()
                for end, e in match.iter(f):
                    seen.update((p, e) for p in around(f, end + 1 - len(e), e))
                out += [(p, e, y) for p, e in sorted(seen)]
            cols = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()))], names=["phrase", "entry", "toxic"])

    return run


def around(folded, at, entry):
    """The word of an entry with the word before it, and with the one after."""
    end = folded.find(" ", at + 1)
    before = folded.rfind(" ", 0, max(at, 0)) if at > 0 else -1
    if before >= 0:
        yield folded[before : end + 1]
    after = folded.find(" ", end + 1)
    if after > end:
        yield folded[at : after + 1]


def matcher(words):
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    if len(words):
        a.make_automaton()
    return a


def least_texts(sizes, prior):
    """(least number of texts that can prove an entry at all, entries of so many) of {texts: entries}."""
    few = 1
    while True:
        tests = max(1, sum(n for k, n in sizes.items() if k >= few))
        if few * math.log(1 / prior) > math.log(tests) + 1 or few > max(sizes, default=1):
            return few, tests
        few += 1


def learn(docs, labels, sample=SAMPLE):
    """{"weights": {entry: weight}, "exceptions": [phrase]} from the labelled rows of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `sample` rows
    # of near copies only one speaks: those that share the least hash of three-word shingles
    own = own.mapInArrow(bounded(_least), "doc_id bigint, text string, toxic int, least bigint")
    own = own.groupBy("least", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("text", "toxic").persist()
    totals = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).toLocalIterator()}
    n1, n0 = totals.get(1, 0), sum(totals.values()) - totals.get(1, 0)
    if not n1 or not n0:
        own.unpersist()
        return {"weights": {}, "exceptions": [], "prior": PRIOR}
    found = own.mapInArrow(bounded(_counts), "entry string, k1 bigint, k bigint")
    counts = found.groupBy("entry").agg(F.sum("k1").alias("k1"), F.sum("k").alias("k"))
    counts = counts.persist()
    # an entry of so few texts that even all of them toxic prove nothing wasn't looked at; sizes are at most the sample's
    sizes = {r.k: r.n for r in counts.groupBy("k").agg(F.count("*").alias("n")).toLocalIterator()}
    few, tests = least_texts(sizes, n1 / (n1 + n0))
    counts = counts.filter(F.col("k") >= few)
    odds = F.log((F.col("k1") + 0.5) / (n1 + 1)) - F.log((F.col("k") - F.col("k1") + 0.5) / (n0 + 1))
    # Chernoff's bound on chance, over all entries that were looked at: fewer than one in e is there by chance
    rate, prior = F.col("k1") / F.col("k"), n1 / (n1 + n0)
    gain = F.when(F.col("k1") > 0, F.col("k1") * F.log(rate / prior)).otherwise(0.0) + F.when(rate < 1, (F.col("k") - F.col("k1")) * F.log((1 - rate) / (1 - prior))).otherwise(0.0)
    best = counts.withColumn("w", odds).filter((rate > 0.5) & (gain > math.log(tests) + 1))
    rows = {r.entry: (r.k1, float(r.w)) for r in best.toLocalIterator()}
    # a word beginning says nothing of its own where one longer entry stands for nearly all of it
    longer = {}
    for e, (k1, _) in rows.items():
        for i in range(2, len(e)):
            longer[e[:i]] = max(longer.get(e[:i], 0), k1)
    weights = {e: w for e, (k1, w) in rows.items() if longer.get(e, 0) < 0.95 * k1}
    exceptions = []
    if weights:
        held = docs.sparkSession.sparkContext.broadcast(sorted(weights))
        seen = own.mapInArrow(bounded(_phrases(held)), "phrase string, entry string, toxic int")
        clean = seen.groupBy("phrase").agg(F.sum("toxic").alias("k1"), F.count("*").alias("k")).filter("k1 = 0")
        # seen in clean texts only, and often enough that its own smoothed log odds speak for a clean text
        exceptions = sorted(r.phrase for r in clean.filter((F.col("k") + 0.5) / (n0 + 1) > 0.5 / (n1 + 1)).toLocalIterator())
    own.unpersist()
    counts.unpersist()
    return {"weights": weights, "exceptions": exceptions, "prior": n1 / (n1 + n0)}


def score_one(folded, match, weights, block, prior):
    """The score of one folded text."""
    hits = list(match.iter(folded)) if len(match) else []
    base = math.log(prior / (1 - prior))
    if not hits:
        return 1 / (1 + math.exp(min(30.0, 3.0 - base)))
    spans = [(end + 1 - len(p), end + 1) for end, p in block.iter(folded)] if len(block) else []
    words = {}
    for end, e in hits:
        a = end + 1 - len(e)
        if any(x <= a and end + 1 <= y for x, y in spans):
            continue
        words[a] = max(words.get(a, 0.0), weights[e])  # one entry for each word: the strongest
    if not words:
        return 1 / (1 + math.exp(min(30.0, 3.0 - base)))
    # the k-th word found adds a k-th of its weight; long texts must gather more
    total = sum(w / (k + 1) for k, w in enumerate(sorted(words.values(), reverse=True)))
    n = folded.count(" ") - 1
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total - OFFSET - 0.25 * math.log(max(1.0, n / len(words) / 20))))))


def _score_batches(model, at, name):
    def run(batches):
        m = model.value
        fold, match, block = folder(), matcher(sorted(m["weights"])), matcher(m["exceptions"])
        for batch in batches:
            out = [score_one(fold(t or ""), match, m["weights"], block, m["prior"]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(out, float))], names=[*batch.schema.names, name])

    return run


def score(docs, model, text="text", name="score"):
    """docs with a score from 0 to 1 added (a column of that name is replaced)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(bounded(_score_batches(held, docs.columns.index(text), name)), f"{schema}, `{name}` double")


def remove_toxic(docs, labels, threshold=0.5, training=None):
    """The documents whose score stays below the threshold, with their own columns."""
    scored = score(docs, learn(training if training is not None else docs, labels), name="_toxicity")
    return scored.filter(F.col("_toxicity") < threshold).drop("_toxicity")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs.filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
