"""Language-model scores by prediction by partial matching.

A trie of byte contexts of up to ORDER bytes holds how often each byte followed
each context in the training texts. A byte that a context has not seen costs
the context's escape (method D: half of distinct / total, each count less half) and is then
predicted by the next shorter context, from whose counts all bytes that the
longer one has seen are excluded; below the empty context all bytes that are
left are equally likely. Since the trie is fixed when texts are scored, the
cost of each byte in each context, escapes and exclusions included, is worked
out once, and the trie becomes an automaton: state = longest known context,
with one cost and one next state for each byte. Texts are scored in many lanes
at once; a lane that starts within a text first reads the ORDER bytes before
it, which fix its state.

The model describes what the contract's tokens are made of: the text with A-Z
lower-cased, each run of white space one space, none at either end, and an end
symbol after it. Texts of the same tokens get the same score.

Counts are taken over all training texts, and the trie has every context that
occurs in them. What is broadcast is bounded all the same: the automaton holds
the contexts of largest count, as many as fit into `cells` cells (states times
symbols), never one without its suffixes and prefixes, and so the costs of its
states of ORDER symbols are those of the whole trie. Where contexts were left
out, the bytes read in a shorter state are priced by their gram of ORDER + 1
symbols: from a broadcast table of the `tail` most frequent of the other
trained grams, and by joins for the rest - trained grams by their counts, new
ones by the counts along their chain of suffixes. A caller may cut the model
itself to the contexts that fit into `entries` cells; the query doesn't.

The base score is a unigram model with one added to each count. The words that
make up at least 1/HEAVY of all tokens - at most HEAVY words - are looked up in
a broadcast table, the others by a join.

Defined cases: a null text is empty and has the end token only; a null doc_id
counts as the empty string for the split; repeated rows are scored and counted
each; without training texts every count is 0 and all 257 symbols are equally
likely; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from stratalex.llm.textkit import LOWER, WHITE, bounded, drop_scratch, settle, slices, span_hashes, spans, table

ORDER = 5
END = 256
#: Cells of the automaton's tables; each has a cost and a next state of four bytes.
CELLS = 2**22
#: Grams beyond the automaton that are broadcast with their costs, twelve bytes each.
TAIL = 2**20
HEAVY = 2**17
LANES = 8192
#: Distinct words and contexts that a task holds before it sends their counts on.
HELD = 1_500_000


def canonical(data, offs):
    """Lower-cased bytes with one space between words, none at the ends: (bytes, offsets, word starts, word ends, first words)."""
    inside = ~WHITE[data]
    starts, ends, first = spans(inside, offs)
    keep = inside.copy()
    if len(starts):
        gap = np.ones(len(starts), bool)  # a space follows each word but a document's last
        last = first[1:][np.diff(first) > 0] - 1
        gap[last] = False
        keep[ends[gap]] = True
    low = np.where(inside, LOWER[data], 32).astype(np.uint8)
    at = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], at[offs], at[starts], at[ends], first


def symbols(data, offs):
    """ORDER ENDs before the first document and after each: (symbols, start of each document); its first END is scored."""
    docs = len(offs) - 1
    out = np.full(len(data) + ORDER * (docs + 1), END, np.int16)
    out[np.arange(len(data)) + np.repeat(np.arange(1, docs + 1) * ORDER, np.diff(offs))] = data
    return out, offs[:-1] + np.arange(1, docs + 1) * ORDER


def grams(syms, starts, lengths):
    """ORDER + 1 symbols of nine bits each, up to and including each scored one."""
    x = syms.astype(np.int64)
    key = np.zeros(len(x) - ORDER, np.int64)
    for j in range(ORDER + 1):
        key = (key << 9) | x[j : len(x) - ORDER + j]
    scored = np.zeros(len(x) + 1, np.int64)
    scored[starts] += 1
    scored[starts + lengths + 1] -= 1
    return key[np.cumsum(scored)[ORDER:-1] > 0]


def _merge(held):
    key = np.concatenate([k for k, _ in held])
    n = np.concatenate([c for _, c in held])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], np.add.reduceat(n, first)


def _count(batches):
    """(kind, key, n): words by hash (0), contexts with their next symbol (1), texts (2)."""
    held, docs = {0: [], 1: []}, 0

    def send(kind):
        key, n = _merge(held[kind])
        held[kind] = []
        for i in range(0, len(key), 200_000):
            part = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), kind, np.int32)), pa.array(key[part]), pa.array(n[part])], names=["kind", "key", "n"])

    for _, data, offs in slices(batches):
        text, at, starts, ends, first = canonical(data, offs)
        docs += len(at) - 1
        for kind, keys in ((0, span_hashes(text, starts, ends).view(np.int64)), (1, grams(*symbols(text, at), np.diff(at)))):
            if not len(keys):
                continue
            keys = np.sort(keys)
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            held[kind].append((keys[new], np.diff(np.r_[new, len(keys)])))
            if sum(len(k) for k, _ in held[kind]) >= HELD:
                held[kind] = [_merge(held[kind])]
                if len(held[kind][0][0]) >= HELD // 2:
                    yield from send(kind)
    for kind in held:
        if held[kind]:
            yield from send(kind)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"])


def automaton(rows, order=ORDER):
    """Tables of {(length, context): {symbol: count}} given as (length, context, symbol, count) arrays.

    Returns (columns: symbol -> column, costs: states x columns of log10, next
    states, first state of `order` symbols). Column 0 stands for every symbol
    that training never saw.
    """
    length, ctx, sym, n = (np.asarray(x, np.int64) for x in rows)
    seen = np.unique(sym)
    columns = np.zeros(257, np.int32)
    columns[seen] = np.arange(1, len(seen) + 1)
    width = len(seen) + 1
    if not len(sym):
        return columns, np.full((1, 1), -np.log10(257), np.float32), np.zeros((1, 1), np.int32), 1
    unseen = 257 - len(seen)
    costs, nexts, index, totals, kinds, hold = [], [], [], [], [], []
    for k in range(order + 1):
        own = length == k
        keys, row = np.unique(ctx[own], return_inverse=True)
        if not len(keys):
            break
        counts = np.zeros((len(keys), width), np.float32)
        counts[row, columns[sym[own]]] = n[own]
        total = np.zeros(len(keys))
        np.add.at(total, row, n[own].astype(float))
        distinct = np.bincount(row, minlength=len(keys)).astype(float)
        cost = np.empty((len(keys), width), np.float32)
        index.append(keys)
        totals.append(total)
        kinds.append(distinct)
        hold.append(counts)
        for a in range(0, len(keys), 4096):
            part = slice(a, a + 4096)
            c = counts[part].astype(float)
            t, d = total[part][:, None], distinct[part][:, None]
            escape = d / 2 / t
            with np.errstate(divide="ignore", invalid="ignore"):
                if k == 0:
                    # what no count has: equal shares of the escape; column 0 holds the share of one unseen symbol
                    p = np.where(c > 0, (c - 0.5) / t, escape / max(1, unseen))
                else:
                    up = np.searchsorted(index[k - 1], keys[part] & ((1 << (9 * (k - 1))) - 1))
                    cu, tu, du = hold[k - 1][up].astype(float), totals[k - 1][up][:, None], kinds[k - 1][up][:, None]
                    below = 10.0 ** costs[k - 1][up].astype(float)
                    left = tu - np.where(c > 0, cu, 0).sum(1, keepdims=True)
                    rest = du - d
                    # a symbol of the shorter context, the longer one's excluded
                    there = np.where(left > 0, (cu - 0.5) / left, 0)
                    # a symbol of neither: the shorter context's own escape, corrected for the exclusion
                    under = np.where(rest > 0, rest / 2 / left, 1.0) * below * tu / (du / 2)
                    p = np.where(c > 0, (c - 0.5) / t, escape * np.where(cu > 0, there, under))
                cost[part] = np.log10(p)
        costs.append(cost)
    starts = np.cumsum([0] + [len(x) for x in index])
    original = np.zeros(width, np.int64)
    original[columns[seen]] = seen
    for k in range(len(index)):
        to = np.zeros((len(index[k]), width), np.int32)
        done = np.zeros(to.shape, bool)
        for m in range(min(k + 1, len(index) - 1), 0, -1):
            mask = (1 << (9 * m)) - 1
            for a in range(0, len(to), 8192):
                part = slice(a, a + 8192)
                want = ((index[k][part][:, None] << 9) | original[None, :]) & mask
                at = np.minimum(np.searchsorted(index[m], want), len(index[m]) - 1)
                hit = (index[m][at] == want) & ~done[part]
                hit[:, 0] = False
                block = to[part]
                block[hit] = (starts[m] + at)[hit]
                done[part] |= hit
        nexts.append(to)
    return columns, np.concatenate(costs), np.concatenate(nexts), int(starts[min(order, len(index))])


def walk(model, syms):
    """The automaton's log10 cost of each symbol from ORDER on, and whether it was read in a state below `open_below`."""
    columns, costs, nexts, open_below = model
    width = costs.shape[1]
    col = columns[syms]
    n = len(col) - ORDER
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    pad = np.zeros(lanes * steps + ORDER, np.int32)
    pad[: len(col)] = col
    flat_cost, flat_next = costs.ravel(), nexts.ravel() * width
    begin = np.arange(lanes) * steps
    grid = np.ascontiguousarray(pad[ORDER:].reshape(lanes, steps).T)
    state = np.zeros(lanes, np.int32)
    for j in range(ORDER):
        state = flat_next.take(state + pad[begin + j])
    out = np.empty((steps, lanes), np.float32)
    loose = np.zeros((steps, lanes), bool)
    for j in range(steps):
        at = state + grid[j]
        out[j] = flat_cost.take(at)
        if open_below:
            np.less(state, open_below * width, out=loose[j])
        state = flat_next.take(at)
    return out.T.ravel()[:n], loose.T.ravel()[:n]


def score(model, tail, syms, starts, lengths):
    """(log10 probability of each document, of its bytes and its end, without open grams; document, key and number of the open grams)."""
    cost, loose = walk(model, syms)
    begin, end = starts - ORDER, starts - ORDER + lengths + 1
    at = np.flatnonzero(loose)
    doc = np.searchsorted(begin, at, "right") - 1
    ok = (doc >= 0) & (at < end[doc])
    at, doc = at[ok], doc[ok]
    key = np.zeros(len(at), np.int64)
    for j in range(ORDER + 1):
        key = (key << 9) | syms[at + j]
    order = np.lexsort((key, doc))
    at, doc, key = at[order], doc[order], key[order]
    priced = np.zeros(len(at), np.float32)
    open_ = np.ones(len(at), bool)
    if len(tail[0]) and len(at):
        pos = np.minimum(np.searchsorted(tail[0], key), len(tail[0]) - 1)
        open_ = tail[0][pos] != key
        priced = np.where(open_, np.float32(0), tail[1][pos])
    cost[at] = priced
    total = np.concatenate([[0.0], np.cumsum(cost, dtype=float)])
    doc, key = doc[open_], key[open_]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)])
    return total[end] - total[begin], doc[first], key[first], np.diff(np.r_[first, len(key)])


def _score_batches(model, tail, heavy):
    """(uid, doc_id, n_tokens, n_known, logs, score, rare, grams): rare holds the hashes of the words that the heavy table lacks, grams the open grams."""

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        tables, more = model.value, tail.value
        keys, counts = heavy.value
        logs = np.log10(counts + 1.0)
        for batch, data, offs in slices(batches):
            text, at, starts, ends, first = canonical(data, offs)
            h = span_hashes(text, starts, ends).view(np.int64)
            docs = len(at) - 1
            found = np.zeros(len(h), bool)
            part = np.zeros(len(h))
            if len(keys) and len(h):
                order = np.argsort(h)
                pos = np.minimum(np.searchsorted(keys, h[order]), len(keys) - 1)
                ok = keys[pos] == h[order]
                found[order] = ok
                part[order] = np.where(ok, logs[pos], 0)
            known = np.concatenate([[0], np.cumsum(found)])
            total = np.concatenate([[0.0], np.cumsum(part)])
            rare = ~found
            cut = np.concatenate([[0], np.cumsum(rare)])[first]
            syms, begin = symbols(text, at)
            scores, owner, gram, times = score(tables, more, syms, begin, np.diff(at))
            open_ = pa.StructArray.from_arrays([pa.array(gram), pa.array(times)], names=["key", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(docs)), batch.column(0), pa.array(np.diff(first) + 1), pa.array(np.diff(known[first])), pa.array(np.diff(total[first])),
                    pa.array(scores), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[rare])),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(docs + 1)), pa.int32()), open_),
                ],
                names=["uid", "doc_id", "n_tokens", "n_known", "logs", "score", "rare", "grams"],
            )
            uid += docs

    return run


def _suffixes(grams_, order):
    """(length, context, symbol, n) of all contexts of up to `order` symbols."""
    c = F.shiftright("key", 9)
    each = [F.struct(F.lit(k).alias("length"), c.bitwiseAND(F.lit((1 << (9 * k)) - 1)).alias("ctx")) for k in range(order + 1)]
    long = grams_.select(F.explode(F.array(*each)).alias("x"), F.col("key").bitwiseAND(F.lit(511)).alias("sym"), "n")
    return long.groupBy("x.length", "x.ctx", "sym").agg(F.sum("n").alias("n"))


def train(counts, entries=None, order=ORDER, cells=CELLS, tail=TAIL):
    """(automaton of the counted contexts, (keys, costs) of frequent grams beyond it, a function that prices others or None)."""
    rows = settle(_suffixes(counts, order), "contexts")
    width = rows.select("sym").distinct().count() + 1
    sizes = settle(rows.groupBy("length", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")), "sizes")
    most = max(1, (entries or cells) // width)
    kept = settle(sizes.orderBy(F.desc("total"), "length", "ctx").limit(most).select("length", "ctx"), "kept")
    got = rows.join(F.broadcast(kept), ["length", "ctx"]).select("length", "ctx", "sym", "n").toArrow()
    columns, costs, nexts, full = automaton([got.column(i).to_numpy() for i in range(4)], order)
    if entries or sizes.count() <= most:
        for x in (rows, sizes, kept):
            drop_scratch(x)
        return (columns, costs, nexts, 0), (np.zeros(0, np.int64), np.zeros(0, np.float32)), None
    own = rows.filter(F.col("length") == order).join(F.broadcast(kept.filter(F.col("length") == order)), ["length", "ctx"], "left_anti").join(sizes, ["length", "ctx"])
    own = own.select(
        F.shiftleft("ctx", 9).bitwiseOR(F.col("sym")).alias("key"), F.floor(F.log2("n") * 32).alias("step"), F.log10((F.col("n") - 0.5) / F.col("total")).alias("cost")
    )
    known = settle(own, "grams")
    least, room = 2**11, tail  # steps from `least` on hold at most `tail` grams
    for r in sorted(known.groupBy("step").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    top = known.filter(F.col("step") >= least).select("key", F.col("cost").cast("float").alias("cost")).toArrow()
    keys, price = top.column(0).to_numpy(), top.column(1).to_numpy()
    at = np.argsort(keys)
    rest = known.filter(F.col("step") < least).select("key", "cost")
    return (columns, costs, nexts, full), (keys[at], price[at]), lambda asked: _price(asked, rest, rows, sizes, order)


def _price(asked, rest, rows, sizes, order):
    """(key, cost) of distinct grams (key): of trained ones by `rest`, of new ones by all their contexts."""
    priced = settle(asked.join(rest, "key", "left"), "priced")
    up = rows.select((F.col("length") + 1).alias("length"), F.col("ctx").alias("up"), "sym", F.col("n").alias("above"))
    both = rows.filter("length > 0").withColumn("up", F.expr("ctx & (shiftleft(1L, 9 * (length - 1)) - 1)")).join(up, ["length", "up", "sym"])
    # how often the shorter context has what the longer one has seen
    stats = sizes.join(both.groupBy("length", "ctx").agg(F.sum("above").alias("taken")), ["length", "ctx"], "left")
    each = [F.struct(F.lit(k).alias("length"), F.shiftright("key", 9).bitwiseAND(F.lit((1 << (9 * k)) - 1)).alias("ctx")) for k in range(order + 1)]
    chain = priced.filter("cost is null").select("key", F.col("key").bitwiseAND(F.lit(511)).cast("bigint").alias("sym"), F.explode(F.array(*each)).alias("x")).select("key", "sym", "x.*")

    def look(left, right, on, short, how):
        # contexts of few symbols, which many grams share, are broadcast: 2**(9 * short) at most
        a = left.filter(F.col("length") <= short).join(F.broadcast(right.filter(F.col("length") <= short)), on, how)
        return a.unionByName(left.filter(F.col("length") > short).join(right.filter(F.col("length") > short), on, how))

    chain = look(chain, stats, ["length", "ctx"], 2, "inner")
    chain = look(chain, rows, ["length", "ctx", "sym"], 1, "left")
    wide = chain.groupBy("key").agg(*(F.max(F.when(F.col("length") == k, F.col(c))).alias(f"{c}{k}") for k in range(order + 1) for c in ("total", "kinds", "taken", "n")))
    n, total, kinds, taken = ([F.col(f"{c}{k}") for k in range(order + 1)] for c in ("n", "total", "kinds", "taken"))
    below, cost = -F.log10(257.0 - kinds[0]), None  # below: from the context of k - 1 symbols, what the one of k has seen excluded
    for k in range(order + 1):
        here = F.when(n[k].isNotNull(), F.log10((n[k] - 0.5) / total[k])).otherwise(F.log10(kinds[k] / 2.0 / total[k]) + below)
        cost = here if cost is None else F.when(total[k].isNotNull(), here).otherwise(cost)
        if k < order:
            left, rest_ = total[k] - taken[k + 1], kinds[k] - kinds[k + 1]
            below = F.when(n[k].isNotNull(), F.log10((n[k] - 0.5) / left)).otherwise(F.when(rest_ > 0, F.log10(rest_ / 2.0 / left)).otherwise(F.lit(0.0)) + below)
    return priced.filter("cost is not null").union(wide.select("key", cost.alias("cost")))


def score_texts(docs, training, heavy=HEAVY, entries=None, cells=CELLS, tail=TAIL):
    """uid, doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    counts = settle(training.select("doc_id", "text").mapInArrow(bounded(_count), "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counts.filter("kind = 0").select("key", "n")
    total = counts.agg(F.sum(F.expr("if(kind <> 1, n, 0)")).alias("tokens"), F.count_if(F.col("kind") != 1).alias("distinct"), F.sum(F.expr("if(kind = 2, n, 0)")).alias("ends")).first()
    tokens, distinct, ends = int(total.tokens or 0), int(total.distinct or 0), int(total.ends or 0)
    least = max(1, -(-tokens // heavy))
    top = words.filter(F.col("n") >= least).toArrow()  # at most `heavy` rows
    keys, n = top.column(0).to_numpy(), top.column(1).to_numpy()
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], n[order]))
    tables, often, price = train(counts.filter("kind = 1").select("key", "n"), entries, cells=cells, tail=tail)
    model, often = spark.sparkContext.broadcast(tables), spark.sparkContext.broadcast(often)
    del tables
    schema = "uid bigint, doc_id bigint, n_tokens bigint, n_known bigint, logs double, score double, rare array<bigint>, grams array<struct<key:bigint,n:bigint>>"
    scored = settle(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(bounded(_score_batches(model, often, common)), schema), "scored")
    rare = scored.select("uid", F.explode("rare").alias("key")).join(words.filter(F.col("n") < least), "key")
    rare = rare.groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    out = scored.drop("rare", "grams").join(rare, "uid", "left")
    total = F.col("score")
    if price:
        open_ = scored.select("uid", F.explode("grams").alias("g")).select("uid", "g.key", "g.n")
        costs = settle(price(open_.select("key").distinct()), "costs")
        out = out.join(open_.join(costs, "key").groupBy("uid").agg(F.sum(F.col("n") * F.col("cost")).alias("open")), "uid", "left")
        total += F.coalesce("open", F.lit(0.0))
    end = float(np.log10(ends + 1))
    return out.select(
        "uid", "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + end - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))).alias("base_score"), total.alias("score"),
    )


def fold(modulus):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, docs.filter(fold(7) != 2))
    return out.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute(texts, order=ORDER):
    """score(text) of a model of texts, by the definition; for tests."""
    import re
    from collections import Counter, defaultdict

    def seq(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        return [*b" ".join(w), END]

    trie = defaultdict(Counter)
    for t in texts:
        s = [END] * order + seq(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                trie[tuple(s[i - k : i])][s[i]] += 1

    def logp(text):
        s, total = [END] * order + seq(text), 0.0
        for i in range(order, len(s)):
            out, p = set(), 1.0
            for k in range(order, -1, -1):
                c = trie.get(tuple(s[i - k : i]))
                if not c:
                    continue
                live = {x: n for x, n in c.items() if x not in out}
                t, d = sum(live.values()), len(live)
                if s[i] in live:
                    p *= (live[s[i]] - 0.5) / t
                    break
                if t:
                    p *= d / 2 / t
                out |= set(c)
            else:
                p *= 1 / (257 - len(out))
            total += np.log10(p)
        return total

    return logp
