"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct k-word shingles. Two documents link when
|A & B| / |A | B| reaches the threshold t = num/den. Then
|A ^ B| <= (den - num) / (den + num) * (|A| + |B|), and sizes differ by at
most the factor t.

Each shingle toggles one bit of a sketch that is cut into parts, so the number
of unequal parts (and the Hamming distance) is at most |A ^ B|. Documents are
placed in size bands; in a band whose largest size is U, two linked documents
differ in at most D = floor((den - num) / (den + num) * 2U) shingles, and of
D + 1 + SPARE parts at least 1 + SPARE are equal (pigeonhole). Parts in which
few bits are set say little and many documents share them, so each document
leaves out its SPARE weakest parts in an order that depends on the parts'
contents alone: of the 1 + SPARE parts that two linked documents share, the
strongest is left out by neither. A part's key is the XOR of one random 64-bit
code for each of its set bits.

A document near the top of its band also joins the next band, in which its
larger partners are.

Documents of equal sets are one class, so copies cost nothing beyond their
row. Classes that share a key are candidates. No group's pairs are listed:
each task links the members of a key to the smallest one that it has seen and
passes on only that one, and the smallest ones of all tasks are linked in the
same way (a star of stars). Candidate links are verified on whole shingle
sets. Where members of a key remain in different components, further rounds
link the smallest member of each component; what is then still apart and was
never compared is compared pair by pair, in blocks, first by the Hamming
distance of whole sketches, which is at most |A ^ B|, and then by the sets, so
no link is lost.

Rows are told apart by a 64-bit hash of doc_id and text, so that ids that are
null or used twice lose no link. Joins on the class in the middle of a star, or
on the root of a large component, have plain exchanges on both sides, which
adaptive execution splits.

Defined cases: a text without words, or null, has an empty set, links with
nothing and is its own component; repeated rows of a doc_id are documents of
equal sets; a row without doc_id takes part in links as any other, and the
component_id is the smallest doc_id of those that have one (null if none has);
an empty table gives an empty result; further columns are carried by the
operator that keeps one document of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalex.llm.textkit import bounded, drop_scratch, mix, settle, shingle_sets, slices, small_batches, table, words

K = 4
NUM, DEN = 85, 100
RATIO = 1.2
#: Bits of a part (as a power of two): so many that shingles rarely share one.
WIDTH = 24
#: Keys that a task sorts at once; each such block sends on one row per key.
BLOCK = 300_000
#: Most bits of a document's sketch in the last round, and members of a key in one block there.
SKETCH, MEET = 4096, 4096
#: Keys of a class, from the smallest on, by which a pair is compared for the first of its shared keys only; with more, it may be compared again.
SMALLEST = 64
#: Positions of the bitmap of classes that have candidates (8 MB).
BITMAP = 2**26
#: Deals (groups of keys that meet in one place) for each partition of the input, and at least.
DEALS, LEAST_DEALS = 8, 1024
#: Rows of documents for each part of a small table (of classes, links or roots), and the least number of parts.
PART_ROWS, LEAST_PARTS = 20_000, 12
#: Members of keys in one row.
MEMBERS = 2048
#: Candidate pairs that a task holds before it sends them on.
PAIRS = 200_000


def bands(num, den, most=2**40):
    """Upper sizes of the bands; a document's partners are in its own band or the ones next to it."""
    out, u = [], 1
    while u < most:
        out.append(u)
        u = max(u + 1, int(u * RATIO), u * den // num)
    return np.array(out + [most], np.int64)


def spare(parts):
    return parts // 4 + 1


def keys_of(sets, offs, num=NUM, den=DEN):
    """Keys of the retained parts of each set: (keys, number of keys for each set)."""
    sizes = np.diff(offs)
    upper = bands(num, den)
    band = np.searchsorted(upper, sizes)  # the first with size <= upper
    out, owner = [], []
    for up in (0, 1):
        b = band + up
        at = np.flatnonzero((sizes > 0) & ((up == 0) | (sizes * den >= num * (upper[band] + 1))))
        if not len(at):
            continue
        d = ((den - num) * 2 * upper[b[at]]) // (den + num)
        extra = np.array([spare(int(x)) for x in d], np.int64)
        parts = d + 1 + extra
        n = sizes[at]
        base = np.concatenate([[0], np.cumsum(parts)])
        h = np.concatenate([sets[offs[i] : offs[i + 1]] for i in at])
        row = np.repeat(np.arange(len(at)), n)
        salt = np.repeat(b[at].astype(np.uint64), n)
        r = mix(h + salt * np.uint64(0x9E3779B97F4A7C15))
        part = ((r >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        bit = r & np.uint64(2**WIDTH - 1)
        code = mix(bit + np.uint64(1) + salt * np.uint64(1_000_003))
        cell = base[row] + part
        total = int(base[-1])
        order = np.argsort(cell, kind="stable")
        sorted_cell, sorted_code = cell[order], code[order]
        first = np.flatnonzero(np.r_[True, sorted_cell[1:] != sorted_cell[:-1]])
        value, weight = np.zeros(total, np.uint64), np.zeros(total, np.int64)
        value[sorted_cell[first]] = np.bitwise_xor.reduceat(sorted_code, first)
        # the weight of a part is the number of its set bits: of bits toggled an odd number of times
        flip = np.sort(sorted_cell.astype(np.uint64) << np.uint64(WIDTH) | bit[order])
        head = np.flatnonzero(np.r_[True, flip[1:] != flip[:-1]])
        odd = np.diff(np.r_[head, len(flip)]) & 1
        np.add.at(weight, (flip[head][odd == 1] >> np.uint64(WIDTH)).astype(np.int64), 1)
        cell_row = np.repeat(np.arange(len(at)), parts)
        cell_part = np.arange(total) - base[cell_row]
        key = mix(value + mix(cell_part.astype(np.uint64) * np.uint64(256) + b[at][cell_row].astype(np.uint64)))
        # weakest first, within each document
        rank = (cell_row.astype(np.uint64) << np.uint64(40)) | (np.minimum(weight, 255).astype(np.uint64) << np.uint64(32)) | (key >> np.uint64(32))
        order = np.argsort(rank)
        keep = order[(np.arange(total) - base[cell_row[order]]) >= extra[cell_row[order]]]
        out.append(key[keep])
        owner.append(at[cell_row[keep]])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(sizes), np.int64)
    keys, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.bincount(owner, minlength=len(sizes))


def class_ids(sets, offs):
    """One 64-bit value for each set; 0 for the empty one."""
    n = np.diff(offs)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(7)), dtype=np.uint64)])
    ids = mix(c[offs[1:]] - c[offs[:-1]] + mix(n.astype(np.uint64)))
    ids[n == 0] = 0
    return ids.view(np.int64)


def deal_bits(partitions):
    return max(LEAST_DEALS, DEALS * partitions).bit_length() - 1


def _stars(pairs):
    """Sorted distinct (key, class) pairs as (keys, smallest class of each, links (smallest, other))."""
    key, cls = pairs
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    first = np.r_[True, key[1:] != key[:-1]]
    low = cls[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = low != cls
    return key[first], cls[first], low[other], cls[other], key[other]


def _distinct(a, b):
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[new], b[new]


SHAPE = "kind int, deal int, doc_id bigint, rid bigint, n bigint, cls bigint, blob binary"


def _rows(kind, deal=None, doc_id=None, rid=None, n=None, cls=None, blob=None):
    size = next(len(x) for x in (deal, cls, blob) if x is not None)
    col = lambda x, t: pa.nulls(size, t) if x is None else x if isinstance(x, pa.Array) else pa.array(x, t)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), col(deal, pa.int32()), *(col(x, pa.int64()) for x in (doc_id, rid, n, cls)), col(blob, pa.binary())],
        names=["kind", "deal", "doc_id", "rid", "n", "cls", "blob"],
    )


def _pack(key, cls, bits):
    """Pairs dealt out by key: (deal, blob)."""
    if not len(key):
        return
    deal = (key >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(deal, kind="stable")
    both = np.empty((len(key), 2), np.uint64)
    both[:, 0], both[:, 1] = key[order], cls[order].view(np.uint64)
    cut = np.flatnonzero(np.r_[True, np.diff(deal[order]) != 0])
    ends = np.r_[cut[1:], len(key)]
    yield from ((int(deal[order[a]]), both[a:b].tobytes()) for a, b in zip(cut, ends))


def _unpack(blob):
    both = np.frombuffer(blob, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1].view(np.int64)


def _flush(pairs, bits):
    """What a block of pairs leaves: its links (kind 1), the members of shared keys (kind 2), one pair per key (kind 3)."""
    key, cls = _distinct(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
    keys, lows, low, other, at = _stars((key, cls))
    shared = np.isin(keys, at)
    got = list(_pack(keys, lows, bits))
    for i in range(0, len(got), 64):
        yield _rows(3, deal=np.array([x for x, _ in got[i : i + 64]], np.int32), blob=[x for _, x in got[i : i + 64]])
    # what needn't meet again is dealt evenly, whatever its key or class
    a, b = np.r_[at, keys[shared]], np.r_[other, lows[shared]]
    both = np.empty((len(a), 2), np.uint64)
    both[:, 0], both[:, 1] = a, b.view(np.uint64)
    cuts = np.arange(0, len(a), MEMBERS)
    for i in range(0, len(cuts), 64):
        part = cuts[i : i + 64]
        yield _rows(2, deal=_any_deal(mix(a[part] ^ b[part].view(np.uint64)).view(np.int64), bits), blob=[both[x : x + MEMBERS].tobytes() for x in part])
    a, b = _distinct(low, other)
    if len(a):
        yield _rows(1, deal=_any_deal(mix(a.view(np.uint64) ^ mix(b.view(np.uint64))).view(np.int64), bits), cls=a, n=b)


def _any_deal(x, bits):
    """Rows that may be anywhere are dealt evenly."""
    return (x.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)


def _sketch_batches(k, num, den, bits):
    def run(batches):
        held, count = [], 0
        for batch, data, offs in slices(batches):
            hashes, first = words(data, offs)
            sets, at = shingle_sets(hashes, first, k)
            cls = class_ids(sets, at)
            yield _rows(0, deal=_any_deal(mix(cls.view(np.uint64) + np.arange(len(cls), dtype=np.uint64)), bits), doc_id=batch.column(0), rid=batch.column(2), n=np.diff(at), cls=cls)
            new = np.unique(cls, return_index=True)[1]  # one of each class of the slice
            keep = np.zeros(len(cls), bool)
            keep[new] = True
            keys, n = keys_of(sets, at, num, den)
            owner = np.repeat(np.arange(len(cls)), n)
            ok = keep[owner]
            held.append((keys[ok], cls[owner[ok]]))
            count += int(ok.sum())
            if count >= BLOCK:
                yield from _flush(held, bits)
                held, count = [], 0
        if count:
            yield from _flush(held, bits)

    return bounded(run)


def _meet(batches):
    """Hands on rows of kinds 0 to 2; the pairs (kind 3) of a deal, which follow one another, meet: links of the smallest class of each key to the others, and the members of such keys."""
    at, got = None, []

    def met():
        pairs = [_unpack(x) for x in got]
        key, cls = _distinct(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        keys, lows, low, other, where = _stars((key, cls))
        a, b = _distinct(low, other)
        if len(a):
            yield _rows(1, cls=a, n=b)
        shared = np.isin(keys, where)
        for _, blob in _pack(np.r_[where, keys[shared]], np.r_[other, lows[shared]], 4):
            yield _rows(2, deal=np.array([at], np.int32), blob=[blob])

    for batch in batches:
        kind = batch.column(0).to_numpy()
        if (kind < 3).any():
            yield batch.filter(pa.array(kind < 3))
        batch = batch.filter(pa.array(kind == 3))
        for deal, blob in zip(batch.column(1).to_pylist(), batch.column(6)):
            if deal != at:
                if got:
                    yield from met()
                at, got = deal, []
            got.append(blob.as_py())
    if got:
        yield from met()


def _set_batches(k, bitmap):
    """(cls, rid, sorted shingle hashes of six bytes, sketch) of the rows that the bitmap marks."""

    def run(batches):
        marked = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            pos = batch.column(0).to_numpy() & (BITMAP - 1)
            batch = batch.filter(pa.array(marked[pos >> 3] >> (pos & 7) & 1 > 0))
            for part, data, offs in slices([batch]):
                hashes, first = words(data, offs)
                sets, at = shingle_sets(hashes, first, k)
                six = np.ascontiguousarray(sets.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
                blobs = [six[6 * x : 6 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                marks = [bit_sketch(sets[x:y]) for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(class_ids(sets, at)), part.column(0), pa.array(blobs, pa.binary()), pa.array(marks, pa.binary())], names=["cls", "rid", "hashes", "sketch"])

    return bounded(run)


def bit_sketch(own):
    """The parity sketch of a set, as bytes: at least two bits for each shingle, a power of two, at most SKETCH."""
    bits = min(SKETCH, max(64, 1 << int(2 * len(own)).bit_length()))
    out = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out.astype(np.uint8), bitorder="little").tobytes()


def _close(key, rows, num, den):
    """Pairs of different roots that their sketches don't rule out.

    rows: (cls, root, n, sketch, smallest keys) of one key and pair of blocks.
    A sketch is folded to half its length by XOR of its halves, as often as
    the shorter one of a pair asks for. A pair that shares a smaller key is left to that one.
    """
    rows.sort(key=lambda r: r[2])
    n = np.array([r[2] for r in rows])
    cls, root = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    sketches = [np.frombuffer(r[3], np.uint64) for r in rows]
    below = [r[4][r[4] < key] for r in rows]
    size = np.array([len(w) for w in sketches])
    layers = {}
    for k in sorted(set(size.tolist())):
        layers[k] = np.stack([np.bitwise_xor.reduce(w.reshape(-1, k)) if len(w) >= k else np.zeros(k, np.uint64) for w in sketches])
    for i in range(len(rows) - 1):
        to = int(np.searchsorted(n, n[i] * den // num, "right"))
        if to <= i + 1:
            continue
        k = int(size[i])
        other = np.arange(i + 1, to)
        other = other[(root[other] != root[i]) & (cls[other] != cls[i])]
        if len(other):
            apart = np.bitwise_count(layers[k][other] ^ layers[k][i]).sum(1)
            for j in other[(den + num) * apart.astype(np.int64) <= (den - num) * (n[i] + n[other])]:
                if not np.isin(below[i], below[j], kind="sort").any():
                    yield (min(cls[i], cls[j]), max(cls[i], cls[j]))


def _compare(num, den):
    def run(batches):
        last, rows, found = None, [], set()

        def send():
            out = pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
            found.clear()
            return out

        def compared():
            for pair in _close(last[0], rows, num, den):
                found.add(pair)
                if len(found) >= PAIRS:
                    yield send()

        for batch in batches:
            lists = batch.column(7)
            at, low = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, r in enumerate(zip(*(c.to_pylist() for c in batch.columns[:7]))):
                if r[:3] != last:
                    if last:
                        yield from compared()
                    last, rows = r[:3], []
                rows.append((*r[3:], low[at[i] : at[i + 1]]))
        if last:
            yield from compared()
        yield send()

    return bounded(run)


def _read_set(blob):
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view(np.uint64).ravel()


def _verify(num, den):
    def run(batches):
        last, own = None, None
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ok = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                n, m = len(x.as_buffer()) // 6, len(y.as_buffer()) // 6
                if den * min(n, m) < num * max(n, m):
                    continue
                if a[i] != last:
                    last, own = a[i], _read_set(x.as_py())
                both = np.concatenate([own, _read_set(y.as_py())])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok[i] = den * inter >= num * (n + m - inter)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ok)], names=["a", "b", "ok"])

    return bounded(run)


def bitmap_of(df, column):
    """A bitmap of fixed size of the low bits of a bigint column, put together by the executors."""
    at = F.col(column).bitwiseAND(F.lit(BITMAP - 1)) + 1
    parts = df.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = bytearray(BITMAP // 8)
    for r in parts.toLocalIterator():
        out[(r.b - 1) * 4096 : r.b * 4096] = bytes(r.bits)
    return bytes(out)


def small(df, name, parts):
    """settle() of a table of a few numbers a row, in no more parts than its documents call for: a part costs a task in each of many stages."""
    return settle(df.coalesce(parts), name)


def components(edges, name="components", parts=LEAST_PARTS):
    """(node, root) of undirected edges (a, b): the smallest node that each can reach.

    Each round every node takes the smallest root among its neighbours' and
    then its root's root; rounds end when nothing changes. Minima are
    pre-aggregated, and both sides of a join on roots are written first: a join
    of two plain exchanges is one that adaptive execution may split, so neither
    a node of many neighbours nor a large component is a hot spot.
    """
    both = small(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges", parts)
    root = small(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), name, parts)
    while True:
        at = root.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = both.join(at, "b").groupBy("a").agg(F.min("r").alias("m")).withColumnRenamed("a", "node")
        own = small(root.join(near, "node"), f"{name}-near", parts)  # every node has a neighbour
        # hook the root of each node onto the smallest root nearby, then jump
        hook = small(own.groupBy("root").agg(F.min("m").alias("h")), f"{name}-hook", parts)
        step = small(own.join(hook, "root").select("node", F.least("root", "h", "m").alias("to"), F.col("root").alias("was")), f"{name}-step", parts)
        far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
        new = small(step.join(far, "to", "left").select("node", F.least("to", "far").alias("root"), "was"), name, parts)
        for x in (root, own, hook, step):
            drop_scratch(x)
        moved = new.filter("root <> was").limit(1).count()
        root = new.drop("was")
        root.scratch = new.scratch
        if not moved:
            drop_scratch(both)
            return root


def _near(num, den):
    """Marks candidate links whose sizes and sketches allow the threshold."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = den * np.minimum(na, nb) >= num * np.maximum(na, nb)
            for i in np.flatnonzero(ok):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (4, 5))
                while len(x) != len(y):
                    x, y = (x, y) if len(x) > len(y) else (y, x)
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                ok[i] = (den + num) * int(np.bitwise_count(x ^ y).sum()) <= (den - num) * int(na[i] + nb[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok)], names=["a", "b", "near"])

    return bounded(run)


def _checked(edges, marks, sets, num, den):
    """(a, b, ok) of candidate links: by the sketches, then by the whole sets of one document of each class.

    The class in the middle of a star has many links: that side of a join is a
    plain exchange, which adaptive execution may split.
    """
    side = lambda df, x, *cols: df.select(F.col("cls").alias(x), *[F.col(c).alias(c[0] + x) for c in cols])
    to = edges.select("a", "b").join(side(marks, "b", "n", "sketch"), "b")
    to = to.join(side(marks, "a", "n", "sketch"), "a")
    near = settle(to.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(num, den), "a bigint, b bigint, near boolean"), "near")
    pairs = near.filter("near").select("a", "b")
    full = pairs.join(side(sets, "b", "hashes"), "b").join(side(sets, "a", "hashes"), "a")
    sure = full.select("a", "b", "ha", "hb").mapInArrow(_verify(num, den), "a bigint, b bigint, ok boolean")
    return sure.union(near.filter("not near"))


def linked(docs, k=K, num=NUM, den=DEN, rounds=2):
    """(rows: doc_id, rid, n, cls of each document, classes: cls, component_id, keep of each class that isn't empty).

    component_id is the smallest doc_id of the class's component, keep the rid
    of a row that has it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = with_rid(docs.select("doc_id", "text"))
    bits = deal_bits(docs.rdd.getNumPartitions())
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "rid")
    dealt = own.mapInArrow(_sketch_batches(k, num, den, bits), SHAPE).repartition("deal").sortWithinPartitions("deal")
    made = settle(dealt.mapInArrow(bounded(_meet), SHAPE), "sketches")
    rows = made.filter("kind = 0").select("doc_id", "rid", "n", "cls")
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    parts = max(LEAST_PARTS, rows.count() // PART_ROWS)
    classes = small(rows.filter("n > 0").groupBy("cls").agg(F.min(lead).alias("low"), F.max("n").alias("n")), "classes", parts)
    edges = small(made.filter("kind = 1").select(F.col("cls").alias("a"), F.col("n").alias("b")).distinct(), "candidates", parts)
    nodes = edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct()
    reps = small(classes.select("cls", "n", F.col("low.rid").alias("rid")).join(nodes, "cls", "left_semi"), "reps", parts)
    held = spark.sparkContext.broadcast(bitmap_of(reps, "rid"))
    texts = docs.select("rid", "text")
    sets = settle(texts.mapInArrow(_set_batches(k, held), "cls bigint, rid bigint, hashes binary, sketch binary").join(reps.select("cls", "rid"), ["cls", "rid"], "left_semi").dropDuplicates(["cls"]), "sets")
    held.unpersist()
    marks = small(reps.join(sets.select("cls", "sketch"), "cls"), "marks", parts)
    tested = settle(_checked(edges, marks, sets, num, den), "tested")
    root = components(tested.filter("ok"), parts=parts)
    if tested.filter("not ok").limit(1).count():
        members = _members(made, tested)
        for full in [False] * rounds + [True]:
            more = settle(_apart_all(members, root, tested, marks, num, den), "apart") if full else small(_apart_stars(members, root, tested), "apart", parts)
            if not more.limit(1).count():
                continue
            result = settle(_checked(more, marks, sets, num, den), "retested")
            tested = small(tested.union(result), "tested", parts)
            if result.filter("ok").limit(1).count():
                root = components(tested.filter("ok"), parts=parts)
    drop_scratch(sets)
    told = small(classes.select("cls", "low").join(root.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "low", F.coalesce("root", "cls").alias("root")), "rooted", parts)
    least = small(told.groupBy("root").agg(F.min("low").alias("least")), "least", parts)
    out = told.select("cls", "root").join(least, "root")
    return rows, small(out.select("cls", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keep")), "found", parts)


def with_rid(docs):
    """docs with rid, a hash of doc_id and text."""
    return docs.withColumn("rid", F.xxhash64(F.lit(9), F.col("doc_id").isNull(), "doc_id", "text"))


def link_components(docs, k=K, num=NUM, den=DEN, rounds=2):
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    rows, classes = linked(docs, k, num, den, rounds)
    full = rows.filter("n > 0").join(classes.select("cls", "component_id"), "cls")
    none = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n", "component_id").union(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _spread(batches):
    for batch in batches:
        for blob in batch.column(0):
            key, cls = _unpack(blob.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(cls)], names=["key", "cls"])


def _members(made, tested):
    """(key, cls) of the keys that several classes share, where a failed link's class occurs."""
    shared = made.filter("kind = 2").select("blob").mapInArrow(_spread, "key bigint, cls bigint")
    failed = tested.filter("not ok").select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    keys = settle(shared.join(failed, "cls", "left_semi").select("key").distinct(), "open-keys")
    return settle(shared.join(keys, "key", "left_semi").distinct(), "members")


def _rooted(members, root):
    return members.join(root.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))


def _apart_stars(members, root, tested):
    """Untested links from the smallest class of a key to the smallest of each other component in it."""
    lead = _rooted(members, root).groupBy("key", "root").agg(F.min("cls").alias("cls"))
    low = lead.groupBy("key").agg(F.min("cls").alias("a"))
    pairs = lead.join(low, "key").filter("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def _apart_all(members, root, tested, marks, num, den):
    """All untested pairs that share a key but no component and whose sketches differ in few enough bits.

    The members of a key meet in blocks of about MEET: a member goes to each
    pair of blocks that its own is part of, so no task holds more than two
    blocks however many members a key has.
    """
    at = _rooted(members, root)
    span = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    own = at.join(span.select("key", F.ceil(F.col("size") / MEET).cast("int").alias("blocks")), "key")
    low = members.join(span.select("key"), "key", "left_semi").groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("key")), 1, SMALLEST).alias("low"))
    own = own.join(marks.select("cls", "n", "sketch").join(low, "cls"), "cls").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = own.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "cls", "root", "n", "sketch", "low")
    pairs = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_compare(num, den), "a bigint, b bigint").distinct()
    return pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def keep_one(docs, **options):
    """docs with only the document of smallest doc_id of each component.

    Of a component's rows without doc_id one stays if no row has one. Repeated
    rows (same doc_id and text) leave one row, but rows without doc_id and
    words all stay; rows that share a doc_id but no component stay each.
    """
    rows, classes = linked(docs, **options)
    keep = classes.select(F.col("keep").alias("rid")).union(rows.filter("n = 0").select("rid")).distinct()
    own = with_rid(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text"))
    none = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = own.select("_row", "rid", none.alias("_none"))
    left = own.filter(~F.col("_none")).join(keep, "rid", "left_semi").dropDuplicates(["rid"])
    return left.select("_row").union(own.filter("_none").select("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op9_jaccard_join(spark, sf_dir):
    return link_components(table(spark, sf_dir, "documents"))


def brute(rows, k=K, num=NUM, den=DEN):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs; for tests."""
    import re

    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    to = {d: d for d in sets}

    def find(x):
        while to[x] != x:
            x = to[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    r, s = sorted((find(a), find(b)))
                    to[s] = r
    return {d: (len(sets[d]), find(d)) for d in ids}
