"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z) and cut into words of digits, letters and all
characters above U+007F. Every `window` consecutive words of a benchmark item
form a pattern; an item of fewer words, but not none, is one pattern. Patterns
and documents become byte strings with one space between words. A block of up
to eight bytes at the scanning position indexes a shift table: a block that
ends in no pattern prefix lets the scan jump over all impossible positions. At
shift zero the hash of that suffix block and of the first block selects test
strings, which are compared byte by byte. Many scan positions advance at once,
each over its own piece of the text, so no step is taken per byte.

Defined cases: null or wordless documents have n_words = n_hit = 0 and no
items; null or wordless benchmark items match nothing; repeated document rows
each get their row; items that share an id count once; an empty benchmark
leaves every document clean; further columns of either table are ignored.

The benchmark is searched in blocks of at most `block_bytes` of patterns, in
one pass over the documents. A block's tables are built once, by the driver, and
broadcast; a task searches all texts of a batch for one block, lets go of it and
takes the next, so a Python worker holds one block at a time whatever the
benchmark's size, and time grows with the number of blocks. A benchmark of one
block is the same case: its tables stay loaded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalex.llm.textkit import LOWER, bounded, slices, small_batches, table

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
BITS = 18
#: Patterns of very different lengths are searched in classes, so that one short pattern doesn't shorten all jumps.
CLASSES = (1, 8, 24, 48)


def norm_words(text):
    """The words of one text, as bytes."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return np.where(WORD[raw], LOWER[raw], 32).astype(np.uint8).tobytes().split()


def windows(words, size):
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def patterns_of(items, size):
    """{pattern: sorted ids} of (item_id, text) rows."""
    found = {}
    for item, text in items:
        for w in windows(norm_words(text), size):
            found.setdefault(w, set()).add(str(item))
    return {w: sorted(ids) for w, ids in found.items()}


class Matcher:
    """Wu-Manber tables of one length class."""

    def __init__(self, patterns):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = min(8, self.m)
        self.mask = np.uint64(2 ** (8 * self.block) - 1)
        self.shift = np.full(2**BITS, self.m - self.block + 1, np.int64)
        keys, own = [], []
        for i, p in enumerate(patterns):
            head = np.frombuffer(p[: self.m] + bytes(8), np.uint8)
            blocks = self.blocks(head)[: self.m - self.block + 1] & self.mask
            slot = self.slot(blocks)
            np.minimum.at(self.shift, slot, self.m - self.block - np.arange(len(blocks)))
            keys.append(self.key(blocks[-1:], blocks[:1]))
            own.append(i)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.own = keys[order], np.array(own)[order]

    @staticmethod
    def blocks(data):
        """Eight bytes from each position on; data ends with eight spare bytes."""
        return np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))

    @staticmethod
    def slot(blocks):
        return ((blocks * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    @staticmethod
    def key(last, first):
        return last * np.uint64(0xBF58476D1CE4E5B9) ^ first * np.uint64(0x94D049BB133111EB)

    def scan(self, data, blocks, n):
        """(position, pattern number) of every occurrence in data[:n]."""
        m, b = self.m, self.block
        if n < m:
            return []
        ends = n - m + 1  # pattern starts at 0 .. ends-1
        lane = max(256, ends // 4096)
        pos = np.arange(0, ends, lane)
        stop = np.minimum(pos + lane, ends)
        zero = []
        while len(pos):
            step = self.shift[self.slot(blocks[pos + (m - b)] & self.mask)]
            hit = step == 0
            if hit.any():
                zero.append(pos[hit])
                step[hit] = 1
            pos = pos + step
            on = pos < stop
            if not on.all():
                pos, stop = pos[on], stop[on]
        if not zero:
            return []
        at = np.concatenate(zero)
        key = self.key(blocks[at + (m - b)] & self.mask, blocks[at] & self.mask)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        raw, found = data.tobytes(), []
        for i in np.flatnonzero(hi > lo):
            a = int(at[i])
            for j in self.own[lo[i] : hi[i]]:
                p = self.patterns[j]
                e = a + len(p)
                if raw.startswith(p, a) and raw[a - 1] in b" \0" and raw[e] in b" \0":
                    found.append((a, int(j)))
        return found


def build(found):
    """Matchers of {pattern: ids}, one for each class of lengths."""
    sets = {}
    for p in sorted(found):
        sets.setdefault(max(c for c in CLASSES if c <= len(p)), []).append(p)
    return [Matcher(ps) for _, ps in sorted(sets.items())]


def stream(data, offs):
    """Words with single spaces between, a zero byte before each document and at the end."""
    n, docs = len(data), len(offs) - 1
    wide = np.full(n + docs + 1, 32, np.uint8)
    edge = offs + np.arange(docs + 1)
    wide[np.arange(n) + np.repeat(np.arange(1, docs + 1), np.diff(offs))] = np.where(WORD[data], LOWER[data], 32)
    wide[edge] = 0
    keep = wide != 32
    keep[1:] |= wide[:-1] != 32
    return wide[keep]


def search(data, offs, found, matchers, before=None):
    """(words, where hits begin and end, first word, sets of item ids) of each document of a slice, on top of those of other blocks."""
    text = stream(data, offs)
    n = len(text)
    word = text > 32
    start = word.copy()
    start[1:] &= ~word[:-1]
    number = np.cumsum(start) - 1
    first = np.searchsorted(np.flatnonzero(start), np.flatnonzero(text == 0))
    docs = len(offs) - 1
    cover = np.zeros(int(first[-1]) + 1, np.int64) if before is None else before[1]
    items = [set() for _ in range(docs)] if before is None else before[3]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    wide = Matcher.blocks(padded)
    for matcher in matchers:
        for a, j in matcher.scan(padded, wide, n):
            p = matcher.patterns[j]
            w = number[a]
            cover[w] += 1
            cover[w + 1 + p.count(b" ")] -= 1
            items[int(np.searchsorted(first, w, "right")) - 1].update(found[p])
    return np.diff(first), cover, first, items


def counted(n, cover, first):
    """(words, hit words) of each document."""
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return n, np.diff(hit[first])


class Blocks:
    """Broadcast blocks of which a process has one loaded."""

    def __init__(self, held):
        self.held, self.at, self.loaded = held, None, None

    def __call__(self, k):
        if self.at != k:
            if self.at is not None:
                self.drop()
            self.at, self.loaded = k, self.held[k].value
        return self.loaded

    def drop(self):
        """Let go of the loaded block; its broadcast can be read again."""
        if self.at is not None and hasattr(self.held[self.at], "_value"):
            del self.held[self.at]._value
        self.at = self.loaded = None


def find_contamination(docs, benchmark, text="text", window=13, block_bytes=16_000_000, item_id="item_id", item_text="text", added=("n_words", "n_hit", "items", "contaminated")):
    """docs with n_words, n_hit, items (sorted ids of the items that occur) and contaminated added.

    Columns of docs that have the names in `added` are replaced.
    contaminated: n_hit > 0 and at least a twentieth of the words is hit.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # a window starts at each word, so the patterns of a text take about window times its bytes
    parts = max(1, -(-total * window // block_bytes))
    held = []
    for k in range(parts):
        rows = own.filter(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(parts)) == k)
        found = patterns_of(rows.toLocalIterator(), window)
        held.append(spark.sparkContext.broadcast((found, build(found))))
    names = docs.columns
    clash = [c for c in names if c in added]
    docs = docs.drop(*clash)

    def run(batches):
        blocks = Blocks(held)
        for whole in batches:
            parts = list(slices([whole], text))
            told = [None] * len(parts)
            for k in range(len(held)):
                block = blocks(k)
                for i, (_, data, offs) in enumerate(parts):
                    told[i] = search(data, offs, *block, told[i])
            for (batch, _, _), (n, cover, first, items) in zip(parts, told):
                n, hit = counted(n, cover, first)
                extra = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array((hit > 0) & (20 * hit >= n))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])
        if len(held) > 1:
            blocks.drop()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(bounded(run), f"{schema}, {', '.join(f'`{c}` {k}' for c, k in zip(added, ('bigint', 'bigint', 'array<string>', 'boolean')))}")


def remove_contaminated(docs, benchmark, **options):
    """The documents that are not contaminated, with their own columns."""
    own = ("_words", "_hit", "_items", "_contaminated")
    return find_contamination(docs, benchmark, added=own, **options).filter(~F.col("_contaminated")).drop(*own)


def brute(text, items, window=13):
    """What one document's row must say; for tests."""
    words = norm_words(text)
    hit, ids = [False] * len(words), set()
    for item, t in items:
        for w in windows(norm_words(t), window):
            w = w.split()
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit[i : i + len(w)] = [True] * len(w)
                    ids.add(str(item))
    return len(words), sum(hit), sorted(ids)


def items_digest(items):
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op8_benchmark_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
