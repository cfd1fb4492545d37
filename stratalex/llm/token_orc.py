"""Token ids as ORC files: integer run lengths, row indexes, Bloom filters.

Documents are encoded, each with an end id after its own, and written as rows
(doc_id, ids) in ascending doc_id order: a range partitioning on doc_id gives
each file its own range and rows are sorted within it. ORC stores the ids of a
stripe as one integer run-length stream; stripes of bounded size are the units
of parallel reads, row-index strides carry the least and largest doc_id and,
with a Bloom filter on doc_id, let a lookup skip stripes and strides.

Encoding: byte-level BPE pieces never cross the place before a single space
between two other characters, so a text is cut there and each distinct piece,
known by a 64-bit hash, is encoded once in a task's while, by the tokenizers
library; a task holds at most HELD_BYTES of known pieces, and nothing after its
end. Texts in which white space doesn't stand alone, or that hold a special
token's string, are encoded whole.

Files have a third column, tie: a hash of the text that orders rows of equal
doc_id, within files and across their edges.

Defined cases: a null text is empty (its ids are the end id alone); rows of
equal doc_id are ordered by tie, and those of equal tie have equal ids; a null
doc_id sorts first; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.llm.textkit import WHITE, bounded, scratch_path, settle, slices, small_batches, span_hashes, spans, table

END_ID = 2
STRIPE_BYTES = 16 * 2**20
STRIDE_ROWS = 1000
#: Bytes of pieces, with their ids, that a task knows at once.
HELD_BYTES = 40 * 2**20
#: Bytes of text in one file, about: a task of many texts meets most of their pieces again. Small inputs have a file for each core.
TASK_BYTES, LEAST_BYTES = 48 * 2**20, 8 * 2**20


#: What a byte is, in two flags that the byte before is compared with and one of its own: see Encoder.odd.
SPACE, BLANK, RARE = 1, 2, 16
PAIRS = 4 | 8
KIND = np.zeros(256, np.uint8)
KIND[WHITE] |= BLANK | 4  # white space: a space must not follow
KIND[32] |= SPACE | 8  # a space: no white space may follow
KIND[[11, 28, 29, 30, 31, 194, 225, 226, 227]] |= RARE


def vocabulary(name="byte_bpe_50k.json"):
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by way of their distinct pieces, which are known by 64-bit hashes."""

    def __init__(self, source, held=HELD_BYTES):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        told = json.loads(source)
        pre = told.get("pre_tokenizer") or {}
        self.by_pieces = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        # the characters of a byte-level token stand for one byte each
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token)
        self.held = held
        self.clear()

    def clear(self):
        """Forget all pieces: keys sorted, where each one's ids are in the pool, and how many; new ones first join a short table."""
        none = np.zeros(0, np.int64)
        self.old, self.young = ([none.astype(np.uint64), none, none.astype(np.int32)] for _ in range(2))
        self.pool = none.astype(np.int32)

    def whole(self, texts):
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def odd(self, texts, data, offs):
        """Which texts are encoded whole: white space next to white space or at an end, rarer white space, special strings."""
        n = len(data)
        if not self.by_pieces or not n:
            return np.ones(len(texts), bool)
        kind = KIND[data]
        after = np.full(n, SPACE | BLANK, np.uint8)
        after[:-1] = kind[1:]
        full = offs[1:] > offs[:-1]
        starts, ends = offs[:-1][full], offs[1:][full] - 1
        after[ends] = SPACE | BLANK  # a text's end counts as white space
        # a space before white space, white space before a space, the bytes that may begin rarer white space
        bad = (after << 2) & kind & PAIRS | (kind & RARE)
        bad[starts] |= kind[starts] & SPACE
        at = np.flatnonzero(bad)
        at = at[(data[at] != 194) | np.isin(data[np.minimum(at + 1, n - 1)], (133, 160))]
        out = np.zeros(len(texts), bool)
        out[np.searchsorted(offs, at, "right") - 1] = True
        for s in self.special:
            out |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return out

    def __call__(self, texts, data, offs, end_id):
        """(ids of all texts after one another, each with the end id; where each text's begin)."""
        odd = self.odd(texts, data, offs)
        docs = len(texts)
        starts, ends, first = spans(data != 32, offs)
        doc = np.repeat(np.arange(docs), np.diff(first))
        keep = ~odd[doc]
        head = np.zeros(len(starts), bool)
        head[first[:-1][np.diff(first) > 0]] = True
        h = span_hashes(data, starts, ends, fold=False) ^ np.where(head, np.uint64(0x5851F42D4C957F2D), np.uint64(0))
        starts, ends, doc, head, h = (x[keep] for x in (starts, ends, doc, head, h))
        keys, where, back = np.unique(h, return_index=True, return_inverse=True)
        at, size = self.pieces(keys, data, starts[where], ends[where], head[where])
        at, size = at[back], size[back]
        whole = dict(zip(np.flatnonzero(odd).tolist(), self.whole(texts.filter(pa.array(odd)).to_pylist()))) if odd.any() else {}
        lens = np.bincount(doc, size, docs).astype(np.int64) if len(doc) else np.zeros(docs, np.int64)
        for i, x in whole.items():
            lens[i] = len(x)
        begin = np.concatenate([[0], np.cumsum(lens + 1)])
        out = np.full(int(begin[-1]), end_id, np.int32)
        if len(doc):
            before = np.cumsum(size) - size
            low = np.searchsorted(doc, np.arange(docs))
            to = begin[:-1][doc] + before - before[np.minimum(low, len(doc) - 1)][doc]
            step = np.arange(int(size.sum())) - np.repeat(before, size)
            out[np.repeat(to, size) + step] = self.pool[np.repeat(at, size) + step]
        for i, x in whole.items():
            out[begin[i] : begin[i] + len(x)] = x
        return out, begin

    def pieces(self, keys, data, starts, ends, head):
        """Where the ids of sorted distinct pieces are in the pool, and how many."""
        if self.pool.nbytes + sum(x.nbytes for t in (self.old, self.young) for x in t) > self.held:
            self.clear()
        at, count_ = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        new = np.ones(len(keys), bool)
        for known, place, n in (self.old, self.young):
            if len(known):
                pos = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = np.flatnonzero(known[pos] == keys)
                at[hit], count_[hit] = place[pos[hit]], n[pos[hit]]
                new[hit] = False
        if new.any():
            n = np.flatnonzero(new)
            # pieces that follow a space and end with something else than white space may stand after one another in one text
            alone = head[n] | WHITE[data[ends[n] - 1]]
            chain, apart = n[~alone], n[alone]
            pool, count = [], []
            raw = data.tobytes()
            if len(chain):
                text, sizes = [], ends[chain] - starts[chain] + 1
                spots = np.cumsum(sizes)
                joined = np.full(int(spots[-1]), 32, np.uint8)
                inner = np.arange(int(spots[-1])) - np.repeat(spots - sizes, sizes)
                body = inner > 0
                joined[body] = data[(np.repeat(starts[chain], sizes) + inner - 1)[body]]
                joined = joined.tobytes()
                cuts = [0, *spots[255::256].tolist()]
                if cuts[-1] != len(joined):
                    cuts.append(len(joined))
                text = [joined[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])]
                ids = np.concatenate(self.whole(text))
                done = np.cumsum(self.bytes[ids])
                last = np.searchsorted(done, spots)
                if not np.array_equal(done[last], spots):
                    raise ValueError("an id crosses a piece's edge")
                pool.append(ids)
                count.append(np.diff(np.r_[-1, last]))
            if len(apart):
                text = [("" if head[i] else " ") + raw[starts[i] : ends[i]].decode() for i in apart.tolist()]
                got = self.whole(text)
                pool += got
                count.append(np.array([len(x) for x in got], np.int64))
            size = np.concatenate(count)
            which = np.r_[chain, apart]
            place = len(self.pool) + np.cumsum(size) - size
            at[which], count_[which] = place, size
            self.pool = np.concatenate([self.pool, *pool])
            self.young = _joined(self.young, (keys[which], place, size.astype(np.int32)))
            if len(self.young[0]) > max(50_000, len(self.old[0]) // 4):
                self.old, self.young = _joined(self.old, self.young), [x[:0] for x in self.young]
        return at, count_


def _joined(a, b):
    """Two tables of pieces as one, by their keys."""
    both = [np.concatenate(x) for x in zip(a, b)]
    order = np.argsort(both[0], kind="stable")
    return [x[order] for x in both]


def _encode_batches(source, end_id):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(source.value)
        for batch, data, offs in slices(batches, limit=750_000):
            flat, begin = encode(batch.column(1).fill_null(""), data, offs, end_id)
            col = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), col], names=["doc_id", "tie", "ids"])

    return bounded(run)


def encode(docs, tokenizer=None, end_id=END_ID):
    """(doc_id, tie, ids) of docs, ids ending with end_id; tokenizer: the path of a tokenizers file."""
    small_batches(docs.sparkSession)
    with open(tokenizer or vocabulary(), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", tie())
    return own.mapInArrow(_encode_batches(source, end_id), "doc_id bigint, tie bigint, ids array<int>")


def tie():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")


def text_bytes_of(docs):
    """About how many bytes the texts of docs take: the planner's figure, or a sum where it has none."""
    told = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return told if told < 2**52 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write_ids(docs, path, tokenizer=None, end_id=END_ID):
    """Write docs as ORC files of token ids under `path`, in ascending doc_id order over the files.

    The texts are dealt to their ranges before they are encoded: they are
    smaller then, and no range has to wait for a task that encodes another.
    """
    total = text_bytes_of(docs)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(1, -(-total // TASK_BYTES), min(cores, -(-total // LEAST_BYTES)))
    ranged = docs.select("doc_id", "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), tie())
    rows = encode(ranged, tokenizer, end_id).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    options = {
        "orc.compress": "ZSTD", "orc.stripe.size": STRIPE_BYTES, "orc.create.index": "true", "orc.row.index.stride": STRIDE_ROWS,
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }
    writer = rows.write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.orc(path)


def read_ids(spark, path, doc_ids=None):
    """(doc_id, tie, ids) of files of write_ids; doc_ids: only those, by row index and Bloom filter."""
    rows = spark.read.schema("doc_id bigint, tie bigint, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def _digest_batches(batches):
    for batch in batches:
        lists = batch.column(3)
        offs = lists.offsets.to_numpy()
        raw = np.ascontiguousarray(lists.values.to_numpy().astype("<u4", copy=False)).tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        told = [*batch.columns[:3], pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(told, names=["file", "doc_id", "tie", "n_tokens", "ids_crc32"])


def layout(spark, path):
    """Per document, from the files: doc_id, start (ids of all before it), n_tokens, ids_crc32.

    Files hold ascending ranges: their sums, one row a file, give where each
    begins, and running sums within each file do the rest.
    """
    rows = read_ids(spark, path).select(F.input_file_name().alias("file"), "doc_id", "tie", "ids")
    told = settle(rows.mapInArrow(bounded(_digest_batches), "file string, doc_id bigint, tie bigint, n_tokens bigint, ids_crc32 bigint"), "layout")
    files = told.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # part numbers follow the ranges; they outgrow their five digits
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("bigint")
    order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    begin = files.select("file", "n", number.alias("number")).select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    at = told.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return at.join(begin, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def save_and_read(docs, path=None, **options):
    """Write docs and return what their files say."""
    path = path or scratch_path(docs.sparkSession, "ids")
    write_ids(docs, path, **options)
    return layout(docs.sparkSession, path)


def op6_token_id_output(spark, sf_dir):
    return save_and_read(table(spark, sf_dir, "documents"))
