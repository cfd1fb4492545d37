"""Exact dedup by composable polynomial fingerprints.

The fingerprint of a byte string s is (sum of s[i] * B**(n-1-i)) mod P for two
bases B, P = 2**31 - 1. It composes: fp(a + b) = fp(a) * B**len(b) + fp(b), so
a text is cut into chunks whose hashes are computed side by side (one matrix
product over all chunks of a slice of documents) and combined by powers of B.
Rows of equal length and fingerprint then meet: the text of each is compared,
chunk by chunk, with that of the group's row of largest doc_id, and what
differs from it is grouped by SHA-256 instead, so a collision separates texts
but never joins them.

Only rows whose fingerprint may repeat move their text: a bitmap of fixed size,
aggregated by the executors, says which fingerprints those are. The comparison
is a join on the fingerprint whose large side adaptive execution may split, so
that one huge group of copies is compared by many tasks.

Defined cases: a null text is an empty one; rows of null doc_id sort below all
others; of repeated rows (same doc_id and text) exactly one is kept; an empty
table gives an empty result; further columns are carried by dedup_exact, and
columns of the table may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.llm.textkit import bounded, settle, slices, table

P = 2**31 - 1
BASES = (1_610_612_741, 805_306_457)
CHUNK = 1024
#: Bytes of one step of the comparison of two texts.
STEP = 65_536
#: Positions of the bitmap of fingerprints (8 MB), whatever the size of the table.
BITMAP = 2**26


def power(base, n):
    return pow(base, n, P)


def combine(left, right, right_length):
    """The fingerprint of a + b from those of a and b and the length of b."""
    return tuple((x * power(b, right_length) + y) % P for x, y, b in zip(left, right, BASES))


def fingerprint(data: bytes):
    """The fingerprint of one byte string, byte by byte; for tests."""
    out = []
    for b in BASES:
        h = 0
        for c in data:
            h = (h * b + c) % P
        out.append(h)
    return tuple(out)


def fingerprints(data, offs):
    """Fingerprints of many byte strings at once, as one signed 64-bit value each."""
    lens = np.diff(offs)
    docs = len(lens)
    n = -(-lens // CHUNK)
    if not n.sum():
        return np.zeros(docs, np.int64)
    last = np.cumsum(n)
    grid = np.zeros(int(last[-1]) * CHUNK)
    # texts are aligned to the end of their chunks; zeros in front don't change a hash
    grid[np.arange(len(data)) + np.repeat(last * CHUNK - offs[1:], lens)] = data
    weights = np.array([[power(b, CHUNK - 1 - i) for b in BASES] for i in range(CHUNK)], float)
    hashes = np.rint(grid.reshape(-1, CHUNK) @ weights).astype(np.int64) % P  # below 2**50: exact in doubles
    after = np.repeat(last, n) - 1 - np.arange(len(hashes))  # chunks that follow in the text
    shifts = np.ones((int(n.max()), 2), np.int64)
    step = [power(b, CHUNK) for b in BASES]
    for j in range(1, len(shifts)):
        shifts[j] = [int(x) * s % P for x, s in zip(shifts[j - 1], step)]
    parts = hashes * shifts[after] % P
    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(parts, axis=0)])
    fp = (sums[last] - sums[last - n]) % P
    return (fp[:, 0] << 31) | fp[:, 1]


SHA_SCHEMA = "doc_id bigint, n_bytes bigint, fp bigint, sha binary"


def _fingerprint_batches(bitmap=None):
    """Rows (doc_id, n_bytes, fp, sha); with a bitmap only those that it marks, and their text."""

    def run(batches):
        marked = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch, data, offs in slices(batches):
            ids = batch.column(0)
            fp = fingerprints(data, offs)
            raw = data.tobytes()
            if marked is None:
                sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offs)), pa.array(fp), pa.array(sha, pa.binary())], names=["doc_id", "n_bytes", "fp", "sha"])
                continue
            at = slot(fp, np.diff(offs))
            keep = np.flatnonzero(marked[at >> 3] >> (at & 7) & 1)
            if len(keep):
                own = [raw[offs[i] : offs[i + 1]] for i in keep]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(np.diff(offs)[keep]), pa.array(fp[keep]), pa.array([hashlib.sha256(x).digest() for x in own], pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "n_bytes", "fp", "sha", "raw"])

    return run


def slot(fp, n):
    return (fp ^ (fp >> 26) ^ (n * 40_503)) & (BITMAP - 1)


def _repeated(fps):
    """The bitmap of the positions that two rows or more share."""
    at = F.col("fp").bitwiseXOR(F.shiftright("fp", 26)).bitwiseXOR(F.col("n_bytes") * 40_503).bitwiseAND(F.lit(BITMAP - 1))
    twice = fps.groupBy(at.alias("at")).count().filter("count > 1")
    blocks = twice.groupBy(F.expr("bitmap_bucket_number(at)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    out = np.zeros(BITMAP + 32_768, np.uint8)
    for r in blocks.toLocalIterator():
        # bucket 1 holds positions 1 to 32768, bucket 0 only position 0
        first = (r.b - 1) * 32_768 + 1 if r.b else 0
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[first : first + 32_768] |= bits
    return np.packbits(out[:BITMAP], bitorder="little").tobytes()


def groups(docs):
    """One row per document: doc_id, n_bytes, fp, sha, clash, keep_id, group_size, kept.

    clash is null for texts that equal the one of the largest doc_id of their
    length and fingerprint, else their SHA-256.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fps = settle(docs.mapInArrow(bounded(_fingerprint_batches()), SHA_SCHEMA), "fp")
    key = ["n_bytes", "fp"]
    held = spark.sparkContext.broadcast(_repeated(fps))
    texts = settle(docs.mapInArrow(bounded(_fingerprint_batches(held)), SHA_SCHEMA + ", raw binary"), "texts")
    most = fps.groupBy(*key).agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id")).filter("n > 1").drop("n")
    # settled, so that the join with it has two plain exchanges, which adaptive execution may split
    lead = texts.join(most, on=[texts[k] == most[k] for k in key] + [texts.doc_id.eqNullSafe(most.doc_id)], how="left_semi").dropDuplicates(key).select(*key, F.col("raw").alias("lead"))
    lead = settle(lead, "lead")
    chunks = F.sequence(F.lit(0), (F.col("n_bytes") / STEP).cast("int"))
    same = F.forall(chunks, lambda i: F.substring(F.col("raw"), i * STEP + 1, F.lit(STEP)) == F.substring(F.col("lead"), i * STEP + 1, F.lit(STEP)))
    # settled too: an aggregation right above the join would keep its partitions whole
    odd = settle(texts.join(lead, on=key).filter(~same).select(*key, "sha"), "odd").distinct().withColumn("clash", F.col("sha"))
    told = fps.join(odd, on=[*key, "sha"], how="left")
    size = told.groupBy(*key, "clash").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    both = told.alias("t").join(size.alias("s"), on=[F.col(f"t.{k}") == F.col(f"s.{k}") for k in key] + [F.col("t.clash").eqNullSafe(F.col("s.clash"))])
    out = both.select("t.doc_id", "t.n_bytes", "t.fp", "t.sha", "t.clash", "s.keep_id", "s.group_size")
    first = F.row_number().over(Window.partitionBy("n_bytes", "fp", "sha", "doc_id").orderBy("group_size"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (first == 1))


def dedup_exact(docs):
    """docs without the rows that another row of equal text and larger doc_id replaces.

    Repeated rows of one doc_id and text leave one row.
    """
    keep = groups(docs).filter("kept").select(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha"))
    own = docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    out = own.join(keep, on=own.doc_id.cast("bigint").eqNullSafe(F.col("_id")) & (own._digest == keep._sha), how="left_semi")
    return out.dropDuplicates(["doc_id", "_digest"]).drop("_digest")


def op4_exact_dedup(spark, sf_dir):
    rows = groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
