"""Shared tools of the corpus operators: Arrow text as byte arrays, vectorised
word splitting and hashing, scratch tables in the shared folder.

All of it works on whole texts. A batch that Spark hands to Python is cut into
slices of about SLICE_BYTES so that the arrays over its bytes stay small; a
text that is longer than that forms a slice of its own.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of the batches that Python workers get and send.
BATCH_BYTES = 4_000_000


def table(spark, sf_dir, name):
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark):
    """Arrow batches by bytes, so that a worker's memory doesn't depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release():
    """Gives back what a task's arrays took: a Python worker outlives its tasks and idles beside those of other stages."""
    powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def bounded(run):
    """The function of a mapInArrow, with release() at each task's end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def shared_dir(spark):
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset and all tasks run on this machine, a folder of our own;
    on a cluster that is an error, since executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratalex-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def drop_path(spark, path):
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


def scratch_path(spark, name):
    path = f"{shared_dir(spark)}/stratalex-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def settle(df, name):
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(df):
    drop_path(df.sparkSession, df.scratch)


def text_bytes(col):
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches, text="text", limit=SLICE_BYTES):
    """Cut Arrow batches into (batch, bytes, offsets) of about `limit` bytes of text each."""
    for batch in batches:
        data, offs = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, len(offs) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def spans(inside, offs):
    """Runs of True that do not cross a document's edge: (starts, ends, first run of each document)."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        before[offs[:-1][offs[:-1] < n]] = False
        after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


def mix(h):
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64; pickled empty."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.p = self.q = np.zeros(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def __call__(self, n):
        if len(self.p) < n:
            base = 0x9E3779B97F4A7C15
            n = max(n, SLICE_BYTES + 1)
            for name, b in (("p", base), ("q", pow(base, -1, 2**64))):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.p, self.q


powers = _Powers()


def span_hashes(data, starts, ends, fold=True):
    """64-bit hashes of byte spans by prefix sums of a polynomial; `fold` lower-cases A-Z first."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        codes = codes[LOWER]
    p, q = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * p[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def words(data, offs):
    """Whitespace words `[^\\x20\\x09-\\x0D]+`: (hash of each, first word of each document)."""
    starts, ends, first = spans(~WHITE[data], offs)
    return span_hashes(data, starts, ends), first


def shingle_sets(hashes, first, k):
    """Distinct k-word shingles of each document, as 64-bit hashes.

    A document of fewer words, but not none, has its whole sequence as one
    shingle. Returns (hashes sorted within each document, offsets).
    """
    n = np.diff(first)
    docs = len(n)
    if not docs or not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    out, owner = [], []
    m = len(hashes) - k + 1
    mult = np.uint64(0xA24BAED4963EE407)
    if m > 0:
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = h * mult + hashes[j : j + m]
        doc = np.repeat(np.arange(docs), n)[:m]
        ok = np.arange(m) + k <= first[1:][doc]
        out.append(mix(h)[ok])
        owner.append(doc[ok])
    for d in np.flatnonzero((n > 0) & (n < k)):
        h = np.full(1, n[d], np.uint64)
        for x in hashes[first[d] : first[d + 1]]:
            h = h * mult + x
        out.append(mix(h))
        owner.append(np.array([d]))
    h, d = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, d)) if docs > 4096 else _by_doc(h, d)
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(docs + 1))


def _by_doc(h, d):
    order = np.argsort(h)
    return order[np.argsort(d[order].astype(np.int16), kind="stable")]
