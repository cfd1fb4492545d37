"""A persisted BM25 index: postings by buckets of terms, lengths of documents, frequencies of terms.

An index is written once, with a snapshot; a query reads the postings of its
terms only. Postings lie in BUCKETS directories by the hash of the term, sorted
by term in each file, so a query prunes all buckets but its terms' and, within
them, all row groups that can't hold a term. A posting carries its document's
length: scoring joins nothing but the terms' frequencies.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import exprs as X
from stratalex.operators import scratch

K1, B = 1.5, 0.75
BUCKETS = 64
#: Postings in one file of a bucket, about.
FILE_ROWS = 5_000_000


def bucket_of(term):
    return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")


class Index:
    """Tables under a path: postings (bucket, term, id, tf, doc_len), terms (term, df, cf, max_tf), stats (n, mean_len)."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")

    def ready(self):
        return scratch.exists(self.spark, f"{self.path}/stats/_SUCCESS")

    def table(self, name):
        return self.spark.read.parquet(f"{self.path}/{name}")

    def stats(self):
        return self.table("stats").first()

    def terms(self, tokens=None):
        own = self.table("terms")
        return own if tokens is None else own.filter(F.col("term").isin(sorted(set(tokens))))

    def postings(self, tokens):
        """Postings of the given terms: their buckets are listed in the plan, so others aren't opened."""
        import zlib

        own = sorted(set(tokens))
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in own})
        return self.table("postings").filter(F.col("bucket").isin(buckets) & F.col("term").isin(own))


def build(docs, path, id_="doc_id", tokens=None):
    """Write the index of docs (id, text, or a column of tokens) under path and return it.

    Terms are counted within each document before they are dealt out, as
    (document, term) pairs are distinct; the stats table, written last, marks
    the index as whole.
    """
    spark = docs.sparkSession
    words = X.code_tokens(F.col("text")) if tokens is None else tokens
    own = docs.select(F.col(id_).alias("id"), words.alias("w")).select("id", F.size("w").alias("doc_len"), "w")
    lengths = scratch.settle(own, "tokens")
    each = lengths.select("id", "doc_len", F.explode("w").alias("term")).groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf"))
    # frequent terms have many postings: a bucket's rows are dealt to several files by the document
    n = max(1, lengths.agg(F.sum("doc_len")).first()[0] or 1)
    files = max(1, n // BUCKETS // FILE_ROWS)
    out = each.withColumn("bucket", bucket_of(F.col("term"))).withColumn("file", F.pmod(F.xxhash64("id"), F.lit(files)))
    out = out.repartition("bucket", "file").sortWithinPartitions("bucket", "term").drop("file")
    out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = Index(spark, path)
    told = index.table("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))
    told.sort("term").write.mode("overwrite").parquet(f"{path}/terms")
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("mean_len"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return index


def index_of(docs, source, id_="doc_id", name="bm25"):
    """The index of a table's files in the shared folder, built where it isn't there for their present state."""
    spark = docs.sparkSession
    path = f"{scratch.shared_dir(spark)}/stratalex-{name}-{scratch.fingerprint(spark, source)}"
    index = Index(spark, path)
    return index if index.ready() else build(docs, path, id_)


def scored(index, query_tokens, k1=K1, b=B):
    """(id, score) of the documents that hold a query token; a repeated token counts again."""
    asked = sorted(set(query_tokens))
    if not asked:
        return index.table("postings").select("id", F.lit(0.0).alias("score")).limit(0)
    s = index.stats()
    held = {r.term: r.df for r in index.terms(asked).toLocalIterator()}  # at most one row for each query token
    weight = F.lit(0.0)
    for t in asked:
        if t in held:
            idf = F.log(F.lit(1 + (s.n - held[t] + 0.5) / (held[t] + 0.5)))
            weight = F.when(F.col("term") == t, idf * query_tokens.count(t)).otherwise(weight)
    tf = F.col("tf")
    part = weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.lit(float(s.mean_len or 1.0))))
    return index.postings(asked).groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))


def top(index, query_tokens, k):
    """The k best documents of positive score, ties by id."""
    return scored(index, query_tokens).filter("score > 0").orderBy(F.desc("score"), "id").limit(k)


def keyword_search(index, chunks, query_tokens, k, flt=None, id_="chunk_id", overfetch=3):
    """chunk columns, score, normalized and rank of the k best chunks; with a filter, of overfetch * k candidates those that pass."""
    best = top(index, query_tokens, k * (overfetch if flt is not None else 1)).withColumnRenamed("id", id_)
    hits = chunks.join(F.broadcast(best), id_)  # overfetch * k rows
    hits = (hits if flt is None else hits.filter(flt)).orderBy(F.desc("score"), id_).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), id_))  # k rows
    return hits.withColumn("normalized", X.normalized_bm25(F.col("score"))).withColumn("rank", rank)
