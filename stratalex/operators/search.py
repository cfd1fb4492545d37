"""Retrieval: nearest neighbours, BM25, fusion, boosts, thresholds, density.

Rank functions without a partition run on the hits of a query only, at most a
few times k rows; corpora are reduced by TakeOrderedAndProject or by joins on
the query's terms before.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import exprs as X

OVERFETCH = 3
RRF_K = 60
K1, B = 1.5, 0.75


def knn(vectors, query, k, flt=None, mode="post", vec_id="vec_id", embedding="embedding"):
    """The k nearest rows: distance (L2), normalized, vector_rank.

    query: a list of floats. mode "post" fetches OVERFETCH * k rows and then
    filters, so it may give fewer than k; "pre" filters first.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    at = vectors if flt is None or mode == "post" else vectors.filter(flt)
    near = at.withColumn("distance", F.round(X.l2(F.col(embedding), q), 9)).orderBy("distance", vec_id)
    if flt is not None and mode == "post":
        near = near.limit(k * OVERFETCH).filter(flt).orderBy("distance", vec_id)
    top = near.limit(k)
    return top.withColumn("normalized", X.normalized_distance(F.col("distance"))).withColumn("vector_rank", F.row_number().over(Window.orderBy("distance", vec_id)))


def knn_batch(vectors, queries, k, block=256, vec_id="vec_id", embedding="embedding"):
    """(query_id, id, distance, vector_rank): the k nearest rows of each query, ties by id.

    Queries are taken in blocks; a block is broadcast, each task scores its rows
    against it by numpy and hands on its k nearest to each query, and these few
    are ranked. All rows are scored for all queries.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vec_id]

    def nearest(held):
        def run(batches):
            ids, q = held.value
            best = [(np.zeros(0), np.zeros(0, ids.dtype))] * len(ids)
            for b in batches:
                if not len(b):
                    continue
                own, key = np.stack(b[embedding].to_numpy()).astype(float), b[vec_id].to_numpy()
                for i in range(len(ids)):
                    d = np.round(np.sqrt(((own - q[i]) ** 2).sum(1)), 9)
                    dist, at = np.r_[best[i][0], d], np.r_[best[i][1], key]
                    first = np.lexsort((at, dist))[:k]
                    best[i] = (dist[first], at[first])
            for i, (dist, at) in enumerate(best):
                if len(at):
                    yield pd.DataFrame({"query_id": ids[i], vec_id: at, "distance": dist})

        return run

    def scored(rows):
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)))
        return vectors.select(vec_id, embedding).mapInPandas(nearest(held), f"query_id {kind}, `{vec_id}` {kind}, distance double")

    out, part = vectors.select(F.col(vec_id).alias("query_id"), vec_id, F.lit(0.0).alias("distance")).limit(0), []
    for r in queries.select(vec_id, embedding).toLocalIterator():
        part.append((r[0], list(r[1])))
        if len(part) == block:
            out, part = out.unionByName(scored(part)), []
    out = out.unionByName(scored(part)) if part else out
    best = Window.partitionBy("query_id").orderBy("distance", vec_id)
    return out.withColumn("vector_rank", F.row_number().over(best)).filter(F.col("vector_rank") <= k)


def query_vector(vectors, vec_id, key="vec_id", embedding="embedding"):
    return [float(x) for x in vectors.filter(F.col(key) == vec_id).select(embedding).first()[0]]


def bm25(docs, query_tokens, doc_id="doc_id", text="text"):
    """(doc_id, score) of the documents that hold a query token; a repeated token counts again."""
    return bm25_of_tokens(docs.select(doc_id, X.code_tokens(F.col(text)).alias("w")), query_tokens, doc_id)


def bm25_of_tokens(docs, query_tokens, doc_id="doc_id", tokens="w"):
    spark = docs.sparkSession
    asked = spark.createDataFrame([(t, query_tokens.count(t)) for t in sorted(set(query_tokens))], "term string, times int")
    held = docs.select(doc_id, F.size(tokens).alias("doc_len"), F.filter(tokens, lambda t: t.isin(*sorted(set(query_tokens)))).alias("own"))
    stats = held.agg(F.count("*").alias("n"), F.avg("doc_len").alias("mean_len"))
    tf = held.filter(F.size("own") > 0).select(doc_id, "doc_len", F.explode("own").alias("term")).groupBy(doc_id, "doc_len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    # both have at most one row for each query token
    terms = df.join(F.broadcast(asked), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("doc_len") / F.col("mean_len"))) * F.col("times")
    return tf.join(F.broadcast(terms), "term").groupBy(doc_id).agg(F.round(F.sum(part), 6).alias("score"))


def top(scored, k, doc_id="doc_id"):
    return scored.filter("score > 0").orderBy(F.desc("score"), doc_id).limit(k)


def rrf(hits, vector_rank="vector_rank", keyword_score="score", doc_id="doc_id", rrf_k=RRF_K):
    """Reciprocal-rank fusion of hits: those without a keyword score have a rank too, after all others."""
    by_score = Window.orderBy(F.desc(F.coalesce(F.col(keyword_score), F.lit(0.0))), vector_rank)
    out = hits.withColumn("keyword_rank", F.row_number().over(by_score))
    out = out.withColumn("fused", F.round(1.0 / (rrf_k + F.col(vector_rank)) + 1.0 / (rrf_k + F.col("keyword_rank")), 9))
    return out.withColumn("hybrid_rank", F.row_number().over(Window.orderBy(F.desc("fused"), vector_rank)))


def corpus_text(symbol="symbol_name", body="text"):
    """What a candidate is reranked by: its symbol and its first line that isn't blank."""
    lines = F.transform(X.lines(F.col(body)), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    first = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.array_join(F.filter(F.array(X.text(F.col(symbol)), first), lambda x: x != ""), " ")


def rerank(hits, query_tokens, id_="chunk_id", vector_rank="vector_rank", rrf_k=RRF_K):
    """hits (a query's candidates) with score, keyword_rank, fused and hybrid_rank.

    BM25 is taken over the candidates alone, each known by its symbol and its
    first line. Without query tokens the order stays.
    """
    if not query_tokens:
        out = hits.withColumn("score", F.lit(0.0)).withColumn("keyword_rank", F.col(vector_rank))
        return out.withColumn("fused", 2.0 / (rrf_k + F.col(vector_rank))).withColumn("hybrid_rank", F.col(vector_rank).cast("int"))
    words = hits.select(id_, X.code_tokens(corpus_text()).alias("w"))
    scores = bm25_of_tokens(words, query_tokens, id_)
    both = hits.join(scores, id_, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rrf(both, vector_rank, "score", id_, rrf_k)


def rerank_stats(after, vector_rank="vector_rank", score="normalized", id_="chunk_id"):
    """One row: candidates, rank_changes, top1_score_delta and the first twelve characters of the new first's id."""
    first = F.max(F.when(F.col("hybrid_rank") == 1, F.col(score))) - F.max(F.when(F.col(vector_rank) == 1, F.col(score)))
    name = F.substring(F.max(F.when(F.col("hybrid_rank") == 1, F.col(id_).cast("string"))), 1, 12)
    changes = F.count_if(F.col("hybrid_rank") != F.col(vector_rank))
    return after.agg(F.count("*").alias("candidates"), changes.alias("rank_changes"), first.alias("top1_score_delta"), name.alias("top1_id"))


def matched_tokens(query_tokens, own_tokens):
    """The distinct query tokens that own_tokens holds, in the query's order."""
    return F.filter(F.array_distinct(query_tokens), lambda t: F.array_contains(own_tokens, t))


def boost(hits, words, head="", package="", signature=1.5, doc=1.3, recent=1.1, package_factor=1.2):
    """Multiplies `normalized` by what the hit's signature, leading comments, commit and package earn, and ranks anew."""
    has = lambda c: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)) if words else F.lit(False)
    target = F.lower(F.concat_ws(" ", X.text(F.col("symbol_name")), F.trim(X.signature_only(F.col("text")))))
    trimmed = F.filter(F.transform(X.lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != "")
    stop = F.get(F.filter(F.transform(trimmed, lambda x, i: F.when(~x.rlike(r"^(//|/\*|\*|#)"), i)), lambda i: i.isNotNull()), F.lit(0))
    comments = F.lower(F.array_join(F.slice(trimmed, F.lit(1), F.coalesce(stop, F.size(trimmed))), " "))
    factor = F.when(has(target), signature).otherwise(1.0) * F.when(has(comments), doc).otherwise(1.0)
    factor = factor * (F.when((F.col("commit_hash") == head) & (F.col("commit_hash") != ""), recent).otherwise(1.0) if head else F.lit(1.0))
    factor = factor * (F.when(F.contains(F.lower(X.dirname(F.col("file"))), F.lit(package.lower())), package_factor).otherwise(1.0) if package else F.lit(1.0))
    out = hits.withColumn("boosted", F.round(F.col("normalized") * factor, 9))
    return out.withColumn("boost_rank", F.row_number().over(Window.orderBy(F.desc("boosted"), "vector_rank")))


def threshold(hits, t, score="normalized"):
    """0 means 0.4; a negative value keeps all."""
    return hits if t < 0 else hits.filter(F.col(score) >= (t or 0.4))


def split_tests(hits, k, examples_k, order, is_test="is_test"):
    """The first k hits that are no tests, and examples_k that are, with their rank in their group.

    Each side is a top-k of its own, so no task sees more than a few times k rows.
    """
    from functools import reduce

    def side(flag, n):
        top = hits.filter(F.col(is_test) == flag).orderBy(*order).limit(n)
        return top.withColumn("group_rank", F.row_number().over(Window.orderBy(*order)))

    return reduce(lambda a, b: a.unionByName(b), (side(False, k), side(True, examples_k)))


def density(hits, budget, rank="rank", text="text", query="query", ctx_lines=5, cap="full"):
    """snippet, density and tokens_used (of the query) of each hit so that a query's snippets fit the budget (bytes / 4, rounded up).

    cap: the most that any hit may show: "full", "signature_5" or "signature_only".

    The lowest ranks give way first: full text becomes signature with context,
    and only if every hit did so, signature alone. What a loop would decide row
    by row follows from the savings of the rows below, a running sum.
    """
    body = F.col("_body")
    start = {"full": X.text(F.col(text)), "signature_5": X.signature_with_context(F.col(text), ctx_lines), "signature_only": X.signature_only(F.col(text))}[cap]
    hits = hits.withColumn("_body", start)
    own = hits.withColumn("b0", F.octet_length(body)).withColumn("s1", X.signature_with_context(F.col(text), ctx_lines)).withColumn("s2", X.signature_only(F.col(text)))
    own = own.withColumn("b1", F.octet_length("s1")).withColumn("b2", F.octet_length("s2"))
    whole = Window.partitionBy(query)
    below = whole.orderBy(F.desc(rank)).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda total, save: F.ceil((total - F.coalesce(save, F.lit(0))) / 4) > budget
    if cap == "signature_only":
        own = own.withColumn("cut1", F.lit(False)).withColumn("all1", F.lit(False))
    elif cap == "signature_5":  # the first step is taken already
        own = own.withColumn("cut1", F.lit(False)).withColumn("all1", over(F.sum("b1").over(whole), F.lit(0)))
    else:
        own = own.withColumn("cut1", over(F.sum("b0").over(whole), F.sum(F.col("b0") - F.col("b1")).over(below)))
        own = own.withColumn("all1", F.min("cut1").over(whole) & over(F.sum("b1").over(whole), F.lit(0)))
    own = own.withColumn("cut2", F.col("all1") & over(F.sum("b1").over(whole), F.sum(F.col("b1") - F.col("b2")).over(below)))
    snippet = F.when(F.col("cut2"), F.col("s2")).when(F.col("cut1"), F.col("s1")).otherwise(body)
    name = F.when(F.col("cut2"), "signature_only").when(F.col("cut1"), "signature_5").otherwise(cap)
    own = own.withColumn("snippet", snippet).withColumn("density", name)
    own = own.withColumn("tokens_used", F.ceil(F.sum(F.octet_length("snippet")).over(whole) / 4))
    return own.drop("b0", "b1", "b2", "s1", "s2", "cut1", "all1", "cut2", "_body")
