"""Aggregates over results, logs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F


def rank_metrics(ranks, rank="rank", at=(1, 3, 5)):
    """One row: recall at each cut-off and the mean reciprocal rank; a null rank is a miss."""
    cols = [F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in at]
    return ranks.agg(F.count("*").alias("queries"), F.count(rank).alias("found"), *cols, F.avg(F.coalesce(1.0 / F.col(rank), F.lit(0.0))).alias("mrr"))


def mean_std(rows, value, *keys):
    return rows.groupBy(*keys).agg(F.count("*").alias("runs"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def set_f1(rows, pred="pred", truth="truth"):
    """precision, recall and f1 of two array columns taken as sets; an empty truth gives zeros."""
    p, g = F.array_distinct(pred), F.array_distinct(truth)
    both = F.size(F.array_intersect(p, g))
    prec = F.when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(both / F.size(p))
    rec = F.when(F.size(g) == 0, 0.0).otherwise(both / F.size(g))
    out = rows.withColumn("precision", prec).withColumn("recall", rec)
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))


#: Ranges of values into which a key's values are cut before their order is looked at.
RANGES = 4096


def latency_profile(events, key="event_type", value="value"):
    """count, sum and index percentiles (p50: place (n - 1) div 2, p95: place min(n * 95 div 100, n - 1)) of each key.

    Places are found in two steps: values are counted in RANGES even ranges of
    each key, which tells the range that holds a place and how many values lie
    before it; only the values of those ranges are then put in order. So no
    task sorts all values of a large key.
    """
    from pyspark.sql import Window

    own = events.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    total = own.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("sum"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / RANGES
    at = own.join(F.broadcast(total.select(F.col("k").alias("kk"), "lo", "hi")), F.col("k").eqNullSafe(F.col("kk"))).drop("kk")  # a row for each kind of event
    at = at.withColumn("r", F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("v") - F.col("lo")) / width))).otherwise(0)).select("k", "v", "r")
    counts = at.groupBy("k", "r").agg(F.count("*").alias("c"))
    upto = counts.withColumn("before", F.sum("c").over(Window.partitionBy("k").orderBy("r")) - F.col("c"))  # RANGES rows a key
    places = total.select(F.col("k").alias("kk"), F.explode(F.array(
        F.struct(F.lit("p50").alias("name"), F.expr("(n - 1) div 2").alias("place")),
        F.struct(F.lit("p95").alias("name"), F.least(F.expr("n * 95 div 100"), F.col("n") - 1).alias("place")),
    )).alias("p")).select("kk", "p.*")
    held = upto.join(places, F.col("k").eqNullSafe(F.col("kk")) & (F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("c")))
    held = held.select("kk", F.col("r").alias("rr"), "name", (F.col("place") - F.col("before")).alias("place"))
    values = at.groupBy("k", "r", "v").agg(F.count("*").alias("c"))
    near = values.join(F.broadcast(held), F.col("k").eqNullSafe(F.col("kk")) & (F.col("r") == F.col("rr")))  # two ranges a key
    near = near.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "name").orderBy("v")))
    found = near.filter(F.col("upto") > F.col("place")).groupBy("k").agg(*[F.min(F.when(F.col("name") == p, F.col("v"))).alias(p) for p in ("p50", "p95")])
    both = total.alias("t").join(found.alias("f"), F.col("t.k").eqNullSafe(F.col("f.k")))
    return both.select(F.col("t.k").alias(key), F.col("n").alias("count"), "sum", "p50", "p95")


def footprint_profile(events):
    """latency_profile of a footprint log's finished spans (events named ....done)."""
    return latency_profile(events.filter(F.col("event").endswith(".done")), "event", "latency_ms")


def tree_hash(files, path="path", digest="digest", root="root"):
    """SHA-256 of each root's sorted `path NUL digest NEWLINE` lines.

    The lines of a root, about a hundred bytes a file, meet in one row: this is
    the hash of one checked-out tree.
    """
    line = F.concat(path, F.lit("\0"), digest, F.lit("\n"))
    own = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), line.alias("l"))))
    return files.groupBy(root).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["l"]), ""), 256).alias("tree_sha256"))


def roots_hash(hashes, column="tree_sha256"):
    """One row: the SHA-256 of several trees' sorted hashes, a line each."""
    return hashes.agg(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(column)), "\n"), F.lit("\n")), 256).alias("roots_sha256"))


# retrieval evaluation


def score_queries(hits, fixture, k):
    """One row per query of the fixture: its first correct hit within k and what came back.

    hits: (query_id, rank, file, start_line, end_line, normalized, is_example,
    verified, reason); a hit is correct if its file is the expected one and
    their lines overlap. Hits that are examples don't rank but can be unfounded.
    """
    flag = lambda c, v: F.coalesce(F.col(c), F.lit(v)) if c in hits.columns else F.lit(v)
    own = hits.withColumn("_example", flag("is_example", False)).withColumn("_verified", flag("verified", True))
    own = own.withColumn("_reason", flag("reason", ""))
    both = fixture.withColumnRenamed("file", "want").join(own, "query_id", "left")
    ranked = F.col("rank").isNotNull() & ~F.col("_example")
    right = ranked & (F.col("file") == F.col("want")) & (F.col("start_line") <= F.col("to_line")) & (F.col("from_line") <= F.col("end_line"))
    unfounded = F.col("rank").isNotNull() & ~F.col("_verified")
    order = F.struct(F.col("_example"), F.col("rank"))
    out = both.groupBy("query_id", "intent").agg(
        F.coalesce(F.min(F.when(right & (F.col("rank") <= k), F.col("rank"))), F.lit(0)).cast("int").alias("found_rank"),
        F.count_if(ranked).alias("hits_returned"), F.coalesce(F.max(F.when(ranked & (F.col("rank") == 1), F.col("file"))), F.lit("")).alias("top_hit_file"),
        F.coalesce(F.max(F.when(ranked & (F.col("rank") == 1), F.col("normalized"))), F.lit(0.0)).alias("top_hit_score"),
        F.count_if(unfounded).alias("hallucination_count"),
        F.coalesce(F.min_by("_reason", F.when(unfounded & (F.col("_reason") != ""), order)), F.lit("")).alias("hallucination_reason"),
    )
    out = out.withColumn("reciprocal_rank", F.when(F.col("found_rank") > 0, 1.0 / F.col("found_rank")).otherwise(0.0))
    return out.withColumn("citation_correct", F.col("found_rank") > 0)


def summarize(scores):
    """One row of the whole fixture: recall at 1, 3 and 5, mean reciprocal rank, citation accuracy, share of unfounded hits."""
    found = F.col("found_rank") > 0
    recall = [F.avg(F.when(found & (F.col("found_rank") <= n), 1.0).otherwise(0.0)).alias(f"recall_at_{n}") for n in (1, 3, 5)]
    out = scores.agg(
        F.count("*").alias("total"), F.count_if(found).alias("found"), *recall, F.avg("reciprocal_rank").alias("mrr"),
        F.count_if(found & F.col("citation_correct")).alias("cited"), F.sum("hits_returned").alias("total_hits"),
        F.sum("hallucination_count").alias("hallucination_hits"),
    )
    share = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    out = out.withColumn("citation_accuracy", share("cited", "found")).withColumn("hallucination_rate", share("hallucination_hits", "total_hits"))
    zero = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("recall_at_1", "recall_at_3", "recall_at_5", "mrr")]
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_hits", "hallucination_hits")]
    return out.select("total", "found", *zero, "citation_accuracy", "hallucination_rate", *counts)


def token_f1(a, b):
    """The F1 of two texts' sets of evaluation tokens; 0 where one has none."""
    from stratalex.functions import exprs as X

    x, y = F.array_distinct(X.eval_tokens(a)), F.array_distinct(X.eval_tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(x) + F.size(y)))


def symbol_f1(rows, pred="pred", truth="truth"):
    """set_f1 of symbols, which are compared by their normalised names; those without any are left out."""
    from stratalex.functions import exprs as X

    normal = lambda c: F.filter(F.transform(F.col(c), X.symbol_key), lambda s: s != "")
    return set_f1(rows.withColumn(pred, normal(pred)).withColumn(truth, normal(truth)), pred, truth)


def file_recall(hits, key, file="file", rank="rank", at=(5, 10)):
    """Per key, over its distinct files at their best rank: the share found within each cut-off, and 1 / the best rank of all."""
    best = hits.groupBy(key, file).agg(F.min(rank).alias("_rank"))
    cols = [F.avg(F.when(F.col("_rank") <= n, 1.0).otherwise(0.0)).alias(f"recall_at_{n}") for n in at]
    return best.groupBy(key).agg(*cols, (1.0 / F.min("_rank")).alias("mrr"))


def chunk_stats(chunks, keys=("chunk_kind",), truncated=None):
    """(keys, n, bytes, truncated) of chunks; truncated: those whose text ends with the mark of a cut, unless told otherwise."""
    from stratalex.functions import exprs as X

    cut = F.coalesce(F.col("text").endswith(X.TRUNCATED), F.lit(False)) if truncated is None else truncated
    return chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.octet_length(X.text(F.col("text")))).alias("bytes"), F.count_if(cut).alias("truncated"))


def rollup(rows, key, part, name="summary"):
    """(key, n, summary): parts and their counts as `a:2, b:1`, by count, then name."""
    counts = rows.groupBy(key, part).agg(F.count("*").alias("_n"))
    own = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("k"), F.col(part).alias("p"))))
    shown = F.array_join(F.transform(own, lambda x: F.concat(x["p"], F.lit(":"), (-x["k"]).cast("string"))), ", ")
    return counts.groupBy(key).agg(F.sum("_n").alias("n"), shown.alias(name))


def axis_poles(points, axes, labels="label", ends=3):
    """(axis, end, label): the commonest label among the `ends` least and greatest points of each axis (ties: by name)."""
    from functools import reduce

    def pole(axis, name, order):
        top = points.orderBy(order, labels).limit(ends).groupBy(labels).agg(F.count("*").alias("n"))
        best = top.agg(F.min_by(labels, F.struct(-F.col("n"), F.col(labels))).alias("label"))
        return best.select(F.lit(axis).alias("axis"), F.lit(name).alias("end"), "label")

    both = [pole(a, e, o) for a in axes for e, o in (("low", F.asc(a)), ("high", F.desc(a)))]
    return reduce(lambda x, y: x.unionByName(y), both)


def cluster_labels(points, folder, cluster="cluster"):
    """(cluster, label, size): the commonest first two parts of the paths in each cluster (ties: by name)."""
    two = F.array_join(F.slice(F.split(folder, "/"), 1, 2), "/")
    counts = points.groupBy(cluster, two.alias("_label")).agg(F.count("*").alias("_n"))
    return counts.groupBy(cluster).agg(F.min_by("_label", F.struct(-F.col("_n"), F.col("_label"))).alias("label"), F.sum("_n").alias("size"))


def dedup_first(rows, keys, order):
    """The first row of each key in the given order: one minimum per key, no sort."""
    names = [F.col(f"`{c}`") for c in rows.columns]
    rest = [c for c in rows.columns if c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[F.col(f"_r.`{c}`").alias(c) for c in rows.columns]) if names else rows


def pca(vectors, k, embedding="embedding"):
    """vec_id and the projections on the first k principal axes (signs are arbitrary)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = vectors.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    out = PCA(k=k, inputCol="features", outputCol="axes").fit(own).transform(own).withColumn("p", vector_to_array("axes"))
    return out.select("vec_id", *[F.col("p")[i].alias(f"pc{i + 1}") for i in range(k)])


def spherical_kmeans(vectors, k, seed=42, embedding="embedding"):
    """vec_id and cluster by cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = vectors.withColumn("features", array_to_vector(F.col(embedding).cast("array<double>")))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", predictionCol="cluster").fit(own)
    return model.transform(own).select("vec_id", "cluster")
