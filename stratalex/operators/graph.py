"""Flow graphs: reachability by rounds of joins, topological order per flow."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import functions as F

from stratalex.operators.scratch import settle


def reach(edges, start, hops, direction="down"):
    """(node, hop): nodes within `hops` of the start node, at their least distance, the start left out.

    Each round joins the frontier with the edges; what was seen doesn't return,
    so cycles end. Edges and frontiers are written to the shared folder, so a
    round's plan holds one join however many rounds went before.
    """
    spark = edges.sparkSession
    src, dst = ("src", "dst") if direction == "down" else ("dst", "src")
    pairs = settle(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "edges")
    front = spark.createDataFrame([(start, 0)], f"node {dict(edges.dtypes)['src']}, hop int")
    seen = front
    for h in range(1, hops + 1):
        step = front.join(pairs, front.node == pairs.a).select(F.col("b").alias("node")).distinct()
        front = settle(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(h)), "frontier")
        seen = seen.unionByName(front)
        if h < hops and not front.limit(1).count():
            break
    return seen.filter("hop > 0")


def topological_order(steps, edges):
    """(flow, node, pos): first-in-first-out topological order of each flow; nodes of cycles follow in input order.

    steps: (flow, node, ord); edges: (flow, src, dst), and ord where the order
    of a node's calls counts (without it, that of their names). A flow is one
    function's steps, so its rows meet in one task.
    """
    place = F.col("e.ord") if "ord" in edges.columns else F.lit(0)
    calls = edges.alias("e").groupBy(F.col("e.flow").alias("f"), F.col("e.src").alias("s")).agg(F.array_sort(F.collect_list(F.struct(place.alias("ord"), F.col("e.dst").alias("dst")))).alias("c"))
    calls = calls.select("f", "s", F.transform("c", lambda x: x["dst"]).alias("calls"))
    own = steps.select("flow", "node", "ord").join(calls, (F.col("flow") == F.col("f")) & (F.col("node") == F.col("s")), "left").drop("f", "s")

    def order(pdf):
        pdf = pdf.sort_values(["ord", "node"])
        nodes = list(pdf["node"])
        calls = {n: [] if c is None else list(c) for n, c in zip(nodes, pdf["calls"])}
        waits = dict.fromkeys(nodes, 0)
        for n in nodes:
            for c in calls[n]:
                if c in waits:
                    waits[c] += 1
        queue, done = deque(n for n in nodes if not waits[n]), []
        while queue:
            n = queue.popleft()
            done.append(n)
            for c in calls[n]:
                if c in waits:
                    waits[c] -= 1
                    if not waits[c]:
                        queue.append(c)
        placed = set(done)
        done += [n for n in nodes if n not in placed]
        return pd.DataFrame({"flow": pdf["flow"].iloc[0], "node": done, "pos": range(1, len(done) + 1)})

    kind = dict(steps.dtypes)
    return own.groupBy("flow").applyInPandas(order, f"flow {kind['flow']}, node {kind['node']}, pos bigint")
