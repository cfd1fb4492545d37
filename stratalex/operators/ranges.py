"""Interval joins: an equi join on the file carries the range predicate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

OVERLAP_LINES = 2
NEAREST_LINES = 5
#: Lines of one cell of a file; ranges meet where they share a cell, so a long file's ranges don't all meet.
CELL = 256


def _cells(start, end, pad=0):
    """The cells that a range touches, with `pad` lines on either side."""
    low, high = F.floor((start - pad) / CELL), F.floor((F.greatest(start, end) + pad) / CELL)
    return F.sequence(low, high)


def tightest(points, spans, key="file", line="line", id_="point_id"):
    """points with the id of the narrowest span that holds their line (ties: first in order), or null."""
    p = points.withColumn("_cell", F.floor(F.col(line) / CELL)).alias("p")
    s = spans.filter(F.col("start_line") <= F.col("end_line")).withColumn("_cell", F.explode(_cells(F.col("start_line"), F.col("end_line")))).alias("s")
    inside = (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p._cell") == F.col("s._cell"))
    both = p.join(s, inside & F.col(f"p.{line}").between(F.col("s.start_line"), F.col("s.end_line")), "left")
    best = F.min_by("s.span_id", F.struct(F.col("s.end_line") - F.col("s.start_line"), F.col("s.ord")))
    return both.groupBy(f"p.{id_}").agg(best.alias("span_id"))


def ladder(chunks, nodes):
    """chunk_id with the node it belongs to: same start, else holding its start, else overlapping, else near.

    Within a step the smallest range (or gap) wins, then the first in order.
    """
    c = chunks.withColumn("_cell", F.explode(_cells(F.col("start_line"), F.col("end_line"), NEAREST_LINES))).alias("c")
    n = nodes.withColumn("_cell", F.explode(_cells(F.col("start_line"), F.col("end_line")))).alias("n")
    both = c.join(n, (F.col("c.file") == F.col("n.file")) & (F.col("c._cell") == F.col("n._cell")))
    start, end = F.col("c.start_line"), F.greatest("c.start_line", "c.end_line")
    a, z = F.col("n.start_line"), F.col("n.end_line")
    overlap = F.least(end, z) - F.greatest(start, a) + 1
    gap = F.when(end < a, a - end).when(z < start, start - z)
    step = F.when(a == start, 1).when((a <= start) & (start <= z), 2).when(overlap >= OVERLAP_LINES, 3).when(gap <= NEAREST_LINES, 4)
    told = both.withColumn("step", step).filter("step is not null").withColumn("cost", F.when(F.col("step") == 4, gap).otherwise(z - a))
    best = F.min_by(F.struct("n.node_id", "step"), F.struct("step", "cost", "n.ord"))
    return told.groupBy("c.chunk_id").agg(best.alias("b")).select("chunk_id", "b.node_id", "b.step")


def _meeting(left, right, key, x, y):
    """Pairs of ranges of one file that share a cell, each pair once: where the later of the two begins."""
    a = left.withColumn("_cell", F.explode(_cells(F.col("start_line"), F.col("end_line")))).alias(x)
    b = right.withColumn("_cell", F.explode(_cells(F.col("start_line"), F.col("end_line")))).alias(y)
    later = F.floor(F.greatest(f"{x}.start_line", f"{y}.start_line") / CELL)
    return a, b, (F.col(f"{x}.{key}") == F.col(f"{y}.{key}")) & (F.col(f"{x}._cell") == F.col(f"{y}._cell")) & (F.col(f"{x}._cell") == later)


def contained(inner, outer, key="file"):
    """Pairs where inner's range lies within outer's."""
    a, b, on = _meeting(inner, outer, key, "i", "o")
    return a.join(b, on & (F.col("o.start_line") <= F.col("i.start_line")) & (F.col("i.end_line") <= F.col("o.end_line")))


def overlapping(left, right, key="file"):
    """Pairs that share a line."""
    a, b, on = _meeting(left, right, key, "l", "r")
    return a.join(b, on & (F.col("l.start_line") <= F.col("r.end_line")) & (F.col("r.start_line") <= F.col("l.end_line")))


def neighbours(rows, picked, before, after, key="file", order="start_line", id_="chunk_id"):
    """Rows of a picked row's file from `before` places ahead of it to `after` behind.

    Only the files that were picked from are put in order.
    """
    own = rows.join(picked.select(key).distinct(), key, "left_semi")
    n = own.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy(order, id_)))
    at = n.join(picked.select(id_), id_, "left_semi").select(F.col(key).alias("k"), F.col("ord").alias("at"), F.col(id_).alias("center"))
    return n.join(at, (n[key] == at.k) & n.ord.between(at.at - before, at.at + after)).drop("k")
