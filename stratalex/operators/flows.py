"""The flow layer: records to chunks, and lookups of flows, neighbours, branches and enforcement sites.

Chunks of the layer carry flow_spine or flow_step, structs of which one is
null, and enforced_at. `ord` is a record's place in its corpus; wherever the
first of several counts, it is the one of least ord.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.functions import exprs as X
from stratalex.operators import graph, ranges

LAYER = ("flow_spine", "flow_step")


def with_order(records):
    """records with ord, their place: files by name, then lines."""
    return records if "ord" in records.columns else records.withColumn("ord", F.monotonically_increasing_id())


def _kind(records):
    """flow, step, invariant, edge, or why a record is skipped."""
    text = lambda c: X.text(F.col(c))
    bad = F.col("_bad").isNotNull() if "_bad" in records.columns else F.lit(False)
    step = (text("id") == "") | (text("file") == "") | (F.coalesce("line", F.lit(0)) <= 0)
    return (
        F.when(bad, "malformed")
        .when(F.col("type") == "flow", F.when((text("id") == "") | (text("summary") == ""), "flow missing id/summary").otherwise("flow"))
        .when(F.col("type") == "step", F.when(step, "step missing id/file/line").otherwise("step"))
        .when(F.col("type") == "invariant", F.when((text("id") == "") | (text("statement") == ""), "invariant missing id/statement").otherwise("invariant"))
        .when(F.col("type") == "edge", "edge")
        .otherwise("unknown type")
    )


def record_counts(records):
    """(kind, n) of a corpus: flow, step, invariant, edge, and the reasons for which records are skipped."""
    return records.groupBy(_kind(records).alias("kind")).agg(F.count("*").alias("n"))


def flow_chunks(records, corpus):
    """Chunks of flow records; edges and skipped records give none. corpus: the corpus' own path."""
    own = with_order(records).withColumn("_kind", _kind(records)).filter(F.col("_kind").isin("flow", "step", "invariant"))
    text = lambda c: X.text(F.col(c))
    kind = F.col("_kind")
    whens = F.filter(F.transform(F.coalesce("branches", F.array().cast("array<struct<when:string,then:string,at:string>>")), lambda b: b["when"]), lambda w: X.text(w) != "")
    symbol = F.when(text("symbol") != "", F.concat(F.lit(" "), "symbol")).otherwise("")
    step = F.trim(F.concat(text("prose"), symbol, F.when(F.size(whens) > 0, F.concat(F.lit(" "), F.array_join(whens, " "))).otherwise("")))
    parts = F.filter(F.array("title", "statement", "assumes", "check"), lambda x: X.text(x) != "")
    body = F.when(kind == "flow", text("summary")).when(kind == "step", step).otherwise(F.array_join(parts, " "))
    own = own.withColumn("text", body).withColumn("content_sha256", X.content_hash(F.col("text")))
    spot = F.when(kind == "step", F.col("line")).otherwise(0)
    name = F.when(kind == "step", F.col("file")).otherwise(F.concat(kind, F.lit(":"), "id"))
    spine = F.when(kind == "flow", F.struct(F.col("id").alias("flow_id"), "entry_point", "trigger", "root_symbol", "links", "called_by"))
    told = F.struct(F.col("flow").alias("flow_id"), F.col("id").alias("step_id"), "symbol", "kind", "calls", "reads", "writes", "emits", "branches", "invariants")
    return own.select(
        X.chunk_id(name, spot, spot, F.col("content_sha256")).alias("chunk_id"), F.when(kind == "step", F.col("file")).otherwise(corpus).alias("file"),
        spot.alias("start_line"), spot.alias("end_line"), F.lit("flow").alias("language"),
        F.when(kind == "flow", F.col("root_symbol")).when(kind == "step", F.col("symbol")).otherwise(F.col("id")).alias("symbol_name"),
        F.when(kind == "flow", "flow_spine").when(kind == "step", "flow_step").otherwise("invariant").alias("chunk_kind"),
        "content_sha256", F.lit("domain").alias("category"), F.when(kind == "invariant", "curated").otherwise("").alias("provenance"),
        spine.alias("flow_spine"), F.when(kind == "step", told).alias("flow_step"), F.when(kind == "invariant", F.col("enforced_at")).alias("enforced_at"), "text", "ord",
    )


def align_steps(chunks, code):
    """chunks whose steps have the canonical_id of the narrowest code span that holds their line, where one does."""
    steps = chunks.filter("chunk_kind = 'flow_step'").select("chunk_id", F.col("chunk_id").alias("point_id"), "file", F.col("start_line").alias("line"))
    spans = code.select("file", "start_line", "end_line", F.col("canonical_id").alias("span_id"), F.col("start_line").alias("ord"))
    best = ranges.tightest(steps, spans).select(F.col("point_id").alias("chunk_id"), F.col("span_id").alias("_canon"))
    out = chunks.join(best, "chunk_id", "left")
    own = F.coalesce("_canon", F.col("canonical_id") if "canonical_id" in chunks.columns else F.lit(""))
    return out.withColumn("canonical_id", own).drop("_canon")


def layer(chunks):
    """Spines, steps and curated invariants."""
    curated = (F.col("chunk_kind") == "invariant") & (F.col("provenance") == "curated")
    return chunks.filter(F.col("chunk_kind").isin(*LAYER) | curated)


def without_layer(chunks):
    """chunks without the flow layer, and how many rows that takes away (one row: n)."""
    gone = layer(chunks)
    return chunks.join(gone.select("chunk_id"), "chunk_id", "left_anti"), gone.agg(F.count("*").alias("n"))


def spines(chunks):
    return chunks.filter("flow_spine is not null").select("flow_spine.*", "chunk_id", "ord")


def steps(chunks):
    return chunks.filter("flow_step is not null").select("flow_step.*", "file", "start_line", "end_line", "chunk_id", "ord")


def edges(chunks):
    """(flow, src, dst, ord): calls of steps, in the order in which each step names them."""
    s = steps(chunks).select(F.col("flow_id").alias("flow"), F.col("step_id").alias("src"), F.posexplode("calls").alias("ord", "dst"))
    return s.select("flow", "src", "dst", "ord")


class Miss(LookupError):
    """A flow that isn't there; the message names what is."""


def flow_of(chunks, flow_id="", entry_point="", invariant_id=""):
    """The id of the flow that a selector names: itself, the flow of an entry point, or the first enforcing flow of a curated invariant."""
    if flow_id:
        return flow_id
    if entry_point:
        row = spines(chunks).filter(F.col("entry_point") == entry_point).orderBy(F.desc("ord")).select("flow_id").first()
    elif invariant_id:
        row = invariant_enforcement(chunks, invariant_id).orderBy("place").select("flow").first()
    else:
        raise ValueError("one of flow_id, entry_point and invariant_id is needed")
    if row and row[0]:
        return row[0]
    known = spines(chunks).agg(F.array_sort(F.collect_set(F.when(F.col("entry_point") != "", F.col("entry_point")))).alias("e"), F.array_sort(F.collect_set("flow_id")).alias("f")).first()
    raise Miss(f"no flow for {entry_point or invariant_id}; entry points: {', '.join(known.e)}; flows: {', '.join(known.f)}; find_branches takes words")


def flow_steps(chunks, flow_id=None):
    """Steps with pos, their place in topological order, of one flow or of all."""
    own = steps(chunks) if flow_id is None else steps(chunks).filter(F.col("flow_id") == flow_id)
    calls = edges(chunks) if flow_id is None else edges(chunks).filter(F.col("flow") == flow_id)
    nodes = own.select(F.col("flow_id").alias("flow"), F.col("step_id").alias("node"), "ord")
    order = graph.topological_order(nodes, calls)
    return own.join(order.select(F.col("flow").alias("flow_id"), F.col("node").alias("step_id"), "pos"), ["flow_id", "step_id"])


def get_flow(chunks, flow_id="", entry_point="", invariant_id=""):
    """The steps of a flow in topological order, each with the spine's entry_point, trigger, root_symbol, links and called_by."""
    own = flow_of(chunks, flow_id, entry_point, invariant_id)
    spine = spines(chunks).filter(F.col("flow_id") == own).select("flow_id", *[F.col(c).alias(f"flow_{c}") for c in ("entry_point", "trigger", "root_symbol", "links", "called_by")])
    return flow_steps(chunks, own).join(F.broadcast(spine.limit(1)), "flow_id", "left").orderBy("pos")


def expand_flow(chunks, step_id, direction="down", hops=1):
    """(step_id, hop, relation, symbol, file, start_line, end_line) of the steps that a step reaches by calls, or is reached from."""
    if direction not in ("up", "down"):
        raise ValueError("direction is up or down")
    known = steps(chunks)
    if not known.filter(F.col("step_id") == step_id).limit(1).count():
        raise Miss(f"no step {step_id}")
    found = graph.reach(edges(chunks).select("src", "dst"), step_id, max(1, hops), direction).withColumnRenamed("node", "step_id")
    own = known.select("step_id", "symbol", "file", "start_line", "end_line").dropDuplicates(["step_id"])
    relation = "calls" if direction == "down" else "called_by"
    return found.join(own, "step_id").select("step_id", "hop", F.lit(relation).alias("relation"), "symbol", "file", "start_line", "end_line")


def branches_of(hits, chunks):
    """(rank, when, then, at, step_id, flow_id, symbol, file, start_line, end_line, score) of the steps among hits (chunk_id, rank, score)."""
    own = steps(chunks).join(hits.select("chunk_id", "rank", "score"), "chunk_id")
    each = own.select("rank", "score", "step_id", "flow_id", "symbol", "file", "start_line", "end_line", F.posexplode("branches").alias("place", "b"))
    return each.select("rank", "place", "b.when", "b.then", "b.at", "step_id", "flow_id", "symbol", "file", "start_line", "end_line", "score")


def invariant_enforcement(chunks, invariant_id=None):
    """(inv_id, statement, place, flow, step, loc): where curated invariants are enforced, one or all."""
    own = chunks.filter("chunk_kind = 'invariant' and provenance = 'curated'")
    if invariant_id is not None:
        own = own.filter(F.col("symbol_name") == invariant_id)
    return own.select(F.col("symbol_name").alias("inv_id"), F.col("text").alias("statement"), F.posexplode("enforced_at").alias("place", "e")).select("inv_id", "statement", "place", "e.*")
