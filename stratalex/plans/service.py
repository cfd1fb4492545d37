"""The tool surface: nineteen operations over an engine, each with one payload of JSON-like values and a schema version."""

from __future__ import annotations

from stratalex.functions import exprs as X
from stratalex.operators import filters, flows, rules, search
from stratalex.plans import engine as E

SCHEMA_VERSION = "1.1"
CITATION = ("file", "start_line", "end_line", "commit_hash")
SHOWN = ("chunk_id", "language", "is_test", "symbol_name", "symbol_kind", "chunk_kind", "canonical_id", "category")


def plain(value):
    """Rows, dates and arrays as JSON has them."""
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def hit(row, **more):
    """A hit as it is answered: without its text, with its citation."""
    told = row.asDict()
    out = {k: told.get(k) for k in SHOWN}
    return plain({**out, "citation": {k: told.get(k) for k in CITATION}, "guidance": told.get("guidance"), **more})


class Service:
    """Operations by name. `patterns`, if given, are (id, regex, action) that texts going in and out of embed and vector_search pass."""

    def __init__(self, spark, root, tree="", embedder=E.HASH, patterns=()):
        self.spark, self.root, self.tree, self.embedder, self.patterns = spark, root, tree, embedder, list(patterns)
        self._engine = None

    @property
    def engine(self):
        if self._engine is None:
            self._engine = E.Engine(self.spark, self.root, self.embedder)
        return self._engine

    def call(self, name, **arguments):
        """The payload of an operation; errors are answered, not raised."""
        if name not in OPERATIONS:
            return {"schema_version": SCHEMA_VERSION, "error": f"no operation {name}"}
        try:
            return {"schema_version": SCHEMA_VERSION, **getattr(self, OPERATIONS[name])(**arguments)}
        except (ValueError, LookupError, TypeError) as e:
            return {"schema_version": SCHEMA_VERSION, "error": str(e)}

    def _checked(self, text):
        """A text without what the patterns redact; None if one of them blocks it."""
        if not self.patterns:
            return text
        from pyspark.sql import functions as F

        r = self.spark.createDataFrame([(text,)], "x string").select(X.redact(F.col("x"), self.patterns).alias("r")).first().r
        return None if r.status == "blocked" else r.text

    @staticmethod
    def _filter(language="", commit_hash="", path_glob="", symbol_kinds=(), chunk_kinds=()):
        own = filters.Filter(language, commit_hash, path_glob, tuple(symbol_kinds), tuple(chunk_kinds))
        return None if own.is_zero() else own

    # search

    def semantic_search(self, intent, k=10, threshold=0.0, budget=0, rerank=True, density="full", aliases=None, **flt):
        o = E.Options(k=k, threshold=threshold, budget=budget, rerank=rerank, density=density, aliases=aliases or {}, flt=self._filter(**flt))
        rows = self.engine.search(intent, o).orderBy("rank").collect()  # k and some examples
        shown = [hit(r, snippet=r.snippet, density=r.density, normalized=r.normalized, vector_rank=r.vector_rank, stale=r.stale) for r in rows]
        return {
            "hits": [h for h in shown if not h["is_test"]], "examples": [h for h in shown if h["is_test"]],
            "tokens_used": rows[0].tokens_used if rows else 0, "intent_hash": _hash(intent), "warnings": [] if rows else ["all_results_below_threshold"],
        }

    def keyword_search(self, query, k=10, **flt):
        rows = self.engine.keyword_search(query, k, self._filter(**flt)).orderBy("rank").collect()
        return {"hits": [hit(r, bm25_score=r.score, normalized=r.normalized, rank=r.rank) for r in rows]}

    def vector_search(self, vector, k=10, **flt):
        rows = self.engine.vector_search(vector, k, self._filter(**flt)).collect()
        texts = [(r, self._checked(r.text)) for r in rows]
        return {"hits": [hit(r, text=t, normalized=r.normalized, vector_rank=r.vector_rank) for r, t in texts if t is not None]}

    def embed(self, texts):
        own = [self._checked(t) for t in texts]
        if None in own:
            raise ValueError("a text holds what a pattern blocks")
        return {"vectors": [list(r.embedding) for r in self.engine.embed(own).collect()], "identity": self.embedder.identity}

    def rerank(self, intent, ids):
        rows = search.rerank(self._ranked(ids), self.engine.tokens(intent)).orderBy("hybrid_rank").collect()
        return {"hits": [hit(r, bm25_score=r.score, hybrid_rank=r.hybrid_rank) for r in rows]}

    def _ranked(self, ids):
        from pyspark.sql import functions as F

        rows = self.spark.createDataFrame([(c, i + 1) for i, c in enumerate(dict.fromkeys(ids))], "chunk_id string, vector_rank int")
        return self.engine.chunks.join(F.broadcast(rows), "chunk_id")

    def narrow_candidates(self, ids, category="", **flt):
        return {"hits": [hit(r) for r in self.engine.narrow(ids, self._filter(**flt), category).collect()]}

    def explain_match(self, chunk_id, intent):
        return plain(self.engine.explain(chunk_id, intent).first())

    # lookups

    def related_changes(self, file):
        return {"file": file, "changes": plain(self.engine.related_changes(file).collect())}

    def find_invariants(self, file="", category="", tier_min=0):
        rows = self.engine.find_invariants(file, category, tier_min).collect()
        return {"invariants": [hit(r, text=r.text, marker=r.symbol_name, tier=r.tier) for r in rows]}

    def get_conventions(self, prefix=""):
        rows = self.engine.conventions(prefix).collect()
        return {"conventions": [{"package": r.symbol_name, "summary": r.text, "stats": plain(r.convention_stats)} for r in rows]}

    def expand_in_file(self, chunk_id, before=2, after=2):
        return {"hits": [hit(r, text=r.text) for r in self.engine.expand_in_file(chunk_id, before, after).collect()]}

    # flows

    def get_flow(self, flow_id="", entry_point="", invariant_id=""):
        rows = self.engine.get_flow(flow_id, entry_point, invariant_id).collect()
        if not rows:
            raise flows.Miss(f"flow {flow_id or entry_point or invariant_id} has no steps")
        return {"flow_id": rows[0].flow_id, "entry_point": rows[0].flow_entry_point, "trigger": rows[0].flow_trigger, "steps": plain(rows)}

    def expand_flow(self, step_id, direction="down", hops=1):
        return {"origin": step_id, "direction": direction, "neighbors": plain(self.engine.expand_flow(step_id, direction, hops).orderBy("hop", "step_id").collect())}

    def find_branches(self, symptom, k=10):
        return {"branches": plain(self.engine.find_branches(symptom, k).collect())}

    def get_invariant_enforcement(self, invariant_id):
        rows = self.engine.invariant_enforcement(invariant_id).collect()
        return {"inv_id": invariant_id, "statement": rows[0].statement if rows else "", "enforced_at": [{"flow": r.flow, "step": r.step, "loc": r.loc} for r in rows]}

    # operation

    def get_freshness(self):
        return filters.freshness("", "") if not self.tree else self.engine.freshness(self.tree)

    def health(self):
        row = self.engine.health().first()
        return {"ready": bool(row.ok), "identity": self.embedder.identity, "version": self.engine.told["version"], **plain(row)}

    def warmup(self):
        self.engine.keyword_search("warm", 1).collect()
        return {"ready": True}

    def index(self, mode="full", changes=(), **options):
        """Build anew, or take in changes [(op, path)]; the engine is opened again afterwards."""
        if mode == "full":
            told = E.build(self.spark, self.tree, self.root, self.embedder, **options)
        elif mode == "incremental":
            rows = self.spark.createDataFrame(list(changes), "op string, path string")
            told = E.reindex(self.spark, self.tree, self.root, rows, self.embedder, **options)
        else:
            raise ValueError("mode is full or incremental")
        self._engine = None
        return {"version": told["version"]}


def _hash(intent):
    import hashlib

    return hashlib.sha256(intent.encode()).hexdigest()[:12]


OPERATIONS = {
    **{f"context.{n}": n for n in (
        "semantic_search", "get_freshness", "related_changes", "keyword_search", "narrow_candidates", "explain_match", "find_invariants",
        "get_conventions", "expand_in_file", "get_flow", "expand_flow", "find_branches", "get_invariant_enforcement",
    )},
    **{f"ops.{n}": n for n in ("health", "warmup", "embed", "vector_search", "rerank", "index")},
}


def evaluate(service, fixture, k=5, files=None, **options):
    """(scores per query, one row in all) of a fixture (query_id, intent, file, from_line, to_line): each intent is searched; a failing query is a miss.

    files: a table (path, text); with it the snippets of all hits are verified.
    """
    from stratalex.operators import evaluate as V

    rows = []
    for q in fixture.toLocalIterator():  # a fixture has some dozens of queries
        got = service.call("context.semantic_search", intent=q.intent, k=k, **options)
        for example, name in ((False, "hits"), (True, "examples")):
            rows += [(q.query_id, i + 1, h["citation"]["file"], h["citation"]["start_line"], h["citation"]["end_line"], h["normalized"], example, h["snippet"]) for i, h in enumerate(got.get(name, []))]
    schema = "query_id string, rank int, file string, start_line int, end_line int, normalized double, is_example boolean, snippet string"
    hits = service.spark.createDataFrame(rows, schema)
    if files is not None:
        hits = filters.verify_snippets(hits, files)
    scores = V.score_queries(hits, fixture, k)
    return scores, V.summarize(scores)


def score_plan(rows):
    """Scores of plans (plan, truth_files, truth_symbols, commit_messages): files, symbols and steps; no truth, no score."""
    from pyspark.sql import functions as F

    from stratalex.operators import evaluate as V

    own = rows.withColumn("pred", X.expected_files(F.col("plan"))).withColumn("truth", F.col("truth_files"))
    out = V.set_f1(own).withColumnsRenamed({"precision": "file_precision", "recall": "file_recall", "f1": "file_f1"})
    steps = X.plan_steps(F.col("plan"))
    out = V.symbol_f1(out.withColumn("pred", X.plan_symbols(F.col("plan"))).withColumn("truth", F.col("truth_symbols")))
    out = out.withColumnsRenamed({"precision": "symbol_precision", "recall": "symbol_recall", "f1": "symbol_f1"})
    said = F.array_join("commit_messages", "\n\n")
    return out.withColumn("steps_score", V.token_f1(steps, said)).drop("pred", "truth")


__all__ = ["OPERATIONS", "Service", "evaluate", "plain", "rules", "score_plan"]
