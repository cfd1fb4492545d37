"""Filters, rules, flows, glossary, evaluation and upkeep on small inputs."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stratalex.functions import exprs as X
from stratalex.operators import evaluate, filters, flows, postings, rules, search, store
from stratalex.plans import engine, service, upkeep
from stratalex.sources import files, glossary, golang
from stratalex.streaming import events

GO = '''package p

import (
	"fmt"
	"golang.org/x/sync/errgroup"
)

// CRITICAL: the lock is held
// a second line
func NewStore(n int) (*Store, error) {
	if n < 0 {
		return nil, fmt.Errorf("n must not be %d: %w", n, errBad)
	}
	/* SECURITY - keys stay here
	   for good */
	for _, tc := range cases {
		panic(fmt.Sprintf("illegal %v", tc))
	}
	return nil, errors.New("plain")
}

func (s *Store) Do() {
	// the validator has spoken

	panic(err)
	slog.Info("x", "must", "not")
	ch := make(chan int)
	var mu sync.RWMutex
	obj.Errorf("it cannot be")
}
'''


def test_rules_of_go_code():
    got = golang.invariants("a/b.go", GO)
    assert [(t, m) for t, m, *_ in got] == [(1, "CRITICAL"), (2, "SECURITY"), (3, "fmt.Errorf"), (3, "panic+fmt.Sprintf"), (3, "panic(ident)")]
    assert got[0][2:4] == (8, 8) and got[1][2:4] == (14, 15) and got[4][4] == "the validator has spoken"
    assert [t for t, *_ in golang.invariants("a/b_test.go", GO)] == [1, 2]
    assert len(golang.invariants("systemcontracts/test/b_test.go", GO)) == 5
    many = "func f() {\n" + 'panic("must")\n' * 30 + "}\n"
    assert len(golang.invariants("m.go", many)) == golang.TIER3_PER_FILE
    assert golang.invariants("x.go", "func f() { g(panic(\"x must\" + y)) }") == []
    assert golang.invariants("e.go", "") == [] and golang.invariants("e.go", "((( /* \"") == []


def test_conventions_of_go_code(spark):
    got = golang.conventions("a/b.go", GO)
    assert got["", "new_constructors"] == 1 and got["", "errgroup_uses"] == 1 and got["", "table_driven"] == 1 and got["", "mutexes"] == 1 and got["", "channels"] == 1
    assert got["errors", "fmt.Errorf_wrap"] == 1 and got["errors", "errors.New"] == 1 and got["loggers", "slog"] == 1 and got["receivers", "s"] == 1
    tree = spark.createDataFrame([("a/b.go", GO), ("a/c_test.go", "package p\n"), ("d.go", "package q\n")], "path string, text string")
    stats = rules.convention_stats(rules.convention_counts(tree))
    told = {r.package: r.summary for r in rules.convention_summary(stats).collect()}
    assert told[""] == "package: . conventions summary.\n"
    assert "errors: errors.New=1, fmt.Errorf_wrap=1 (total=2)\n" in told["a"] and told["a"].endswith("tests: 1 files, table_driven=1, testify=0\n")
    one = rules.convention_chunks(stats).filter("symbol_name = 'a'").first()
    assert one.file == "a/<convention>" and one.convention_stats.file_count == 2


def test_policy(spark):
    with pytest.raises(ValueError, match="twice"):
        rules.validate_policy([{"name": "a", "paths": ["*"]}, {"name": "a", "paths": ["*"]}])
    with pytest.raises(ValueError, match="no paths"):
        rules.validate_policy([{"name": "a"}])
    df = spark.createDataFrame([("a/b/c.go",), ("x.md",), (None,)], "file string")
    got = rules.classify(df, [{"name": "go", "paths": ["**/*.go"], "also_review": ["r"]}, {"name": "all", "paths": ["a/**"]}]).collect()
    assert [(r.category, r.guidance and r.guidance.also_review) for r in got] == [("go", ["r"]), ("", None), ("", None)]


def hits(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, file string, start_line int, end_line int, chunk_kind string, provenance string, commit_hash string")


def test_citations(spark):
    lines = filters.line_counts(spark.createDataFrame([("a.go", "x\ny\n"), ("b.go", "x\ny"), ("e.go", ""), ("n.go", None)], "path string, text string"))
    assert {r.file: r.lines for r in lines.collect()} == {"a.go": 2, "b.go": 2, "e.go": 0, "n.go": 0}
    rows = [
        ("1", "a.go", 1, 2, "symbol", "", "h"), ("2", "gone.go", 1, 2, "symbol", "", "h"), ("3", "a.go", 0, 2, "symbol", "", "h"), ("4", "a.go", 3, 2, "symbol", "", "h"),
        ("5", "pr/x#1", 1, 1, "pr_background", "", "2024"), ("6", "c.jsonl", 0, 0, "invariant", "curated", ""), ("7", "a.go", 9, 9, "flow_step", "", ""), ("8", "", 1, 1, "symbol", None, None),
    ]
    kept, stats = filters.enforce_citations(hits(spark, rows), lines, "h")
    assert {r.chunk_id: r.stale for r in kept.collect()} == {"1": False, "5": True, "6": False, "7": True}
    assert stats.first().asDict() == {"kept": 4, "dropped": 4, "stale": 2}
    assert filters.enforce_citations(hits(spark, rows), None)[0].count() == 8


def test_verification_names_its_reasons(spark):
    tree = spark.createDataFrame([("a.go", "one\n  two\nthree"), ], "path string, text string")
    rows = [("a.go", 1, 2, "one two"), ("a.go", 3, 3, "two"), ("a.go", 2, 9, "x"), ("a.go", 0, 1, "x"), ("b.go", 1, 1, "x")]
    df = spark.createDataFrame(rows, "file string, start_line int, end_line int, snippet string")
    got = sorted((r.file, r.start_line, r.end_line, r.reason) for r in filters.verify_snippets(df, tree).collect())
    assert got == [("a.go", 0, 1, "out_of_range"), ("a.go", 1, 2, ""), ("a.go", 2, 9, "out_of_range"), ("a.go", 3, 3, "snippet_not_found"), ("b.go", 1, 1, "file_missing")]
    assert {r.reason for r in filters.verify_snippets(df, None).collect()} == {"no_src_root"}


def test_filters(spark):
    df = spark.createDataFrame([("go", "c", "a/b.go", "Function", "symbol"), ("go", "c", "a/x/b.go", "Struct", "symbol")], "language string, commit_hash string, file string, symbol_kind string, chunk_kind string")
    assert filters.Filter().apply(df) is df and filters.Filter().is_zero()
    assert filters.Filter(language="go", path_glob="a/*").apply(df).count() == 1
    assert filters.Filter(symbol_kinds=("Struct",), chunk_kinds=("symbol",), commit_hash="c").apply(df).count() == 1
    s = spark.createDataFrame([(0.1,), (0.3,)], "normalized double")
    assert filters.threshold(s, 0)[1].first().warning == "all_results_below_threshold"
    assert filters.threshold(s, -1)[0].count() == 2 and filters.threshold(s, 0.2)[1].first().asDict() == {"kept": 1, "dropped": 1, "warning": ""}


def test_freshness_and_alignment(spark):
    assert filters.freshness("a", "b", ["z", "y"])["changed_files"] == ["y", "z"] and filters.freshness("a", "a")["fresh"]
    assert filters.freshness("a", "")["warnings"] == ["git_unavailable"] and filters.freshness("", "b")["warnings"] == ["indexed_head_missing"]
    rows = [
        ("c" * 20, "d" * 20, "", "", "1.20", "p", True), ("c", "c", "x", "y", "1.20", "p", True), ("c", "c", "x", "x", "1.20", "p", True), ("c", "c", "x", "x", "1.18", "p", True),
        ("c", "c", "", "x", "?", "p", True), ("c", None, "x", None, "2", "p", False), ("c", "c", "x", "x", "2", "", True), (None, None, None, None, None, None, False),
    ]
    schema = "recorded_commit string, current_commit string, recorded_digest string, current_digest string, schema_version string, path string, readable boolean"
    got = filters.alignment(spark.createDataFrame(rows, schema)).collect()
    assert [r.status for r in got] == ["mismatch", "mismatch", "ok", "degraded", "degraded", "mismatch", "degraded", "not_aligned"]
    assert got[0].reason == f"commit changed: aligned {'c' * 12}, now {'d' * 12}" and not got[0].serviceable and len(got[4].warnings) == 1


RECORDS = [
    {"type": "flow", "id": "F", "summary": "takes an order", "entry_point": "POST /order", "root_symbol": "Handle"},
    {"type": "step", "id": "a", "flow": "F", "file": "x.go", "line": 3, "symbol": "A", "prose": "first", "calls": ["c", "b"], "branches": [{"when": "empty", "then": "stop", "at": "x.go:4"}]},
    {"type": "step", "id": "b", "flow": "F", "file": "x.go", "line": 9, "symbol": "B", "prose": "then", "calls": ["d", "zz"]},
    {"type": "step", "id": "c", "flow": "F", "file": "y.go", "line": 1, "symbol": "C", "prose": "or", "calls": ["d"]},
    {"type": "step", "id": "d", "flow": "F", "file": "y.go", "line": 5, "prose": "last", "calls": ["d"]},
    {"type": "invariant", "id": "I", "title": "T", "statement": "never twice", "check": "unique", "enforced_at": [{"flow": "F", "step": "b", "loc": "x.go:10"}]},
    {"type": "edge"}, {"type": "what"}, {"type": "step", "id": "q"}, {"type": "flow", "id": "G"},
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("flows") / "c.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in RECORDS) + "\n{broken\n")
    return files.flow_records(spark, str(path))


def test_flow_layer(spark, corpus):
    assert {r.kind: r.n for r in flows.record_counts(corpus).collect()} == {
        "flow": 1, "step": 4, "invariant": 1, "edge": 1, "unknown type": 1, "malformed": 1, "step missing id/file/line": 1, "flow missing id/summary": 1,
    }
    layer = flows.flow_chunks(corpus, F.lit("c.jsonl")).cache()
    by = {(r.chunk_kind, r.symbol_name): r for r in layer.collect()}
    assert by["flow_step", "A"].text == "first A empty" and by["flow_step", "A"].start_line == 3 and by["invariant", "I"].text == "T never twice unique"
    assert by["flow_spine", "Handle"].file == "c.jsonl" and by["flow_spine", "Handle"].flow_spine.entry_point == "POST /order"
    # the calls' own order counts: c before b
    for selector in ({"flow_id": "F"}, {"entry_point": "POST /order"}, {"invariant_id": "I"}):
        assert [r.step_id for r in flows.get_flow(layer, **selector).collect()] == ["a", "c", "b", "d"]
    with pytest.raises(flows.Miss, match="POST /order"):
        flows.get_flow(layer, entry_point="nope")
    with pytest.raises(ValueError):
        flows.get_flow(layer)
    down = {r.step_id: r.hop for r in flows.expand_flow(layer, "a", "down", 2).collect()}
    assert down == {"b": 1, "c": 1, "d": 2}
    assert {r.step_id for r in flows.expand_flow(layer, "d", "up", 1).collect()} == {"b", "c"}
    with pytest.raises(flows.Miss):
        flows.expand_flow(layer, "none")
    sites = flows.invariant_enforcement(layer, "I").collect()
    assert [(r.flow, r.step, r.loc, r.statement) for r in sites] == [("F", "b", "x.go:10", "T never twice unique")]
    kept, gone = flows.without_layer(layer.unionByName(layer.filter("1 = 0")))
    assert kept.count() == 0 and gone.first().n == 6
    code = spark.createDataFrame([("x.go", 1, 20, "wide"), ("x.go", 2, 5, "tight")], "file string, start_line int, end_line int, canonical_id string")
    assert {r.flow_step.step_id: r.canonical_id for r in flows.align_steps(layer, code).filter("flow_step is not null").collect()} == {"a": "tight", "b": "wide", "c": "", "d": ""}


def test_glossary(spark, tmp_path):
    text = "| 한국어 | english |\n|---|---|\n| 상태 저장소 | state store `StateDB` (trie) 12 |\n| plain | x |\n그래서 합의 엔진 (consensus engine)은 빠르다. 값(123)\n## 제목 (heading)\n"
    got = {r.phrase: r.keywords for r in glossary.glossary(spark.createDataFrame([(text,), (None,), ("",)], "text string")).collect()}
    assert got["그래서 합의 엔진"] == ["consensus engine"] and "StateDB" in got["상태 저장소"] and "trie" in got["상태 저장소"] and "12" not in got["상태 저장소"]
    assert not any("plain" in k or k.startswith("#") for k in got)
    df = spark.createDataFrame([("b", ["y"]), ("a", ["x", "z"]), ("c", [])], "phrase string, keywords array<string>")
    glossary.write_yaml(df, str(tmp_path / "a.yaml"))
    assert (tmp_path / "a.yaml").read_text() == 'aliases:\n  "a":\n    - "x"\n    - "z"\n  "b":\n    - "y"\n'


def test_loaders(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).write_text(json.dumps(value))  # JSON is YAML
        return str(tmp_path / name)

    assert glossary.load_policy("") == [] and glossary.load_policy(put("p", {"categories": [{"name": "a", "paths": ["*"]}]}))[0]["name"] == "a"
    assert glossary.load_aliases(put("a", {"aliases": {"k": ["v"]}})) == {"k": ["v"]}
    rows = glossary.load_fixture(spark, put("f", {"queries": [{"id": "q", "intent": "i", "expected": {"file": "a.go", "line_range": [1, 3]}}]})).collect()
    assert (rows[0].query_id, rows[0].from_line, rows[0].to_line) == ("q", 1, 3)
    with pytest.raises(ValueError):
        glossary.load_fixture(spark, put("g", {"queries": [{"id": "q", "intent": "", "expected": {"file": "a.go", "line_range": [1, 3]}}]}))
    assert glossary.load_pull_fixture(spark, put("r", {"prs": [{"id": "1", "repo": "a/b", "pr_number": 4}]})).first().changed_files == []
    assert glossary.load_project(put("c", {"schema_version": "1", "languages": ["go"], "important_symbols": ["^New"]}))["file_header_lines"] == 50
    for bad in ({}, {"schema_version": "1", "languages": ["javascript"]}, {"schema_version": "1", "build_roots": ["/abs"]}):
        with pytest.raises(ValueError):
            glossary.load_project(put("d", bad))


def test_scores_of_queries(spark):
    fixture = spark.createDataFrame([("a", "i", "x.go", 10, 20), ("b", "i", "y.go", 1, 2), ("c", "i", "z.go", 1, 1)], "query_id string, intent string, file string, from_line int, to_line int")
    rows = [
        ("a", 1, "x.go", 30, 40, 0.9, False, True, ""), ("a", 2, "x.go", 15, 40, 0.8, False, True, ""), ("a", 1, "x.go", 11, 12, 0.7, True, False, "file_missing"),
        ("b", 1, "y.go", 1, 1, 0.6, False, False, "out_of_range"),
    ]
    hits_ = spark.createDataFrame(rows, "query_id string, rank int, file string, start_line int, end_line int, normalized double, is_example boolean, verified boolean, reason string")
    per = {r.query_id: r for r in evaluate.score_queries(hits_, fixture, 5).collect()}
    assert (per["a"].found_rank, per["a"].hits_returned, per["a"].hallucination_count, per["a"].hallucination_reason) == (2, 2, 1, "file_missing")
    assert per["b"].found_rank == 1 and per["c"].found_rank == 0 and per["c"].hits_returned == 0 and per["a"].top_hit_score == 0.9
    total = evaluate.summarize(evaluate.score_queries(hits_, fixture, 5)).first()
    assert (total.total, total.found, total.total_hits, total.hallucination_hits) == (3, 2, 3, 2)
    assert total.mrr == pytest.approx(0.5) and total.citation_accuracy == 1.0 and total.hallucination_rate == pytest.approx(2 / 3)


def test_texts_of_plans(spark):
    plan = "Use StateDB.Commit and Cache.\n\n## Expected files:\n- core/a.go: new\n* core/b.go\n- core/a.go\n\n## Risks\n- x.go\n"
    row = spark.createDataFrame([(plan, ["core/a.go", "core/c.go"], ["statedb_commit"], ["use StateDB.Commit", "and the cache"])], "plan string, truth_files array<string>, truth_symbols array<string>, commit_messages array<string>")
    got = service.score_plan(row).first()
    assert (got.file_precision, got.file_recall, got.file_f1) == (0.5, 0.5, 0.5) and got.symbol_recall == 1.0
    assert 0 < got.steps_score <= 1
    df = spark.createDataFrame([(plan,), ("no list",), (None,), ('x ```json\n{"score": 1.7, "rationale": "r"}\n```',), ('so {"score": 0.25} it is',), ('{"score": 0}',)], "t string")
    out = df.select(X.expected_files(F.col("t")).alias("f"), X.plan_symbols(F.col("t")).alias("s"), X.judge_verdict(F.col("t")).alias("v")).collect()
    assert out[0].f == ["core/a.go", "core/b.go"] and out[0].s == ["Use", "StateDB.Commit", "Cache", "Expected", "Risks"] and out[1].f == []
    assert out[3].v.score == 1.0 and out[4].v.score == 0.25 and out[5].v is None and out[1].v is None


def test_bytes_are_cut_between_characters(spark):
    for text, cap in (("é" * 200, 120), ("日本語" * 80, 101), ("a" * 300, 5), ("short", 100), ("é" * 10, 7), ("🎉" * 30, 50)):
        got = spark.createDataFrame([(text,)], "t string").select(X.truncate_bytes(F.col("t"), cap).alias("c")).first().c
        assert len(got.encode()) <= max(cap, 0) or text == got
        room = cap - len(X.TRUNCATED)
        if len(text.encode()) > cap:
            head = got.removesuffix(X.TRUNCATED) if room > 0 else got
            assert text.startswith(head) and len(head.encode()) > (room if room > 0 else cap) - 4


def test_markdown_names(spark):
    rows = [(1, "no heading\nhere"), (2, "intro\r\n\r\n# One ##\nx\n```\n# no\n```\n####### seven\n#none\n##\n## Two"), (3, "\n# A\n"), (4, ""), (5, None), (6, "   \n\n")]
    got = {}
    for r in files.markdown_sections(spark.createDataFrame(rows, "k int, text string"), "k").collect():
        got.setdefault(r.k, []).append((r.start_line, r.end_line, r.name))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(1, 2, "untitled")], 2: [(1, 2, "preamble"), (3, 10, "one"), (11, 11, "two")], 3: [(2, 2, "a")], 6: [(1, 2, "untitled")],
    }


def test_rerank_reads_symbol_and_first_line_of_the_candidates(spark):
    rows = [("a", "Alpha", "\n  func alpha\nquery words here", 1, 0.9), ("b", "Query", "x", 2, 0.8), ("c", "", "the query words", 3, 0.7)]
    df = spark.createDataFrame(rows, "chunk_id string, symbol_name string, text string, vector_rank int, normalized double")
    assert [r.t for r in df.select(search.corpus_text().alias("t")).collect()] == ["Alpha func alpha", "Query x", "the query words"]
    out = search.rerank(df, ["query", "words"]).orderBy("hybrid_rank").collect()
    assert {r.chunk_id: r.score > 0 for r in out} == {"a": False, "b": True, "c": True}
    stats = search.rerank_stats(search.rerank(df, ["query", "words"])).first()
    assert stats.candidates == 3 and stats.rank_changes == sum(r.hybrid_rank != r.vector_rank for r in out)
    assert [r.hybrid_rank for r in search.rerank(df, []).orderBy("vector_rank").collect()] == [1, 2, 3]


def test_postings_score_like_the_whole_corpus(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["the CamelCase cache", "the the the", "cache_line of a cache", "", None, "zebra"])], "doc_id long, text string")
    index = postings.build(docs, str(tmp_path / "i"))
    asked = ["the", "cache", "the", "absent"]
    got = {r.id: r.score for r in postings.scored(index, asked).collect()}
    want = {r.doc_id: r.score for r in search.bm25(docs, asked).collect()}
    assert got == want and index.ready() and index.stats().n == 6
    plan = index.postings(["cache"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert postings.scored(index, []).count() == 0


def test_embedding_survives_refusals():
    def embed(texts):
        if len(texts) > 2 or any(len(t.encode()) > 5000 for t in texts) or "poison" in texts:
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]

    rows = [("a", "x"), ("b", "poison"), ("c", "é" * 6000), ("d", "yy"), ("e", "z")]
    assert engine.embed_resilient(embed, rows) == [("a", [1.0]), ("c", [2000.0]), ("d", [2.0]), ("e", [1.0])]

    def down(texts):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError, match="down"):
        engine.embed_resilient(down, rows)
    calls = []
    cached = engine.CachedEmbed(lambda ts: calls.append(list(ts)) or [[len(t)] for t in ts], size=2)
    assert cached(["a", "bb", "a"]) == [[1], [2], [1]] and cached(["bb"]) == [[2]] and calls == [["a", "bb"]]
    assert cached(["c", "d", "e"]) == [[1], [1], [1]] and len(cached.held) == 2


def test_embedder_embeds_equal_texts_once(spark):
    e = engine.Embedder("p", "m", 2, embed=lambda ts: [[float(len(t)), 1.0] for t in ts])
    rows = spark.createDataFrame([("1", "aa"), ("2", "aa"), ("3", "b")], "chunk_id string, text string")
    assert {r.chunk_id: list(r.embedding) for r in e.vectors(rows).collect()} == {"1": [2.0, 1.0], "2": [2.0, 1.0], "3": [1.0, 1.0]}
    assert e.identity == "provider=p;model=m;dim=2;pooling=sum;normalize=l2" and e.query(spark, "abc") == [3.0, 1.0]


def test_written_prefixes(spark):
    chunks = spark.createDataFrame([("1", "go", "a.go", "x"), ("2", "go", "b.go", "x"), ("3", "", "c", "bad")], "chunk_id string, language string, file string, text string")

    def generate(prompt):
        if "bad" in prompt:
            raise RuntimeError
        return "  It does x.\nmore"

    got = {r.chunk_id: r.prefix for r in engine.written_prefixes(chunks, generate).collect()}
    assert got == {"1": "It does x.", "2": "It does x."}


def test_lock_and_ledger(spark, tmp_path):
    root = f"file://{tmp_path}"
    with upkeep.lock(spark, root), pytest.raises(upkeep.Locked):
        with upkeep.lock(spark, root):
            pass
    with upkeep.lock(spark, root):
        pass
    led = upkeep.Ledger(spark, root, "head1")
    todo = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    assert led.done() is None and led.open(todo).count() == 2
    led.mark(todo.filter("path = 'a'"))
    assert [r.path for r in upkeep.Ledger(spark, root, "head1").open(todo).collect()] == ["b"]
    assert led.open(spark.createDataFrame([("a", "other")], "path string, sha string")).count() == 1
    assert upkeep.Ledger(spark, root, "head2").open(todo).count() == 2 and upkeep.Ledger(spark, root, "head1").done() is None
    led.clear()


def test_migrations(spark, tmp_path):
    snaps = store.Snapshots(spark, f"file://{tmp_path}/m")
    snaps.publish({"chunks": spark.createDataFrame([("a",)], "chunk_id string")}, identity="i")
    assert upkeep.migrate(snaps, dry_run=True) == ["001", "002", "003", "004"] and "category" not in snaps.read("chunks").columns
    before = snaps.manifest()["version"]
    assert upkeep.migrate(snaps) == ["001", "002", "003", "004"] and {"category", "invariants", "provenance"} <= set(snaps.read("chunks").columns)
    assert snaps.manifest()["backup"] == before and snaps.manifest()["identity"] == "i" and upkeep.migrate(snaps) == []
    with pytest.raises(ValueError, match="changed since"):
        upkeep.migrate(snaps, steps=(("001", {"category": "int"}),))
    assert len(snaps.versions()) == 2 and snaps.expire(1) == [before]
    with pytest.raises(ValueError):
        snaps.promote("v-none")
    assert snaps.promote(snaps.manifest()["version"])["identity"] == "i"


def test_changes_apply_in_their_order(spark, tmp_path):
    rows = [("a", 1, "old", False), ("a", 3, "new", False), ("a", 2, "mid", False), ("b", 1, "x", False), ("b", 2, "x", True)]
    batch = spark.createDataFrame(rows, "chunk_id string, seq int, text string, deleted boolean")
    last = {r.chunk_id: (r.text, r.deleted) for r in events.last_changes(batch, order="seq").collect()}
    assert last == {"a": ("new", False), "b": ("x", True)}
    old = spark.createDataFrame([("b", 0, "o"), ("c", 0, "o")], "chunk_id string, seq int, text string")
    assert {r.chunk_id: r.text for r in events.merged(old, events.last_changes(batch, order="seq")).collect()} == {"a": "new", "c": "o"}


def test_profile_and_footprint(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [("a.done", rng.randrange(500)) for _ in range(321)] + [("b.done", 7)] + [("a.start", None)]
    df = spark.createDataFrame(rows, "event string, latency_ms long")
    got = {r.event: (r["count"], r.p50, r.p95) for r in evaluate.footprint_profile(df).collect()}
    s = sorted(v for e, v in rows if e == "a.done")
    assert got == {"a.done": (321, s[160], s[min(321 * 95 // 100, 320)]), "b.done": (1, 7, 7)}
    log = upkeep.Footprint(spark, f"file://{tmp_path}/log")
    with log.span("search", intent="x") as extra:
        extra["hits"] = 3
    with pytest.raises(RuntimeError), log.span("bad"):
        raise RuntimeError("no")
    log.close()
    back = files.footprint(spark, f"file://{tmp_path}/log").collect()
    assert [r.event for r in back] == ["search.start", "search.done", "bad.start", "bad.failed"] and back[1].fields["hits"] == "3" and back[3].error == "no"


def test_pull_requests(spark, tmp_path):
    rows = [{"repo": "a/b", "pr_number": n, "title": f"t{n}", "changed_files": ["x.go", "y.go"][: n % 3], "merged_at": f"2024-01-0{n}T10:00:00Z", "commit_messages": []} for n in (1, 2, 3)]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    prs = files.pull_requests(spark, str(tmp_path / "p.jsonl"))
    assert files.pull_requests(spark, str(tmp_path / "p.jsonl"), since="2024-01-02").count() == 2 and files.pull_requests(spark, str(tmp_path / "p.jsonl"), limit=1).first().pr_number == 3
    crumbs = {r.file: [(x.number, x.merged_at_utc) for x in r.recent_prs] for r in files.pr_breadcrumbs(prs).collect()}
    assert crumbs == {"x.go": [(1, "2024-01-01T10:00:00Z"), (2, "2024-01-02T10:00:00Z")], "y.go": [(2, "2024-01-02T10:00:00Z")]}
    assert files.pr_cutoff(prs).first().asDict() == {"repo": "a/b", "last_pr_number": 3, "last_merged_at": "2024-01-03T10:00:00Z"}
    df = spark.createDataFrame([("h", "b"), ("h", " "), (None, "b"), ("", None)], "h string, b string")
    assert [r.m for r in df.select(files.commit_message(F.col("h"), F.col("b")).alias("m")).collect()] == ["h\n\nb", "h", "b", None]


def test_walk_leaves_out_what_it_must(spark, tmp_path):
    for name, body in {"a.go": "package a", "vendor/b.go": "x", "x/vendor/c.go": "x", ".env.test": "k", "d.md": "# x", "e.go": "a\0b", "f.ts": "x", "skip/g.go": "x", "k.pem": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / files.IGNORE_FILE).write_text("# own\nskip/\n\n*.ts\n")
    assert {r.path for r in files.walk(spark, str(tmp_path)).collect()} == {"a.go", "x/vendor/c.go", "d.md"}
    named = spark.createDataFrame([("a.go",)], "path string")
    assert {r.path for r in files.walk(spark, str(tmp_path), build_files=named, languages=["go"]).collect()} == {"a.go"}
    assert {r.category for r in files.docs_roots(spark, [str(tmp_path)]).collect()} == {"domain"}


def test_density_caps(spark):
    text = "sig\nbody one\nbody two\nbody three"
    df = spark.createDataFrame([(0, 1, text), (0, 2, text)], "query int, rank int, text string")
    assert {r.density for r in search.density(df, 10**6, cap="signature_only").collect()} == {"signature_only"}
    got = search.density(df, 10**6, ctx_lines=1, cap="signature_5").collect()
    assert {r.snippet for r in got} == {"sig\nbody one"} and {r.tokens_used for r in got} == {6}
    assert [r.density for r in search.density(df, 4, ctx_lines=1, cap="signature_5").orderBy("rank").collect()] == ["signature_5", "signature_only"]


def test_service_answers(spark, tmp_path, corpus):
    tree = tmp_path / "t"
    (tree / "a").mkdir(parents=True)
    (tree / "a/store.go").write_text(GO)
    (tree / "a/store_test.go").write_text("package p\n\nfunc TestStore(t int) {\n\tx()\n}\n")
    (tree / "adr").mkdir()
    (tree / "adr/one.md").write_text("# Storage choice\nWe keep a store.\n")
    root = f"file://{tmp_path}/idx"
    prs = spark.createDataFrame([("a/b", 7, "Add store", "## Background\nNeeded.\n", ["m"], ["a/store.go"], "2024-01-01T00:00:00Z")], "repo string, pr_number int, title string, body string, commit_messages array<string>, changed_files array<string>, merged_at string")
    told = engine.build(spark, str(tree), root, prs=prs, flow_records=corpus, policy=[{"name": "core", "paths": ["a/**"], "watch_out": ["locks"]}], commit="h1", whole_files=True)
    assert told["prs"]["last_pr_number"] == 7
    s = service.Service(spark, root, str(tree), patterns=[("key", "SECRETKEY", "block")])
    call = lambda name, **a: s.call(name, **a)
    assert len(service.OPERATIONS) == 19 and "error" in call("nope") and call("ops.health")["ready"]
    got = call("context.semantic_search", intent="new store", k=3, threshold=-1)
    assert got["schema_version"] == "1.1" and got["hits"] and all("text" not in h for h in got["hits"]) and got["tokens_used"] > 0
    assert "error" in call("context.semantic_search", intent=" ") and call("context.semantic_search", intent="x", threshold=2.0)["warnings"]
    best = call("context.keyword_search", query="NewStore", k=2)["hits"]
    assert best[0]["citation"]["file"] == "a/store.go" and best[0]["category"] == "core" and best[0]["guidance"]["watch_out"] == ["locks"]
    ids = [h["chunk_id"] for h in best]
    assert [h["chunk_id"] for h in call("context.narrow_candidates", ids=ids[::-1])["hits"]] == ids[::-1]
    assert call("context.narrow_candidates", ids=ids, category="none")["hits"] == []
    why = call("context.explain_match", chunk_id=ids[0], intent="NewStore store")
    assert why["bm25_score"] > 0 and "newstore" in why["matched_tokens"] and "error" in call("context.explain_match", chunk_id="?", intent="x")
    assert call("context.related_changes", file="a/store.go")["changes"] == [{"number": 7, "title": "Add store", "merged_at_utc": "2024-01-01T00:00:00Z"}]
    found = call("context.find_invariants", file="a/store.go", tier_min=0)["invariants"]
    assert {i["marker"] for i in found} >= {"CRITICAL", "SECURITY", "fmt.Errorf"} and {i["tier"] for i in call("context.find_invariants", tier_min=3)["invariants"]} == {3}
    assert [c["package"] for c in call("context.get_conventions", prefix="A")["conventions"]] == ["a"]
    assert [x["step_id"] for x in call("context.get_flow", flow_id="F")["steps"]] == ["a", "c", "b", "d"] and "nearest" in call("context.get_flow", entry_point="none")["error"]
    assert call("context.expand_flow", step_id="a")["neighbors"] and call("context.get_invariant_enforcement", invariant_id="I")["enforced_at"][0]["step"] == "b"
    assert call("context.find_branches", symptom="first A empty", k=5)["branches"][0]["when"] == "empty"
    assert call("context.expand_in_file", chunk_id=ids[0])["hits"] and len(call("ops.embed", texts=["a", "b"])["vectors"]) == 2 and "error" in call("ops.embed", texts=["SECRETKEY"])
    vec = call("ops.embed", texts=["store"])["vectors"][0]
    assert len(call("ops.vector_search", vector=vec, k=2)["hits"]) == 2 and call("ops.rerank", intent="store", ids=ids)["hits"] and call("ops.warmup")["ready"]
    e = s.engine
    own = {r.chunk_kind for r in e.chunks.select("chunk_kind").distinct().collect()}
    assert {"symbol", "file_header", "file_full", "doc", "invariant", "convention", "flow_step", "flow_spine", "pr_background", "commit_message"} <= own
    head = e.chunks.filter("chunk_kind = 'file_header' and file = 'a/store.go'").first()
    assert head.symbol_kind == "FileHeader" and e.by_file("a/store.go").count() > 5 and e.files().count() > 3 and e.flow_chunks().count() == 6 and e.docs().count() == 0
    assert e.alignment().first().status == "not_aligned"
    nodes = spark.createDataFrame([("a/store.go", 10, 20, "pkg.NewStore")], "file string, start_line int, end_line int, canonical_id string")
    snaps = store.Snapshots(spark, root)
    upkeep.realign(snaps, nodes, {"commit": "c", "digest": "d", "schema_version": "1.20", "path": "g"})
    assert snaps.read("chunks").filter("symbol_name = 'NewStore'").first().canonical_id == "pkg.NewStore"
    fixture = spark.createDataFrame([("q1", "NewStore", "a/store.go", 1, 40), ("q2", "", "x", 1, 1)], "query_id string, intent string, file string, from_line int, to_line int")
    scores, total = service.evaluate(s, fixture, 5, files.walk(spark, str(tree)), threshold=-1)
    assert total.first().total == 2 and total.first().found == 1 and scores.count() == 2
    assert call("ops.index", mode="odd")["error"]


def test_command_line():
    from stratalex import __main__ as cli

    a = cli.parser().parse_args(["--index", "i", "query", "find it", "-k", "3"])
    assert (a.command, a.intent, a.k) == ("query", "find it", 3)
    assert cli.parser().parse_args(["--index", "i", "reindex", "--src", "s", "--files", "a", "b"]).files == ["a", "b"]
    said = cli.run(SimpleNamespace(command="model", index="i", src=""), None)
    assert said["models"][0]["dimension"] == 64
