import random

import pytest
from pyspark.sql import functions as F

from stratalex.operators import evaluate, graph, ranges, search, store
from stratalex.sources import files
from stratalex.streaming import events


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fusion_of_three_hits(spark):
    hits = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 1.0), ("c", 3, 3.0)], "doc_id string, vector_rank int, score double")
    got = {r.doc_id: (round(r.fused, 6), r.hybrid_rank) for r in search.rrf(hits).collect()}
    assert got == {"a": (0.032522, 1), "b": (0.032002, 3), "c": (0.032266, 2)}


def loop(sizes, budget):
    """Tiers of one query's hits, (full, five, one) bytes by rank, as a loop decides."""
    tier, total = [0] * len(sizes), lambda: -(-sum(s[t] for s, t in zip(sizes, tier)) // 4)
    for level in (1, 2):
        for i in range(len(sizes) - 1, -1, -1):
            if total() <= budget:
                return tier
            tier[i] = level
    return tier


def test_density_is_that_of_the_loop(spark):
    rng, data = random.Random(2), []
    for q in range(40):
        for r in range(rng.randrange(1, 7)):
            data.append((q, r, "\n".join("z" * rng.randrange(1, 60) for _ in range(rng.randrange(1, 12)))))
    for budget in (20, 60, 150):
        got = {(r.query, r["rank"]): r.density for r in search.density(spark.createDataFrame(data, "query int, rank int, text string"), budget, ctx_lines=2).collect()}
        for q in {d[0] for d in data}:
            own = [d[2].split("\n") for d in data if d[0] == q]
            sizes = [(len("\n".join(x)), len("\n".join(x[:3])), len(x[0])) for x in own]
            assert [got[q, i] for i in range(len(own))] == [("full", "signature_5", "signature_only")[t] for t in loop(sizes, budget)]


def test_thresholds(spark):
    hits = spark.createDataFrame([(0.3,), (0.4,), (0.9,)], "normalized double")
    assert [search.threshold(hits, t).count() for t in (0, -1, 0.5)] == [2, 3, 1]


def test_boost_multiplies(spark):
    hits = spark.createDataFrame([(1, 0.5, 1, "Cache", "a/cache/x.go", "// evicts\nfunc F() {", "h"), (2, 0.6, 2, "", "b/y.go", "zzz", "g")], "id int, normalized double, vector_rank int, symbol_name string, file string, text string, commit_hash string")
    got = {r.id: (r.boosted, r.boost_rank) for r in search.boost(hits, ["evict"], head="h", package="cache").collect()}
    assert got[1] == (round(0.5 * 1.5 * 1.3 * 1.1 * 1.2, 9), 1) and got[2] == (0.6, 2)


def test_bm25_repeats_count(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta beta gamma"), (3, None)], "doc_id int, text string")
    one = {r.doc_id: r.score for r in search.bm25(docs, ["beta"]).collect()}
    two = {r.doc_id: r.score for r in search.bm25(docs, ["beta", "beta"]).collect()}
    assert set(one) == {1, 2} and all(two[k] == pytest.approx(2 * one[k], abs=2e-6) for k in one)


def test_ladder_steps(spark):
    nodes = spark.createDataFrame([("f", 10, 20, "n1", 0), ("f", 10, 14, "n2", 1), ("f", 30, 40, "n3", 2)], "file string, start_line int, end_line int, node_id string, ord int")
    cases = [(10, 12, "n2", 1), (12, 13, "n2", 2), (18, 19, "n1", 2), (28, 31, "n3", 3), (24, 25, "n1", 4), (25, 26, "n3", 4), (29, 30, None, None), (60, 61, None, None)]
    c = spark.createDataFrame([("f", a, z, i) for i, (a, z, _, _) in enumerate(cases)], "file string, start_line int, end_line int, chunk_id int")
    got = {r.chunk_id: (r.node_id, r.step) for r in ranges.ladder(c, nodes).collect()}
    assert got == {i: (n, s) for i, (_, _, n, s) in enumerate(cases) if n}


def test_tightest_span(spark):
    spans = spark.createDataFrame([("f", 1, 100, "wide", 0), ("f", 5, 9, "a", 1), ("f", 6, 10, "b", 2)], "file string, start_line int, end_line int, span_id string, ord int")
    points = spark.createDataFrame([("f", 7, 1), ("f", 50, 2), ("g", 7, 3)], "file string, line int, point_id int")
    assert {r.point_id: r.span_id for r in ranges.tightest(points, spans).collect()} == {1: "a", 2: "wide", 3: None}


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(graph.reach(edges, "a", 5), "node", "hop") == [("b", 1), ("c", 2), ("d", 3)]
    assert rows(graph.reach(edges, "d", 1, "up"), "node", "hop") == [("c", 1)]


def test_topological_order_with_a_cycle(spark):
    steps = spark.createDataFrame([("f", n, i) for i, n in enumerate("abcxy")], "flow string, node string, ord int")
    edges = spark.createDataFrame([("f", "a", "c"), ("f", "b", "c"), ("f", "x", "y"), ("f", "y", "x")], "flow string, src string, dst string")
    got = [r.node for r in graph.topological_order(steps, edges).orderBy("pos").collect()]
    assert got == ["a", "b", "c", "x", "y"]


def test_snapshots_publish_and_refuse(spark, tmp_path):
    s = store.Snapshots(spark, f"file://{tmp_path}/store")
    assert s.manifest() is None and s.read("chunks") is None
    a = spark.createDataFrame([("1", "x"), ("2", "y")], "chunk_id string, text string")
    s.publish({"chunks": a}, epoch=0)
    b = store.upsert(s.read("chunks"), spark.createDataFrame([("2", "z"), ("3", "w")], "chunk_id string, text string"))
    first = s.publish({"chunks": b}, epoch=1)
    assert rows(s.read("chunks"), "chunk_id", "text") == [("1", "x"), ("2", "z"), ("3", "w")]
    with pytest.raises(ValueError, match="validation"):
        s.publish({"chunks": a}, check=lambda t: t["chunks"].count() > 2)
    assert s.manifest() == first


def test_validation_counts_orphans(spark):
    chunks = spark.createDataFrame([("1", "symbol", "c"), ("2", "symbol", ""), ("3", "doc", None)], "chunk_id string, chunk_kind string, canonical_id string")
    vectors = spark.createDataFrame([("1",), ("2",), ("9",)], "chunk_id string")
    r = store.validate(chunks, vectors).first()
    assert (r.chunks, r.vectors, r.orphan_chunks, r.orphan_vectors, r.symbol_chunks, r.canonical, r.canonical_rate, r.ok) == (3, 3, 1, 1, 2, 1, 0.5, False)


def test_metrics(spark):
    ranks = spark.createDataFrame([(1,), (4,), (None,)], "rank int")
    m = evaluate.rank_metrics(ranks).first()
    assert (m.queries, m.found, m.recall_at_1, m.recall_at_5) == (3, 2, pytest.approx(1 / 3), pytest.approx(2 / 3)) and m.mrr == pytest.approx(1.25 / 3)
    f = evaluate.set_f1(spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), (["a"], [])], "pred array<string>, truth array<string>")).collect()
    assert (f[0].precision, f[0].recall, f[0].f1) == (0.5, pytest.approx(1 / 3), pytest.approx(0.4)) and f[1].f1 == 0
    p = evaluate.latency_profile(spark.createDataFrame([("e", float(i)) for i in range(1, 101)], "event_type string, value double")).first()
    assert (p["count"], p.p50, p.p95) == (100, 50.0, 96.0)


def test_markdown_sections(spark):
    text = "intro\n# One\na\n```\n# not a heading\n```\n## Two words\r\nb\n"
    got = rows(files.markdown_sections(spark.createDataFrame([(1, text)], "id int, text string"), "id"), "start_line", "end_line", "slug")
    assert got == [(1, 1, "preamble"), (2, 6, "one"), (7, 8, "two-words")]


def test_walk_and_diff(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "vendor").mkdir()
    for name, body in {"a/x.go": b"package a\n", "a/y.bin": b"q", "a/z.ts": b"\0\1", "vendor/v.go": b"package v\n", "r.md": b"# r\n"}.items():
        (tmp_path / name).write_bytes(body)
    assert rows(files.walk(spark, str(tmp_path)), "path", "language") == [("a/x.go", "go"), ("r.md", "markdown")]
    diff = spark.createDataFrame([(i, x) for i, x in enumerate(["A\tn", "R090\to\tp", "C1\tq\tr", "T\tt", "D\tg"])], "n int, line string")
    assert rows(files.expand_diff(diff, "n"), "n", "op", "path") == [(0, "A", "n"), (1, "A", "p"), (1, "D", "o"), (2, "A", "r"), (3, "M", "t"), (4, "D", "g")]


def test_pull_request_chunks(spark):
    body = "## Background\nwhy it is\n\n**Solution**\nwhat was done\n## Notes\nx"
    prs = spark.createDataFrame([("r/p", 7, "T", body, ["one", "two"], ["a.go"], "2024-01-01T00:00:00Z")], "repo string, pr_number int, title string, body string, commit_messages array<string>, changed_files array<string>, merged_at string")
    got = rows(files.pr_chunks(prs), "start_line", "chunk_kind", "text", "file")
    assert got == [(1, "pr_background", "why it is", "pr/r/p#7"), (2, "pr_solution", "what was done", "pr/r/p#7"), (3, "commit_message", "one\n\n---\n\ntwo", "pr/r/p#7")]


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.parquet").symlink_to(f"{sf}/events.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = events.event_profile(stream).writeStream.outputMode("complete").format("memory").queryName("profile").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM profile").first().n == spark.read.schema(schema).parquet(str(tmp_path / "in")).count()
    snaps = store.Snapshots(spark, f"file://{tmp_path}/snap")
    changes = stream.select(F.col("event_id").alias("chunk_id"), "event_type", (F.col("event_id") % 10 == 0).alias("deleted"))
    events.maintain(changes, snaps, checkpoint=str(tmp_path / "cp")).awaitTermination(120)
    assert snaps.read("chunks").filter("chunk_id % 10 = 0").count() == 0 and snaps.read("chunks").count() > 0
