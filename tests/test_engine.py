import pytest

from stratalex.plans import engine

GO = "package a\n\n// Evict drops the oldest cache entry.\nfunc Evict(n int) int {\n\treturn n\n}\n\ntype Cache struct {\n\tm int\n}\n"
SOL = "contract Token {\n  function transfer(address to) public {\n    x = 1;\n  }\n}\n"
MD = "# Decisions\nWe keep the cache small.\n## Eviction order\nOldest first.\n"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("engine")
    tree = top / "src"
    tree.mkdir()
    for name, body in {"cache.go": GO, "cache_test.go": GO.replace("Evict", "TestEvict"), "token.sol": SOL, "adr-1.md": MD}.items():
        (tree / name).write_text(body)
    root = f"file://{top}/index"
    engine.build(spark, str(tree), root)
    return tree, root


def test_build_and_search(spark, index):
    e = engine.Engine(spark, index[1])
    assert e.health().first().ok
    kinds = {(r.file, r.symbol_name, r.chunk_kind) for r in e.chunks.collect()}
    assert {("cache.go", "Evict", "symbol"), ("cache.go", "Cache", "symbol"), ("cache.go", "", "file_header"), ("token.sol", "Token.transfer", "symbol"), ("adr-1.md", "eviction-order", "doc")} <= kinds
    hits = e.search("evict oldest cache entry", engine.Options(threshold=-1, k=5)).orderBy("rank").collect()
    assert hits and {h.file for h in hits if not h.is_test} and any(h.is_test for h in hits)
    assert any(h.symbol_name == "Evict" for h in hits)
    small = e.search("evict oldest cache entry", engine.Options(threshold=-1, k=5, budget=40)).collect()
    assert -(-sum(len(h.snippet) for h in small) // 4) <= 40 or {h.density for h in small} == {"signature_only"}
    with pytest.raises(ValueError, match="intent"):
        e.search(" ")


def test_lookups(spark, index):
    e = engine.Engine(spark, index[1])
    best = e.keyword_search("transfer token", 3).collect()
    assert best[0].file == "token.sol" and best[0].normalized > 0
    one = next(r for r in e.chunks.collect() if r.symbol_name == "Evict")
    assert [r.file for r in e.narrow([one.chunk_id]).collect()] == ["cache.go"]
    assert {r.file for r in e.expand_in_file(one.chunk_id, 1, 1).collect()} == {"cache.go"}


def test_reindex_replaces_changed_files(spark, index):
    tree, root = index
    (tree / "token.sol").write_text(SOL.replace("transfer", "approve"))
    (tree / "cache_test.go").unlink()
    changes = spark.createDataFrame([("M", "token.sol"), ("D", "cache_test.go")], "op string, path string")
    engine.reindex(spark, str(tree), root, changes)
    e = engine.Engine(spark, root)
    names = {(r.file, r.symbol_name) for r in e.chunks.collect()}
    assert ("token.sol", "Token.approve") in names and ("token.sol", "Token.transfer") not in names
    assert not any(f == "cache_test.go" for f, _ in names) and ("cache.go", "Evict") in names
    assert e.health().first().ok
