import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stratalex.functions import exprs as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("glob", "path", "ok"),
    [("*.go", "a.go", True), ("*.go", "d/a.go", False), ("**/*.go", "d/e/a.go", True), ("**/*.go", "a.go", True), ("src/**", "src/a/b", True), ("src/**", "srcs/a", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("[ab]x", "bx", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True)],
)
def test_globs(spark, glob, path, ok):
    assert one(spark, path, lambda c: X.glob_match(c, glob)) is ok


def test_ignore_patterns_are_anchored(spark):
    assert one(spark, "vendor/a.go", lambda c: X.ignored(c, ["vendor/"]))
    assert not one(spark, "a/vendor/b.go", lambda c: X.ignored(c, ["vendor/"]))
    assert one(spark, "a/b/id.pem", lambda c: X.ignored(c, ["*.pem"]))


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("readFile", ["readfile", "read", "file"]), ("json-rpc/v1", ["json-rpc", "json", "rpc", "v1"]), ("HTTPServer", ["httpserver", "http", "server"]), ("a b", []), ("read_file x1y", ["read_file", "read", "file", "x1y"]), ("pkg.Type.Method", ["pkg", "type", "method"]), ("", [])],
)
def test_code_tokens(spark, text, tokens):
    assert one(spark, text, X.code_tokens) == tokens


def test_words(spark):
    assert one(spark, "How does the Cache evict OLD-entries, and why?", X.keywords) == ["does", "cache", "evict", "old", "entries"]
    assert one(spark, "  Why SQLite (vec)? ", X.slugify) == "why-sqlite-vec"
    assert one(spark, "---", X.slugify) == "section"
    assert one(spark, None, X.collapse_whitespace) == ""
    assert one(spark, "Foo calls NewBar and FOO and Foo", X.pascal_symbols) == ["Foo", "NewBar"]
    assert one(spark, "cache miss", lambda c: X.expand_aliases(c, {"cache": ["lru", "evict"], "none": ["x"]})) == "cache miss [aliases: evict, lru]"


def test_identities(spark):
    content = hashlib.sha256(b"body").hexdigest()
    want = hashlib.sha256(f"f.go\n3:9\n{content}".encode()).hexdigest()
    got = spark.range(1).select(X.chunk_id(F.lit("f.go"), F.lit(3), F.lit(9), X.content_hash(F.lit("body"))).alias("y")).first().y
    assert got == want


def test_snippets(spark):
    text = "\nfunc A() {\n\n  x\n  y\n  z\n}"
    assert one(spark, text, X.signature_only) == "func A() {"
    assert one(spark, text, lambda c: X.signature_with_context(c, 2)) == "\nfunc A() {\n  x"
    assert one(spark, "a\nb\nc", lambda c: X.header_text(c, 2)) == "a\nb"
    assert one(spark, "x" * 100, lambda c: X.truncate_bytes(c, 50)) == "x" * (50 - len(X.TRUNCATED)) + X.TRUNCATED


def test_windows_cover_all_lines(spark):
    rng = random.Random(1)
    for _ in range(5):
        lines = ["y" * rng.randrange(0, 60) for _ in range(rng.randrange(1, 80))]
        rows = spark.createDataFrame([("\n".join(lines),)], "x string").select(F.explode(X.line_windows(F.col("x"), 50)).alias("w")).select("w.*").collect()
        assert [x for r in rows for x in r.body.split("\n")] == lines
        assert [(r.from_line, r.to_line) for r in rows][0][0] == 1 and rows[-1].to_line == len(lines)


def test_redaction(spark):
    patterns = [("num", "[0-9]{4,}", "redact"), ("stop", "SECRET", "block")]
    r = one(spark, "a 12345 b 999999", lambda c: X.redact(c, patterns))
    assert (r.status, r.text, r.redactions) == ("redacted", "a [REDACTED:num] b [REDACTED:num]", 2)
    r = one(spark, "SECRET 12345", lambda c: X.redact(c, patterns))
    assert (r.status, r.text, r.blocked_by) == ("blocked", "", "stop")
    assert one(spark, "fine", lambda c: X.redact(c, patterns)).status == "clean"


def test_vectors(spark):
    row = spark.range(1).select(
        X.fnv1a(F.lit("hello")).alias("h"), X.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("c"), X.l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("d"),
        X.truncate_vector(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2).alias("t"), X.pool(F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("m"),
    ).first()
    assert row.h == 1335831723 and row.c == 0 and row.d == 5 and row.t == [0.6, 0.8]
    assert row.m == pytest.approx([2**-0.5] * 2)
