"""Rules that code states, conventions that packages follow, and the policy that paths fall under."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from stratalex.functions import exprs as X
from stratalex.operators import ranges
from stratalex.sources import golang

REF = "struct<chunk_id:string,tier:int,marker:string>"
GUIDANCE = "struct<also_review:array<string>,required_tests:array<string>,watch_out:array<string>>"
COUNTERS = ("new_constructors", "test_files", "table_driven", "testify_uses", "mutexes", "channels", "errgroup_uses", "file_count")


def _mapped(files, scan, columns, key, text):
    """Rows of scan(path, text) for each file; a batch's files are independent of each other."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = [(p, *r) for p, t in zip(b[key], b[text]) for r in scan(p, t)]
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in columns]])

    own = files.select(F.coalesce(key, F.lit("")).alias(key), X.text(F.col(text)).alias(text))
    return own.mapInPandas(run, f"`{key}` string, {', '.join(columns)}")


# invariants


def invariants(files, key="path", text="text", most=golang.TIER3_PER_FILE):
    """(path, tier, marker, start_line, end_line, text) of the rules that Go files state: marked comments (1, 2) and calls (3)."""
    columns = ["tier int", "marker string", "start_line int", "end_line int", "text string"]
    return _mapped(files, lambda p, t: golang.invariants(p, t, most), columns, key, text)


def invariant_chunks(rules, commit=""):
    """Chunks of rules: (chunk_id, file, start_line, end_line, ..., tier)."""
    out = rules.select(
        F.col("path").alias("file"), "start_line", "end_line", F.lit("go").alias("language"), F.lit("invariant").alias("chunk_kind"),
        F.col("marker").alias("symbol_name"), F.lit("Invariant").alias("symbol_kind"), F.lit(commit).alias("commit_hash"),
        F.lit("").alias("provenance"), "text", "tier", "marker",
    )
    out = out.withColumn("content_sha256", X.content_hash(F.col("text")))
    return out.withColumn("chunk_id", X.chunk_id(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("content_sha256")))


def attach_invariants(chunks, rules):
    """chunks with `invariants`, the references of the rules within their lines, in the order of lines."""
    ref = F.struct("o.chunk_id", F.col("i.start_line").alias("at"), F.struct(F.col("i.chunk_id").alias("chunk_id"), F.col("i.tier").alias("tier"), F.col("i.marker").alias("marker")).alias("ref"))
    inner = rules.select("chunk_id", "file", "start_line", "end_line", "tier", "marker")
    held = ranges.contained(inner, chunks.select("chunk_id", "file", "start_line", "end_line")).select(ref.alias("x"))
    own = held.groupBy(F.col("x.chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("x.at", "x.ref"))).alias("l"))
    own = own.select("chunk_id", F.transform("l", lambda r: r["ref"]).alias("invariants"))
    none = F.array().cast(f"array<{REF}>")
    return chunks.drop("invariants").join(own, "chunk_id", "left").withColumn("invariants", F.coalesce("invariants", none))


def find_invariants(chunks, file=None, category=None, tier_min=0, tier=None):
    """Rows of kind invariant, by file and category, of tier_min at least (1: all, 3: those found by calls only), in the order of files and lines.

    A row's tier is that of its marker: a curated one, whose name is no marker, counts as 3.
    """
    own = chunks.filter("chunk_kind = 'invariant'")
    if file:
        own = own.filter(F.col("file") == file)
    if category:
        own = own.filter(F.col("category") == category)
    own = own.withColumn("tier", tier_of(F.col("symbol_name")))
    return (own.filter(F.col("tier") >= tier_min) if tier_min > 0 else own).orderBy("file", "start_line", "chunk_id")


def tier_of(marker):
    return X.marker_tier(marker)


def of_tier(rows, tier_min, marker="marker"):
    """rows with their marker's tier, of tier_min at least; 0 keeps all."""
    out = rows.withColumn("tier", tier_of(F.col(marker)))
    return out.filter(F.col("tier") >= tier_min) if tier_min > 0 else out


# policy


def validate_policy(rules):
    """rules: [{"name", "paths", "also_review", "required_tests", "watch_out"}]; raises ValueError where one is malformed."""
    seen = set()
    for i, r in enumerate(rules):
        if not r.get("name"):
            raise ValueError(f"policy: category {i} has no name")
        if r["name"] in seen:
            raise ValueError(f"policy: category {r['name']} occurs twice")
        seen.add(r["name"])
        if not r.get("paths"):
            raise ValueError(f"policy: category {r['name']} has no paths")
    return rules


def classify(chunks, rules, file="file"):
    """chunks with category and guidance of the first rule that one of whose globs matches; none: an empty category, null guidance."""
    name, told = F.lit(""), F.lit(None).cast(GUIDANCE)
    texts = lambda xs: F.array(*[F.lit(x) for x in xs or ()]).cast("array<string>")
    for r in reversed(validate_policy(rules)):
        hit = X.matches_any(F.col(file), r["paths"])
        own = F.struct(*[texts(r.get(k)).alias(k) for k in ("also_review", "required_tests", "watch_out")])
        name, told = F.when(hit, r["name"]).otherwise(name), F.when(hit, own).otherwise(told)
    return chunks.withColumn("category", name).withColumn("guidance", told)


def category_counts(chunks, column="category"):
    return chunks.groupBy(X.text(F.col(column)).alias(column)).agg(F.count("*").alias("n"))


def of_category(rows, category, column="category"):
    """rows of a category; an empty one keeps all."""
    return rows.filter(F.col(column) == category) if category else rows


# conventions


def convention_counts(files, key="path", text="text"):
    """(package, group, name, n) of Go files; group "" holds the plain counters."""
    scan = lambda p, t: [(g, n, c) for (g, n), c in sorted(golang.conventions(p, t).items())]
    rows = _mapped(files, scan, ["group string", "name string", "n bigint"], key, text)
    return rows.groupBy(X.dirname(F.col(key)).alias("package"), "group", "name").agg(F.sum("n").alias("n"))


def convention_stats(counts):
    """One row per package: the eight counters, and the maps errors, loggers and receivers."""
    plain = [F.coalesce(F.sum(F.when((F.col("group") == "") & (F.col("name") == c), F.col("n"))), F.lit(0)).alias(c) for c in COUNTERS]
    own = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("group") == g, F.struct("name", "n"))))).alias(g) for g in ("errors", "loggers", "receivers")]
    return counts.groupBy("package").agg(*plain, *own)


def top_shares(counts):
    """` a=2, b=1 (total=3)` of a map of counts, by count, then name; null for an empty map."""
    rows = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    shown = F.array_join(F.transform(rows, lambda r: F.concat(F.lit(" "), r["k"], F.lit("="), (-r["v"]).cast("string"))), ",")
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda s, n: s + n)
    return F.when(total > 0, F.concat(shown, F.lit(" (total="), total.cast("string"), F.lit(")\n")))


def convention_summary(stats):
    """(package, summary) of convention_stats: what a reader is told about a package."""
    n = lambda c: F.col(c).cast("string")
    parts = [
        F.concat(F.lit("package: "), "package", F.lit(". conventions summary.\n")),
        F.concat(F.lit("errors:"), top_shares(F.col("errors"))), F.concat(F.lit("logger:"), top_shares(F.col("loggers"))),
        F.when(F.col("new_constructors") > 0, F.concat(F.lit("constructors: "), n("new_constructors"), F.lit(" New*\n"))),
        F.when(
            F.col("mutexes") + F.col("channels") + F.col("errgroup_uses") > 0,
            F.concat(F.lit("concurrency: mutex="), n("mutexes"), F.lit(" chan="), n("channels"), F.lit(" errgroup="), n("errgroup_uses"), F.lit("\n")),
        ),
        F.when(
            F.col("test_files") > 0,
            F.concat(F.lit("tests: "), n("test_files"), F.lit(" files, table_driven="), n("table_driven"), F.lit(", testify="), n("testify_uses"), F.lit("\n")),
        ),
    ]
    return stats.select("package", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("summary"))


def convention_chunks(stats, commit=""):
    """One chunk per package: its summary, with the counts."""
    told = convention_summary(stats).join(stats, "package")
    out = told.select(
        X.convention_file(F.col("package")).alias("file"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("go").alias("language"),
        F.lit("convention").alias("chunk_kind"), F.col("package").alias("symbol_name"), F.lit("ConventionSummary").alias("symbol_kind"),
        F.lit(commit).alias("commit_hash"), F.col("summary").alias("text"), F.struct(*COUNTERS, "errors", "loggers", "receivers").alias("convention_stats"),
    )
    out = out.withColumn("content_sha256", X.content_hash(F.col("text")))
    return out.withColumn("chunk_id", X.chunk_id(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("content_sha256")))
