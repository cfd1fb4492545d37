"""Filters over hits: metadata, citations, verification of snippets, freshness and alignment of an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from stratalex.functions import exprs as X

#: Kinds of chunks whose citation names no file of the tree.
SYNTHETIC = ("pr_background", "pr_solution", "commit_message", "convention", "flow_spine")


@dataclass(frozen=True)
class Filter:
    """A filter of chunks: every part that is set must hold. An empty one keeps all."""

    language: str = ""
    commit_hash: str = ""
    path_glob: str = ""
    symbol_kinds: tuple = ()
    chunk_kinds: tuple = ()

    def is_zero(self):
        return self == Filter()

    def condition(self):
        """The filter as a column, or None where it keeps all; the glob's * stays within a segment."""
        parts = []
        if self.language:
            parts.append(F.col("language") == self.language)
        if self.commit_hash:
            parts.append(F.col("commit_hash") == self.commit_hash)
        if self.path_glob:
            parts.append(X.glob_match(F.col("file"), self.path_glob, doublestar=False))
        if self.symbol_kinds:
            parts.append(F.col("symbol_kind").isin(*self.symbol_kinds))
        if self.chunk_kinds:
            parts.append(F.col("chunk_kind").isin(*self.chunk_kinds))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def apply(self, chunks):
        own = self.condition()
        return chunks if own is None else chunks.filter(own)


def threshold(hits, t, score="normalized"):
    """(hits that reach t, one row: kept, dropped, warning): 0 means 0.4, a negative t keeps all."""
    kept = hits if t < 0 else hits.filter(F.col(score) >= (t or 0.4))
    low = F.lit(False) if t < 0 else F.col(score) < (t or 0.4)
    told = hits.agg(F.count_if(~low).alias("kept"), F.count_if(low).alias("dropped"))
    none = (F.col("kept") == 0) & (F.col("dropped") > 0)
    return kept, told.withColumn("warning", F.when(none, "all_results_below_threshold").otherwise(""))


# citations


def is_synthetic(kind, provenance):
    return kind.isin(*SYNTHETIC) | ((kind == "invariant") & (provenance == "curated"))


def line_counts(files, key="path", text="text"):
    """(file, lines): lines of each file, the last one with or without its end; none of an empty file."""
    t = X.text(F.col(text))
    ends = F.char_length(t) - F.char_length(F.replace(t, F.lit("\n"), F.lit("")))
    return files.select(F.col(key).alias("file"), F.when(t == "", 0).otherwise(ends + (~t.endswith("\n")).cast("int")).cast("int").alias("lines"))


def cited(hits, file_lines, head=""):
    """hits with verified and stale.

    file_lines: (file, lines) of the tree and the documents' roots. A citation
    holds if its file is among them and its lines are in order; chunks of
    synthetic kinds always hold. It is stale if its commit isn't head, or if it
    is a flow's step beyond its file's end.
    """
    own = hits.withColumn("_kind", X.text(F.col("chunk_kind"))).withColumn("_prov", X.text(F.col("provenance")) if "provenance" in hits.columns else F.lit(""))
    known = file_lines.groupBy("file").agg(F.max("lines").alias("_lines"))
    both = own.join(known, "file", "left")
    ordered = (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line"))
    holds = is_synthetic(F.col("_kind"), F.col("_prov")) | ((F.col("file") != "") & ordered & F.col("_lines").isNotNull())
    drift = (F.lit(head) != "") & (X.text(F.col("commit_hash")) != "") & (F.col("commit_hash") != head)
    beyond = (F.col("_kind") == "flow_step") & (F.col("start_line") >= 1) & (F.col("start_line") > F.col("_lines"))
    out = both.withColumn("verified", F.coalesce(holds, F.lit(False))).withColumn("stale", F.coalesce(drift | beyond, F.lit(False)))
    return out.select(*hits.columns, "verified", "stale")


def enforce_citations(hits, file_lines, head=""):
    """(hits whose citation holds, with stale; one row: kept, dropped, stale). Without file_lines all hits stay."""
    if file_lines is None:
        all_ = hits.withColumn("stale", F.lit(False))
        return all_, all_.agg(F.count("*").alias("kept"), F.lit(0).cast("bigint").alias("dropped"), F.lit(0).cast("bigint").alias("stale"))
    told = cited(hits, file_lines, head)
    stats = told.agg(F.count_if("verified").alias("kept"), F.count_if(~F.col("verified")).alias("dropped"), F.count_if(F.col("verified") & F.col("stale")).alias("stale"))
    return told.filter("verified").drop("verified"), stats


def verify_snippets(hits, files, snippet="snippet", key="path", text="text"):
    """hits with verified and reason: file_missing, out_of_range, snippet_not_found, or empty.

    A snippet must occur, white space aside, within the lines that its hit
    cites. Without files the reason is no_src_root.
    """
    if files is None:
        return hits.withColumn("verified", F.lit(False)).withColumn("reason", F.lit("no_src_root"))
    own = files.select(F.col(key).alias("file"), X.lines(F.col(text)).alias("_lines"))
    both = hits.join(own, "file", "left")
    start, end = F.col("start_line"), F.col("end_line")
    cut = F.array_join(F.slice("_lines", start, F.greatest(end - start + 1, F.lit(0))), "\n")
    found = F.contains(X.collapse_whitespace(cut), X.collapse_whitespace(F.col(snippet)))
    wrong = (start < 1) | (end > F.size("_lines")) | (end < start)
    # the lines are cut where they exist only
    reason = F.when(F.col("_lines").isNull(), "file_missing").when(wrong, "out_of_range").when(found, "").otherwise("snippet_not_found")
    out = both.withColumn("reason", reason).withColumn("verified", F.col("reason") == "")
    return out.select(*hits.columns, "verified", "reason")


# freshness and alignment


def freshness(indexed_head, current_head, changed=()):
    """{"indexed_head", "current_head", "stale", "fresh", "changed_files", "warnings"} of an index against its tree."""
    out = {"indexed_head": indexed_head, "current_head": current_head, "stale": False, "fresh": False, "changed_files": [], "warnings": []}
    if not current_head:
        out["warnings"].append("git_unavailable")
    elif not indexed_head:
        out["warnings"].append("indexed_head_missing")
    else:
        out["stale"] = current_head != indexed_head
        out["fresh"] = not out["stale"]
        out["changed_files"] = sorted(changed) if out["stale"] else []
    return out


def alignment(rows):
    """rows (recorded_commit, current_commit, recorded_digest, current_digest, schema_version, path, readable) with status, reason and serviceable.

    not_aligned: nothing was recorded (a null path); degraded: it can't be told
    in full; mismatch: the graph is unreadable or another one; ok.
    """
    text = lambda c: X.text(F.col(c))
    differ = lambda a, b: (text(a) != "") & (text(b) != "") & (text(a) != text(b))
    version = X.major_minor(F.col("schema_version"))
    old = version.isNotNull() & ~((version["major"] > 1) | ((version["major"] == 1) & (version["minor"] >= 19)))
    bare = (text("recorded_digest") == "") | (text("current_digest") == "")
    commit = F.concat(F.lit("commit changed: aligned "), X.short_sha(F.col("recorded_commit")), F.lit(", now "), X.short_sha(F.col("current_commit")))
    steps = [
        (F.col("path").isNull(), "not_aligned", F.lit("")), (F.col("path") == "", "degraded", F.lit("path not recorded")),
        (~F.col("readable"), "mismatch", F.lit("graph unreadable")), (differ("recorded_commit", "current_commit"), "mismatch", commit),
        (differ("recorded_digest", "current_digest"), "mismatch", F.lit("digest changed")),
    ]
    status, reason = F.when(bare | old, "degraded").otherwise("ok"), F.lit("")
    for when, name, why in reversed(steps):
        status, reason = F.when(when, name).otherwise(status), F.when(when, why).otherwise(reason)
    warn = F.array_compact(F.array(F.when(bare, "digest unavailable"), F.when(old, "schema below 1.19")))
    out = rows.withColumn("status", status).withColumn("reason", reason)
    out = out.withColumn("warnings", F.when(F.col("status").isin("ok", "degraded") & (F.col("path") != ""), warn).otherwise(F.array().cast("array<string>")))
    return out.withColumn("serviceable", F.col("status") != "mismatch")
