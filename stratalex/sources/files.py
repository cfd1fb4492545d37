"""Source trees and the records beside them: files, markdown sections, diffs, flow and pull-request records."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import exprs as X

MAX_BYTES = 1 << 20
#: Directories that a walk leaves out, and files that may hold secrets.
IGNORED = (".git/", "node_modules/", "vendor/", ".next/", "out/", "dist/", "build/", "target/", ".venv/", "__pycache__/")
SECRETS = (
    ".env", ".env.local", ".env.development", ".env.development.local", ".env.test", ".env.test.local", ".env.staging",
    ".env.staging.local", ".env.production", ".env.production.local", "*.pem", "*.key", "*.p12", "*.pfx", "*.keystore",
    "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*", "id_ecdsa", "id_ecdsa.*", "id_dsa", "id_dsa.*", "credentials.json",
    "service-account*.json", ".npmrc", ".pypirc", ".netrc", ".aws/credentials", ".aws/config",
)
#: The file at a tree's root that adds patterns of its own, one a line.
IGNORE_FILE = ".indexignore"


def ignore_file(spark, root):
    """Patterns of the tree's ignore file; blank lines and those that begin with # say nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{IGNORE_FILE}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    # Spark's readers leave out files whose names begin with a dot
    stream = fs.open(path)
    found = (x.strip() for x in spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines())
    stream.close()
    return [x for x in found if x and not x.startswith("#")]


def walk(spark, root, ignore=None, include=None, exclude=(), max_bytes=MAX_BYTES, languages=None, build_files=None):
    """(path, language, size, content, text) of a tree's text files in known languages.

    ignore: patterns (by default IGNORED, SECRETS and the tree's ignore file);
    exclude wins over include; languages: the ones to keep; build_files: a
    table (path) of the Go files that a build takes, and only those are kept of
    Go files. Links to directories aren't followed by the file source.
    """
    ignore = [*IGNORED, *SECRETS, *ignore_file(spark, root)] if ignore is None else ignore
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", r"^(file:)?/*" + X.re.escape(base.lstrip("/")) + "/", "")
    own = raw.select(rel.alias("path"), F.col("length").alias("size"), "content").filter(F.col("size") <= max_bytes)
    own = own.filter(~X.ignored(F.col("path"), ignore)).withColumn("language", X.language_of(F.col("path"))).filter("language <> ''")
    if languages:
        own = own.filter(F.col("language").isin(list(languages)))
    if exclude:
        own = own.filter(~X.matches_any(F.col("path"), exclude))
    if include:
        own = own.filter(X.matches_any(F.col("path"), include))
    if build_files is not None:
        own = within_build(own, build_files)
    return own.filter(~F.contains(F.substring("content", 1, 8192), F.lit(b"\0"))).withColumn("text", F.col("content").cast("string"))


def within_build(files, build_files):
    """Files that aren't Go, and the Go files that build_files (path) names."""
    go = files.filter("language = 'go'").join(build_files.select("path").distinct(), "path", "left_semi")
    return files.filter("language <> 'go'").unionByName(go.select(*files.columns))


def docs_roots(spark, roots, **options):
    """Markdown files of further trees: (path, language, size, content, text, category)."""
    out = None
    for root in roots:
        own = walk(spark, root, languages=["markdown"], **options).withColumn("category", F.lit("domain"))
        out = own if out is None else out.unionByName(own)
    return out


def is_fence(line):
    return line.rlike(r"^[ \t]*(```|~~~)")


def heading_text(line):
    """The text of an ATX heading line, or null: one to six signs after at most three spaces, a space, and some text."""
    found = F.regexp_extract(line, r"^ {0,3}#{1,6}[ \t](.*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(found, r"^\s+|\s+$", ""), r"#+$", "")
    bare = F.regexp_replace(bare, r"\s+$", "")
    return F.when(bare != "", bare)


def markdown_sections(docs, key, text="text"):
    """Sections by ATX headings outside fences: key, name, heading, slug, start_line, end_line, body.

    name is the heading's slug; "preamble" for what comes before the first
    heading, if it isn't blank; "untitled" for a text without headings. A text
    without lines has no sections. slug is name, for callers that ask for it.
    """
    body = F.regexp_replace(X.text(F.col(text)), "\r\n?", "\n")
    lines = F.split(F.regexp_replace(body, r"\n\z", ""), "\n", -1)
    rows = docs.filter(X.text(F.col(text)) != "").select(key, F.posexplode(lines).alias("n", "line"))
    upto = Window.partitionBy(key).orderBy("n")
    fence = is_fence(F.col("line"))
    told = rows.withColumn("inside", F.sum(fence.cast("int")).over(upto) % 2 == 1)
    told = told.withColumn("name", F.when(~F.col("inside") & ~fence, heading_text(F.col("line"))))
    told = told.withColumn("sect", F.count("name").over(upto))
    # a section's lines belong to one document
    own = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    out = told.groupBy(key, "sect").agg(
        F.max("name").alias("heading"), (F.min("n") + 1).alias("start_line"), (F.max("n") + 1).alias("end_line"),
        F.concat(F.array_join(own, "\n"), F.lit("\n")).alias("body"), F.max((F.trim("line") != "") & ~F.col("line").rlike(r"^\s*$")).alias("filled"),
    )
    last = F.max("sect").over(Window.partitionBy(key))
    out = out.withColumn("last", last)
    name = F.when(F.col("sect") > 0, X.slugify(F.col("heading"))).when(F.col("last") == 0, "untitled").otherwise("preamble")
    out = out.withColumn("name", name).filter((F.col("sect") > 0) | (F.col("last") == 0) | F.col("filled"))
    return out.select(key, "name", "heading", F.col("name").alias("slug"), "start_line", "end_line", "body")


def section_kind(path):
    """ADRSection for a file named adr-... or under a directory adr, else DocSection."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    folder = F.exists(F.split(X.dirname(path), "/"), lambda s: F.lower(s) == "adr")
    return F.when(base.startswith("adr-") | folder, "ADRSection").otherwise("DocSection")


def expand_diff(lines, key, line="line"):
    """(key, op, path) of `git diff --name-status` lines: renames are a deletion and an addition, copies additions, type changes modifications."""
    part = F.split(line, "\t")
    kind, one, two = F.substring(F.get(part, F.lit(0)), 1, 1), F.get(part, F.lit(1)), F.get(part, F.lit(2))
    row = lambda op, p: F.struct(F.lit(op).alias("op"), p.alias("path"))
    ops = (
        F.when(kind == "A", F.array(row("A", one))).when(kind.isin("M", "T"), F.array(row("M", one))).when(kind == "D", F.array(row("D", one)))
        .when(kind == "R", F.array(row("D", one), row("A", two))).when(kind == "C", F.array(row("A", two)))
    )
    return lines.select(key, F.explode(ops).alias("x")).select(key, "x.op", "x.path")


#: The fields of a flow corpus' records.
FLOW = """type STRING, id STRING, entry_point STRING, `trigger` STRING, summary STRING, root_symbol STRING, links ARRAY<STRING>, called_by ARRAY<STRING>, flow STRING,
symbol STRING, file STRING, line INT, kind STRING, calls ARRAY<STRING>, reads STRING, writes STRING, emits STRING, branches ARRAY<STRUCT<`when`:STRING, `then`:STRING, at:STRING>>,
invariants ARRAY<STRING>, prose STRING, domain STRING, title STRING, statement STRING, assumes STRING, `check` STRING, enforced_at ARRAY<STRUCT<flow:STRING, step:STRING, loc:STRING>>, _bad STRING"""


def flow_records(spark, path):
    """Records of a flow corpus (JSON lines); malformed lines have `_bad` set."""
    return spark.read.schema(FLOW).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def flow_records_of(lines, column="value"):
    """Records of a table of JSON lines; malformed ones have `_bad` set, further columns stay."""
    told = F.from_json(column, FLOW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("_r", told).select(*[c for c in lines.columns if c != column], "_r.*")


def pull_requests(spark, path, since=None, limit=100):
    """(repo, pr_number, title, body, commit_messages, changed_files, merged_at) of prefetched JSON lines.

    since: the earliest day of merging; limit: so many of the latest are kept (None: all).
    """
    schema = "repo STRING, pr_number INT, title STRING, body STRING, commit_messages ARRAY<STRING>, changed_files ARRAY<STRING>, merged_at STRING"
    prs = spark.read.schema(schema).json(path)
    if since:
        prs = prs.filter(F.col("merged_at").cast("timestamp") >= F.lit(since).cast("timestamp"))
    return prs if limit is None else prs.orderBy(F.desc("pr_number"), "repo").limit(limit)


def commit_message(headline, body):
    """Headline and body of a commit with an empty line between, or the one that isn't blank, or null."""
    head, rest = (F.regexp_replace(X.text(x), r"^\s+|\s+$", "") for x in (headline, body))
    both = F.concat(head, F.when((head != "") & (rest != ""), "\n\n").otherwise(""), rest)
    return F.when(both != "", both)


def pr_breadcrumbs(prs):
    """(file, recent_prs: array of (number, title, merged_at_utc)) of the files that pull requests changed, in the order of numbers."""
    at = F.date_format(F.to_utc_timestamp(F.col("merged_at").cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ref = F.named_struct(F.lit("number"), F.col("pr_number"), F.lit("title"), F.col("title"), F.lit("merged_at_utc"), at)
    each = prs.select(F.explode("changed_files").alias("file"), ref.alias("ref")).filter("file <> ''")
    return each.groupBy("file").agg(F.array_sort(F.collect_list("ref")).alias("recent_prs"))


def pr_cutoff(prs):
    """One row: repo, last_pr_number, last_merged_at of a set of pull requests (no row of an empty set has a number)."""
    latest = F.max(F.col("merged_at").cast("timestamp"))
    shown = F.date_format(F.to_utc_timestamp(latest, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return prs.agg(F.min_by("repo", "pr_number").alias("repo"), F.max("pr_number").alias("last_pr_number"), shown.alias("last_merged_at"))


def pr_chunks(prs):
    """Background, solution and commit-message chunks of pull requests."""
    body = X.text(F.col("body"))
    part = lambda line, kind, text: F.struct(F.lit(line).alias("start_line"), F.lit(kind).alias("chunk_kind"), text.alias("text"))
    commits = F.array_join(F.coalesce("commit_messages", F.array().cast("array<string>")), "\n\n---\n\n")
    parts = F.array(
        part(1, "pr_background", X.pr_section(body, ["background"])),
        part(2, "pr_solution", X.pr_section(body, ["solution", "changes", "approach"])), part(3, "commit_message", commits),
    )
    file = F.concat(F.lit("pr/"), "repo", F.lit("#"), F.col("pr_number").cast("string"))
    out = prs.select(file.alias("file"), F.col("title").alias("symbol_name"), F.col("merged_at").alias("commit_hash"), F.explode(parts).alias("p"))
    out = out.filter("p.text <> ''")
    out = out.select("file", "symbol_name", "commit_hash", F.lit("markdown").alias("language"), F.lit("DocSection").alias("symbol_kind"), "p.*")
    out = out.withColumn("end_line", F.col("start_line")).withColumn("content_sha256", X.content_hash(F.col("text")))
    return out.withColumn("chunk_id", X.chunk_id(F.col("file"), F.col("start_line"), F.col("end_line"), F.col("content_sha256")))


def symbol_nodes(nodes):
    """Nodes (id, file, start_line, end_line, canonical_id) of a symbol graph that stand for code: with a file and a line, no files, hunks or imports."""
    own = nodes.filter((X.text(F.col("file")) != "") & (F.col("start_line") > 0))
    for kind in ("file:", "hunk:", "import:"):
        own = own.filter(~F.col("id").startswith(kind))
    return own


def footprint(spark, path):
    """Events (ts, schema_version, event, trace_id, run_id, latency_ms, error, fields) of JSON lines."""
    schema = "ts STRING, schema_version STRING, event STRING, trace_id STRING, run_id STRING, latency_ms BIGINT, error STRING, fields MAP<STRING,STRING>"
    return spark.read.schema(schema).json(path)


def write_footprint(events, path):
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def git_head(repo):
    """The commit of a checked-out repository, or an empty text."""
    done = subprocess.run(["git", "-C", repo, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else ""


def git_log(spark, repo, paths, n=5):
    """(file, history: array of (commit, author_time, subject)) of the given files; the driver asks git for each file once."""
    rows = []
    for p in sorted(set(paths)):
        done = subprocess.run(["git", "-C", repo, "log", f"-n{n}", "--format=%H%x09%aI%x09%s", "--", p], capture_output=True, text=True)
        rows.append((p, [tuple(x.split("\t", 2)) for x in done.stdout.splitlines() if x.count("\t") >= 2]))
    return spark.createDataFrame(rows, "file string, history array<struct<commit:string,author_time:string,subject:string>>")


def git_diff(spark, repo, since, head="HEAD"):
    """Changed paths of a checked-out repository; the driver asks git, whose answer is a list of paths."""
    out = subprocess.run(["git", "-C", repo, "diff", "--name-status", since, head], capture_output=True, text=True, check=True).stdout
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(out.splitlines())], "n int, line string")
    return expand_diff(rows, "n").drop("n")


def load_patterns(path):
    """(id, regex, action) of a JSON pattern file; patterns that don't compile are left out."""
    out = []
    with open(path, encoding="utf-8") as f:
        for p in json.load(f).get("patterns", []):
            try:
                X.re.compile(p["regex"])
            except X.re.error:
                continue
            out.append((p["id"], p["regex"], p.get("action", "")))
    return out
