"""Build, reindex and search: the operators put together over snapshots.

An index holds `chunks` and `vectors`, keyed by chunk_id, `file_lines`, the
lines of each indexed file, and the postings of its keyword index. A build
reads a tree, cuts files into chunks, adds the layers (pull requests,
conventions, documents of further roots, flows), embeds all and publishes a
new version after the checks of store.validate; a reindex purges changed files
and replaces them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalex.functions import exprs as X
from stratalex.operators import evaluate, filters, flows, postings, ranges, rules, scratch, search, store
from stratalex.sources import files, parsers

DIM = 64
IDENTITY = f"provider=hash;model=fnv1a;dim={DIM};pooling=sum;normalize=l2"
CODE_KINDS = ("symbol", "function_split", "file_header", "file_full", "doc")
#: Bytes to which a text that an embedder refuses is cut, one after the other.
RETRY_BYTES = (12_000, 4_000)


# embedding


def feature_hash(text):
    """Unit vector of word counts: each lower-cased word falls into the slot of its 32-bit FNV-1a over UTF-8."""

    def slot(w):
        raw = F.hex(F.encode(w, "utf-8"))
        at = F.sequence(F.lit(1), F.length(raw), F.lit(2))
        byte = F.transform(at, lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("bigint"))
        return F.aggregate(byte, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295))) % DIM

    # an array around the slots binds them, so that they are worked out once and not for each place
    slots = F.array(F.transform(X.plain_words(text), slot))
    counts = F.transform(slots, lambda own: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double")))
    return F.get(F.transform(counts, X.unit), F.lit(0))


@dataclass(frozen=True)
class Embedder:
    """What an embedding model is to the engine: its identity, and vectors of texts in batches.

    embed: a function of a list of texts to a list of vectors, called on
    executors; column: a function of a column to a column, for models that
    Spark expresses itself. One of the two is set.
    """

    provider: str
    model: str
    dimension: int
    pooling: str = "sum"
    normalize: str = "l2"
    max_tokens: int = 512
    batch: int = 32
    embed: Callable | None = None
    column: Callable | None = None
    query_prompt: str = ""

    @property
    def identity(self):
        return f"provider={self.provider};model={self.model};dim={self.dimension};pooling={self.pooling};normalize={self.normalize}"

    def vectors(self, rows, id_="chunk_id", text="text"):
        """(id, embedding) of rows; texts that the model refuses at every length have no row."""
        if self.column is not None:
            return rows.select(id_, self.column(F.col(text)).alias("embedding"))
        embed, size, dim = self.embed, self.batch, self.dimension

        def run(batches: Iterator[pd.DataFrame]):
            for b in batches:
                got = []
                for i in range(0, len(b), size):
                    part = b.iloc[i : i + size]
                    got += embed_resilient(embed, list(zip(part[id_], part[text])))
                if any(len(v) != dim for _, v in got):
                    raise ValueError(f"the model gave vectors of another dimension than {dim}")
                yield pd.DataFrame(got, columns=[id_, "embedding"])

        kind = dict(rows.dtypes)[id_]
        # equal texts are embedded once
        own = rows.select(id_, F.col(text), F.sha2(X.text(F.col(text)), 256).alias("_sha"))
        once = own.groupBy("_sha").agg(F.min_by(text, id_).alias(text)).withColumnRenamed("_sha", id_)
        made = once.mapInPandas(run, f"`{id_}` string, embedding array<float>").withColumnRenamed(id_, "_sha")
        return own.join(made, "_sha").select(F.col(id_).cast(kind), "embedding")

    def query(self, spark, text):
        """The vector of a query's text."""
        own = self.query_prompt + text
        if self.column is not None:
            return list(spark.createDataFrame([(own,)], "x string").select(self.column(F.col("x")).alias("v")).first().v)
        return [float(x) for x in self.embed([own])[0]]


def cut_bytes(text, most):
    """At most so many bytes of a text; a character that the cut would split is left out."""
    raw = text.encode()
    return text if len(raw) <= most else raw[:most].decode(errors="ignore")


def embed_resilient(embed, rows):
    """[(id, vector)] of [(id, text)]: a batch that fails is halved; a single text is tried whole, then cut; what fails still is left out.

    If the model refuses even a plain word, its error is raised: it is down.
    """
    if not rows:
        return []
    try:
        return [(i, v) for (i, _), v in zip(rows, embed([t for _, t in rows]), strict=True)]
    except Exception:
        if len(rows) > 1:
            half = len(rows) // 2
            return embed_resilient(embed, rows[:half]) + embed_resilient(embed, rows[half:])
        embed(["ok"])
    (i, t), tried = rows[0], None
    for most in (len(t.encode()), *RETRY_BYTES):
        own = cut_bytes(t, most)
        if own != tried:
            try:
                return [(i, embed([own])[0])]
            except Exception:
                tried = own
    return []


class CachedEmbed:
    """A function of texts to vectors that remembers the last `size` texts it was given."""

    def __init__(self, embed, size=1024):
        self.embed, self.size, self.held = embed, size, OrderedDict()
        self.hits = self.misses = 0

    def __call__(self, texts):
        new = [t for t in dict.fromkeys(texts) if t not in self.held]
        self.misses += len(new)
        self.hits += len(texts) - len(new)
        fresh = dict(zip(new, self.embed(new), strict=True)) if new else {}
        out = [fresh[t] if t in fresh else self.held[t] for t in texts]
        for t, v in zip(texts, out):
            self.held[t] = v
            self.held.move_to_end(t)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return out


HASH = Embedder("hash", "fnv1a", DIM, column=feature_hash)


# chunks

BLANK = {"canonical_id": "", "category": "", "provenance": "", "commit_hash": "", "symbol_name": "", "symbol_kind": "", "is_test": False}
COLUMNS = {
    "chunk_id": "string", "file": "string", "start_line": "int", "end_line": "int", "language": "string", "is_test": "boolean", "symbol_name": "string",
    "symbol_kind": "string", "chunk_kind": "string", "commit_hash": "string", "content_sha256": "string", "canonical_id": "string",
    "recent_prs": "array<struct<number:int,title:string,merged_at_utc:string>>", "category": "string", "guidance": rules.GUIDANCE,
    "invariants": f"array<{rules.REF}>",
    "convention_stats": "struct<" + ",".join(f"{c}:bigint" for c in rules.COUNTERS) + ",errors:map<string,bigint>,loggers:map<string,bigint>,receivers:map<string,bigint>>",
    "text": "string", "flow_spine": "struct<flow_id:string,entry_point:string,trigger:string,root_symbol:string,links:array<string>,called_by:array<string>>",
    "flow_step": "struct<flow_id:string,step_id:string,symbol:string,kind:string,calls:array<string>,reads:string,writes:string,emits:string,"
    "branches:array<struct<when:string,then:string,at:string>>,invariants:array<string>>",
    "enforced_at": "array<struct<flow:string,step:string,loc:string>>", "provenance": "string", "ord": "bigint",
}


def in_shape(rows):
    """rows with all columns of a chunk; missing ones are empty or null."""
    have = set(rows.columns)
    own = lambda c, t: F.col(c).cast(t) if c in have else F.lit(BLANK.get(c)).cast(t)
    return rows.select(*[(F.coalesce(own(c, t), F.lit(BLANK[c])) if c in BLANK else own(c, t)).alias(c) for c, t in COLUMNS.items()])


def with_ids(rows, content="content", start=None):
    """rows with content_sha256 of `content` and the chunk_id that follows from it."""
    out = rows.withColumn("content_sha256", X.content_hash(F.col(content)))
    at = F.col("start_line") if start is None else start
    return out.withColumn("chunk_id", X.chunk_id(F.col("file"), at, F.col("end_line"), F.col("content_sha256"))).drop(content)


def symbol_chunks(spans, max_tokens=512):
    """Chunks of (path, language, name, kind, start_line, end_line, body): one each, long functions in windows of lines."""
    windows = X.line_windows(F.col("body"), max_tokens)
    split = (F.size(windows) > 1) & F.col("kind").isin("Function", "Method")
    whole = F.array(F.struct(F.lit(0).alias("from_line"), F.lit(0).alias("to_line"), X.truncate_bytes(F.col("body"), max_tokens * 4).alias("body")))
    each = spans.withColumn("cut", split).select("*", F.posexplode(F.when(split, windows).otherwise(whole)).alias("no", "w"))
    number = (F.col("no") + 1).cast("string")
    out = each.select(
        F.col("path").alias("file"), "language", F.when(F.col("cut"), F.concat("name", F.lit(":chunk:"), number)).otherwise(F.col("name")).alias("symbol_name"),
        F.col("kind").alias("symbol_kind"), F.when(F.col("cut"), "function_split").otherwise("symbol").alias("chunk_kind"),
        F.when(F.col("cut"), F.col("start_line") + F.col("w.from_line") - 1).otherwise(F.col("start_line")).alias("start_line"),
        F.when(F.col("cut"), F.col("start_line") + F.col("w.to_line") - 1).otherwise(F.col("end_line")).alias("end_line"), F.col("w.body").alias("text"),
    )
    return with_ids(out.withColumn("content", F.col("text")))


def header_chunks(tree, header_lines=50, max_tokens=512):
    """The first lines of each file that isn't markdown; the hash is that of the lines, before they are cut to size."""
    own = tree.filter("language <> 'markdown'").withColumn("content", X.header_text(F.col("text"), header_lines)).filter(X._filled(F.col("content")))
    out = own.select(
        F.col("path").alias("file"), "language", F.lit("FileHeader").alias("symbol_kind"), F.lit("file_header").alias("chunk_kind"), F.lit(1).alias("start_line"),
        F.least(F.lit(header_lines), F.size(X.lines(F.col("text")))).alias("end_line"), X.truncate_bytes(F.col("content"), max_tokens * 4).alias("text"), "content",
    )
    return with_ids(out)


def full_chunks(tree, max_tokens=512):
    """Whole files that aren't markdown; their ids are told from a header's by a start of 0."""
    own = tree.filter("language <> 'markdown'").withColumn("content", X.text(F.col("text"))).filter(X._filled(F.col("content")))
    out = own.select(
        F.col("path").alias("file"), "language", F.lit("FileHeader").alias("symbol_kind"), F.lit("file_full").alias("chunk_kind"), F.lit(1).alias("start_line"),
        F.size(X.lines(F.col("text"))).alias("end_line"), X.truncate_bytes(F.col("content"), max_tokens * 4).alias("text"), "content",
    )
    return with_ids(out, start=F.lit(0))


def section_chunks(tree, max_tokens=512):
    """Sections of markdown files."""
    own = files.markdown_sections(tree.filter("language = 'markdown'"), "path")
    out = own.select(
        F.col("path").alias("file"), F.lit("markdown").alias("language"), F.col("name").alias("symbol_name"), files.section_kind(F.col("path")).alias("symbol_kind"),
        F.lit("doc").alias("chunk_kind"), "start_line", "end_line", X.truncate_bytes(F.col("body"), max_tokens * 4).alias("text"),
    )
    return with_ids(out.withColumn("content", F.col("text")))


def chunks_of(tree, max_tokens=512, header_lines=50, commit="", whole_files=False, rule_chunks=True, policy=()):
    """Chunks of (path, language, text) files: symbols, file headers (and whole files), sections, and the rules that Go code states."""
    spans = parsers.symbols(tree.filter("language <> 'markdown'"))
    parts = [symbol_chunks(spans, max_tokens), header_chunks(tree, header_lines, max_tokens), section_chunks(tree, max_tokens)]
    if whole_files:
        parts.append(full_chunks(tree, max_tokens))
    out = reduce(lambda a, b: a.unionByName(b), (in_shape(p) for p in parts))
    if rule_chunks:
        stated = rules.invariant_chunks(rules.invariants(tree.filter("language = 'go'")), commit)
        out = rules.attach_invariants(out, stated).unionByName(in_shape(stated))
    out = rules.classify(out, list(policy)) if policy else out
    out = out.withColumn("is_test", X.is_test_path(F.col("file"), F.col("language"))).withColumn("commit_hash", F.lit(commit))
    return in_shape(out.dropDuplicates(["chunk_id"]))


def vectors_of(chunks, embedder=HASH, prefix=None):
    """(chunk_id, embedding); prefix: a table (chunk_id, prefix) of sentences that stand before a chunk's text instead of the rule's."""
    text = X.embed_text(F.col("chunk_kind"), F.col("language"), F.col("file"), F.col("symbol_name"), F.col("symbol_kind"), F.col("text"))
    own = chunks
    if prefix is not None:
        own = chunks.join(prefix, "chunk_id", "left")
        text = F.when(X.text(F.col("prefix")) != "", F.concat("prefix", F.lit("\n\n"), "text")).otherwise(text)
    return embedder.vectors(own.select("chunk_id", text.alias("text")))


PROMPT = (
    "You index a code base for semantic search. Say in one short sentence what this {language} chunk of \"{file}\" does and which part it plays. "
    "Give the sentence alone, without an introduction or quotes.\n\n{text}"
)


def written_prefixes(chunks, generate, cache=None):
    """(chunk_id, prefix): the first line of what `generate` (a prompt to a text) says of each chunk; none where it fails.

    cache: a table (sha, prefix) of earlier answers by the hash of a chunk's
    text. Chunks of equal text are asked about once.
    """
    sha = F.sha2(X.text(F.col("text")), 256).alias("sha")
    own = chunks.select("chunk_id", sha, "language", "file", "text")
    open_ = own if cache is None else own.join(cache.select("sha"), "sha", "left_anti")
    once = open_.groupBy("sha").agg(F.min_by(F.struct("language", "file", "text"), "chunk_id").alias("c")).select("sha", "c.*")

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    said = generate(PROMPT.format(language=r.language or "code", file=r.file, text=r.text)).strip()
                except Exception:  # the rule's prefix stands in
                    said = ""
                out.append((r.sha, said.split("\n", 1)[0].strip()))
            yield pd.DataFrame(out, columns=["sha", "prefix"])

    told = once.mapInPandas(run, "sha string, prefix string").filter("prefix <> ''")
    told = told if cache is None else told.unionByName(cache.select("sha", "prefix"))
    return own.select("chunk_id", "sha").join(told, "sha").select("chunk_id", "prefix")


# build and reindex


def sound(tables):
    return store.validate(tables["chunks"], tables["vectors"]).first().ok


def layers(spark, commit="", prs=None, flow_records=None, corpus="flow.jsonl", docs=None, max_tokens=512):
    """Chunks beside the code: pull requests, flows, documents of further roots (a table of files)."""
    parts = []
    if prs is not None:
        parts.append(files.pr_chunks(prs))
    if flow_records is not None:
        parts.append(flows.flow_chunks(flow_records, F.lit(corpus)))
    if docs is not None:
        parts.append(section_chunks(docs, max_tokens).withColumn("category", F.lit("domain")))
    return [in_shape(p) for p in parts]


def publish(snaps, chunks, vectors, lines, identity, **told):
    """Publish a version with its keyword index, which is written from the version's own chunks."""
    m = snaps.publish({"chunks": chunks, "vectors": vectors, "file_lines": lines}, check=sound, identity=identity, **told)
    body = snaps.read("chunks").select("chunk_id", F.concat_ws(" ", "symbol_name", "file", "text").alias("text"))
    postings.build(body, f"{snaps.root}/{m['version']}-postings", "chunk_id")
    return m


def build(spark, tree, root, embedder=HASH, prs=None, flow_records=None, docs_roots=(), policy=(), ignore=None, languages=None, include=None, exclude=(), build_files=None, **options):
    """Index a tree as a fresh version; returns the manifest. policy: rules of glossary.load_policy."""
    source = files.walk(spark, tree, ignore=ignore, include=include, exclude=exclude, languages=languages, build_files=build_files)
    code = chunks_of(source, policy=policy, **options)
    if prs is not None:
        crumbs = files.pr_breadcrumbs(prs)
        code = in_shape(store.fill_array_where_empty(code, crumbs, "file", "recent_prs"))
    docs = files.docs_roots(spark, docs_roots) if docs_roots else None
    parts = [code, *layers(spark, prs=prs, flow_records=flow_records, docs=docs)]
    go = source.filter("language = 'go'")
    stats = rules.convention_stats(rules.convention_counts(go))
    parts.append(in_shape(rules.convention_chunks(stats, options.get("commit", ""))))
    chunks = scratch.settle(reduce(lambda a, b: a.unionByName(b), parts).dropDuplicates(["chunk_id"]), "chunks")
    lines = filters.line_counts(source if docs is None else source.select("path", "text").unionByName(docs.select("path", "text")))
    told = {"indexed_head": options.get("commit", "")}
    if prs is not None:
        told["prs"] = files.pr_cutoff(prs).first().asDict()
    return publish(store.Snapshots(spark, root), chunks, vectors_of(chunks, embedder), lines, embedder.identity, **told)


def reindex(spark, tree, root, changes, embedder=HASH, prs=None, ledger=None, **options):
    """A version in which the files of changes (op, path) are purged and those that still exist indexed anew.

    Only chunks cut from the files themselves go; other layers that name the
    same paths stay. Breadcrumbs of the purged files are put on their new
    chunks, and packages with changed Go files get their conventions anew.
    ledger: a table (path, sha) of files that an earlier attempt has done.
    """
    snaps = store.Snapshots(spark, root)
    told = snaps.manifest() or {}
    if told.get("identity") != embedder.identity:
        raise ValueError("the index was built in another embedding space")
    if ledger is not None:
        changes = todo(changes, files.walk(spark, tree), ledger)
    touched = changes.select(F.col("path").alias("file")).distinct()
    old, vec = snaps.read("chunks"), snaps.read("vectors")
    own = F.col("chunk_kind").isin(*CODE_KINDS) | ((F.col("chunk_kind") == "invariant") & (F.col("provenance") == ""))
    code = own & ~((F.col("chunk_kind") == "doc") & (F.col("category") == "domain"))
    packages = touched.filter("file like '%.go'").select(X.convention_file(X.dirname(F.col("file"))).alias("file")).distinct()
    conv = F.col("chunk_kind") == "convention"
    stay = old.filter(~code & ~conv).unionByName(store.delete_by(old.filter(code), touched)).unionByName(store.delete_by(old.filter(conv), packages))
    alive = changes.filter("op <> 'D'").select("path").distinct()
    source = files.walk(spark, tree)
    fresh = chunks_of(source.join(alive, "path", "left_semi"), **options)
    crumbs = old.filter(F.size("recent_prs") > 0).groupBy("file").agg(F.min_by("recent_prs", "chunk_id").alias("recent_prs"))
    fresh = in_shape(store.fill_array_where_empty(fresh, crumbs, "file", "recent_prs"))
    go = source.filter("language = 'go'").withColumn("_package", X.convention_file(X.dirname(F.col("path"))))
    stats = rules.convention_stats(rules.convention_counts(go.join(packages.withColumnRenamed("file", "_package"), "_package", "left_semi")))
    fresh = fresh.unionByName(in_shape(rules.convention_chunks(stats, options.get("commit", ""))))
    if prs is not None:  # those above the cut-off
        since = (told.get("prs") or {}).get("last_pr_number") or 0
        fresh = fresh.unionByName(in_shape(files.pr_chunks(prs.filter(F.col("pr_number") > since))))
    fresh = scratch.settle(fresh.dropDuplicates(["chunk_id"]), "fresh")
    chunks = store.upsert(stay, fresh)
    vectors = store.upsert(vec.join(stay, "chunk_id", "left_semi"), vectors_of(fresh, embedder))
    keep = {k: v for k, v in told.items() if k not in ("version", "schema_version", "identity")}
    if options.get("commit"):
        keep["indexed_head"] = options["commit"]
    return publish(snaps, chunks, vectors, filters.line_counts(source), embedder.identity, **keep)


def todo(changes, tree, ledger):
    """changes without the files that the ledger (path, sha) has with their present content."""
    done = tree.select("path", F.sha2("content", 256).alias("sha")).join(ledger, ["path", "sha"], "left_semi").select("path")
    return changes.join(done, "path", "left_anti").select(*changes.columns)


# search


@dataclass
class Options:
    k: int = 10
    examples_k: int = 3
    threshold: float = 0.0
    budget: int = 4000
    rerank: bool = True
    words: list = field(default_factory=list)
    aliases: dict = field(default_factory=dict)
    flt: object = None
    mode: str = "post"
    package: str = ""
    density: str = "full"
    context_lines: int = 5
    cite: bool = True
    head: str = ""
    overfetch: bool = False


class AllCitationsDropped(LookupError):
    """Every hit cites what isn't there: the index and its tree have parted."""


def condition(flt):
    return flt.condition() if isinstance(flt, filters.Filter) else flt


class Engine:
    """Queries over the served version."""

    def __init__(self, spark, root, embedder=HASH):
        self.snaps = snaps = store.Snapshots(spark, root)
        self.spark, self.told, self.embedder = spark, snaps.manifest(), embedder
        if self.told is None or self.told.get("identity") != embedder.identity:
            raise ValueError("no index of this embedding space")
        self.chunks, self.vectors, self.file_lines = snaps.read("chunks"), snaps.read("vectors"), snaps.read("file_lines")
        self.index = postings.Index(spark, f"{snaps.root}/{self.told['version']}-postings")

    def tokens(self, text):
        return self.spark.createDataFrame([(text,)], "x string").select(X.code_tokens(F.col("x")).alias("t")).first().t

    def embed(self, texts):
        """(text, embedding) of texts."""
        rows = self.spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
        return rows.join(self.embedder.vectors(rows), "chunk_id").orderBy(F.col("chunk_id").cast("int")).select("text", "embedding")

    def near(self, vector, k, flt=None, mode="post"):
        """(chunk_id, distance, normalized, vector_rank) of the nearest chunks; texts aren't read."""
        own = condition(flt)
        pool = self.vectors.join(self.chunks.drop("text"), "chunk_id") if own is not None else self.vectors
        return search.knn(pool, vector, k, own, mode, "chunk_id").select("chunk_id", "distance", "normalized", "vector_rank")

    def vector_search(self, vector, k=10, flt=None, mode="post", overfetch=False):
        """Chunks nearest to a vector, k of them (overfetch: three times as many)."""
        near = self.near(vector, k * (search.OVERFETCH if overfetch else 1), flt, mode)
        return self.chunks.join(F.broadcast(near), "chunk_id").orderBy("vector_rank")

    def search(self, intent, o=None):
        """Hits in order, tests apart: chunk columns, normalized, rank, group_rank, stale, snippet, density, tokens_used."""
        o = o or Options()
        if not (intent or "").strip():
            raise ValueError("an empty intent")
        budget = 4000 if o.budget == 0 else o.budget
        if 0 < budget < 20:
            raise ValueError("a budget below 20 tokens")
        wide = self.spark.createDataFrame([(intent,)], "x string").select(X.expand_aliases(F.col("x"), o.aliases).alias("x")).first().x
        near = self.near(self.embedder.query(self.spark, wide), o.k * search.OVERFETCH, o.flt, o.mode)
        hits = self.chunks.join(F.broadcast(near), "chunk_id")  # a few times k rows; texts are read for these only
        order = "vector_rank"
        if o.rerank:
            hits, order = search.rerank(hits, self.tokens(intent)), "hybrid_rank"
        if o.words or o.package or o.head:
            hits, order = search.boost(hits, o.words, head=o.head, package=o.package), "boost_rank"
            hits = hits.withColumn("normalized", F.col("boosted"))
        hits, _ = filters.threshold(hits, o.threshold)
        hits = scratch.settle(hits, "hits")
        if o.cite:
            kept, stats = filters.enforce_citations(hits, self.file_lines, o.head)
            told = stats.first()
            if told.dropped and not told.kept:
                raise AllCitationsDropped(f"all {told.dropped} hits cite files or lines that aren't there")
            hits = kept
        else:
            hits = hits.withColumn("stale", F.lit(False))
        kept = search.split_tests(hits, o.k, o.examples_k, [order])
        kept = kept.withColumn("rank", F.row_number().over(Window.orderBy("is_test", "group_rank"))).withColumn("query", F.lit(0))
        return search.density(kept, budget if budget > 0 else 2**31 - 1, ctx_lines=o.context_lines, cap=o.density).drop("query")

    def keyword_search(self, query, k=10, flt=None):
        return postings.keyword_search(self.index, self.chunks, self.tokens(query), k, condition(flt))

    def explain(self, chunk_id, intent):
        """One row on one chunk: bm25_score, vector_rank and vector_score (0 beyond the nearest 200), matched tokens, category, guidance."""
        own = self.chunks.filter(F.col("chunk_id") == chunk_id)
        if not own.limit(1).count():
            raise LookupError(f"no chunk {chunk_id}")
        asked = self.tokens(intent)
        near = self.near(self.embedder.query(self.spark, intent), 200)
        score = postings.scored(self.index, asked).filter(F.col("id") == chunk_id).withColumnRenamed("id", "chunk_id")
        both = own.join(score, "chunk_id", "left").join(F.broadcast(near), "chunk_id", "left")
        words = X.code_tokens(F.concat_ws(" ", "symbol_name", "file", "text"))
        asked = F.array(*[F.lit(t) for t in asked]).cast("array<string>")
        return both.select(
            "chunk_id", F.coalesce("score", F.lit(0.0)).alias("bm25_score"), F.coalesce("vector_rank", F.lit(0)).alias("vector_rank"),
            F.coalesce("normalized", F.lit(0.0)).alias("vector_score"), F.coalesce("distance", F.lit(0.0)).alias("distance"),
            search.matched_tokens(asked, words).alias("matched_tokens"), "category", "guidance",
        )

    def narrow(self, ids, flt=None, category=""):
        """The chunks of these ids that a filter and a category keep, in the order of the ids."""
        rows = self.spark.createDataFrame([(c, i) for i, c in enumerate(dict.fromkeys(ids))], "chunk_id string, place int")
        own = condition(flt)
        out = self.chunks.join(F.broadcast(rows), "chunk_id")
        out = out if own is None else out.filter(own)
        return rules.of_category(out, category).orderBy("place").drop("place")

    def expand_in_file(self, chunk_id, before=2, after=2):
        return ranges.neighbours(self.chunks, self.chunks.filter(F.col("chunk_id") == chunk_id), before, after).orderBy("start_line", "chunk_id")

    # lookups

    def by_file(self, file):
        return self.chunks.filter(F.col("file") == file).orderBy("start_line", "chunk_id")

    def files(self):
        return self.chunks.select("file").distinct().orderBy("file")

    def docs(self):
        return self.chunks.filter(store.DOCS_LAYER).orderBy("file", "start_line", "chunk_id")

    def flow_chunks(self):
        return flows.layer(self.chunks).orderBy("file", "start_line", "chunk_id")

    def conventions(self, prefix=""):
        """Convention chunks of packages whose name begins with prefix, whatever its case."""
        return self.chunks.filter((F.col("chunk_kind") == "convention") & F.col("file").ilike(prefix + "%")).orderBy("file", "start_line", "chunk_id")

    def find_invariants(self, file=None, category=None, tier_min=0):
        return rules.find_invariants(self.chunks, file, category, tier_min)

    def related_changes(self, file):
        """(number, title, merged_at_utc) of the pull requests of a file's chunks, each once, latest first."""
        own = self.chunks.filter(F.col("file") == file).select("start_line", "chunk_id", F.posexplode("recent_prs").alias("place", "pr"))
        first = evaluate.dedup_first(own.select("pr.number", "start_line", "chunk_id", "place", "pr.title", "pr.merged_at_utc"), ["number"], ["start_line", "chunk_id", "place"])
        return first.select("number", "title", "merged_at_utc").orderBy(F.desc("merged_at_utc"), F.desc("number"))

    def with_history(self, hits, repo, n=5):
        """hits with history, the last commits of their files; git is asked once for each of a query's files."""
        paths = [r.file for r in hits.select("file").distinct().toLocalIterator()]  # at most k files
        return hits.join(F.broadcast(files.git_log(self.spark, repo, paths, n)), "file", "left")

    # flows

    def get_flow(self, flow_id="", entry_point="", invariant_id=""):
        try:
            return flows.get_flow(self.chunks, flow_id, entry_point, invariant_id)
        except flows.Miss as e:
            near = self.nearest_flows(flow_id or entry_point or invariant_id, 3)
            raise flows.Miss(f"{e}; nearest: {', '.join(f'{r.flow_id}({r.score:.2f})' for r in near)}") from e

    def nearest_flows(self, text, k=3):
        """Rows (flow_id, score) of the flows whose chunks are nearest to a text."""
        hits = self.flow_hits(text, 4 * k)
        flow = F.coalesce("flow_step.flow_id", "flow_spine.flow_id")
        best = self.chunks.join(F.broadcast(hits), "chunk_id").select(flow.alias("flow_id"), "rank", "score").filter("flow_id <> ''")
        return best.groupBy("flow_id").agg(F.min("rank").alias("rank"), F.max_by("score", -F.col("rank")).alias("score")).orderBy("rank").limit(k).collect()

    def flow_hits(self, text, k):
        """(chunk_id, rank, score) of the chunks of flows nearest to a text; like any language, a filter after the search."""
        hits = self.near(self.embedder.query(self.spark, text), k, filters.Filter(language="flow"))
        return hits.select("chunk_id", F.col("vector_rank").alias("rank"), F.col("normalized").alias("score"))

    def expand_flow(self, step_id, direction="down", hops=1):
        return flows.expand_flow(self.chunks, step_id, direction, hops)

    def find_branches(self, symptom, k=10):
        """Branches of the steps nearest to a symptom, in the order of the steps, then of their branches."""
        return flows.branches_of(self.flow_hits(symptom, k), self.chunks).orderBy("rank", "place")

    def invariant_enforcement(self, invariant_id):
        own = flows.invariant_enforcement(self.chunks, invariant_id)
        if not self.chunks.filter((F.col("provenance") == "curated") & (F.col("symbol_name") == invariant_id)).limit(1).count():
            raise flows.Miss(f"no invariant {invariant_id}")
        return own.orderBy("place")

    # state

    def health(self):
        return store.validate(self.chunks, self.vectors)

    def freshness(self, repo):
        head = files.git_head(repo)
        indexed = self.told.get("indexed_head", "")
        changed = [r.path for r in files.git_diff(self.spark, repo, indexed, head).select("path").distinct().toLocalIterator()] if head and indexed and head != indexed else []
        return filters.freshness(indexed, head, changed)

    def alignment(self, current=None):
        """One row: how the recorded symbol graph stands to the current one ({"commit", "digest"}, or None if it can't be read)."""
        rec = self.told.get("graph")
        row = (
            (rec or {}).get("commit"), (current or {}).get("commit"), (rec or {}).get("digest"), (current or {}).get("digest"),
            (rec or {}).get("schema_version"), None if rec is None else rec.get("path", ""), current is not None,
        )
        schema = "recorded_commit string, current_commit string, recorded_digest string, current_digest string, schema_version string, path string, readable boolean"
        return filters.alignment(self.spark.createDataFrame([row], schema))
