"""Upkeep of an index: lock, resume ledger, schema versions, symbol-graph realignment, footprints."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import functions as F

from stratalex.functions import exprs as X
from stratalex.operators import ranges, scratch, store

# lock


class Locked(RuntimeError):
    """Another writer has the index."""


@contextmanager
def lock(spark, root, stale_after=24 * 3600):
    """One writer at a time: a file that only one can create, in the index's own store; a lock older than stale_after seconds is void."""
    path, fs = scratch.file_system(spark, f"{root.rstrip('/')}/.lock")
    if fs.exists(path) and time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale_after:
        fs.delete(path, False)
    try:
        out = fs.create(path, False)
    except Exception as e:
        raise Locked(f"{root} is being written by another") from e
    try:
        out.write(bytearray(json.dumps({"at": time.time(), "by": uuid.uuid4().hex}).encode()))
        out.close()
        yield
    finally:
        fs.delete(path, False)


# resume ledger


class Ledger:
    """Files (path, sha) that an attempt towards a head has done; the entries of another head are discarded."""

    def __init__(self, spark, root, head):
        self.spark, self.head = spark, head
        self.root = f"{root.rstrip('/')}/.ledger"
        self.path = f"{self.root}/{hashlib.sha256(head.encode()).hexdigest()[:16]}"
        top, fs = scratch.file_system(spark, self.root)
        if fs.exists(top):
            for s in fs.listStatus(top):
                if s.getPath().getName() != self.path.rsplit("/", 1)[1]:
                    fs.delete(s.getPath(), True)

    def done(self):
        """(path, sha) of what is done, or None at the start."""
        return self.spark.read.schema("path string, sha string").parquet(self.path) if scratch.exists(self.spark, self.path) else None

    def mark(self, rows):
        """Add files (path, sha), or (path, content) whose content is hashed; empty hashes aren't kept."""
        own = rows if "sha" in rows.columns else rows.withColumn("sha", F.sha2("content", 256))
        own.filter(X.text(F.col("sha")) != "").select("path", "sha").write.mode("append").parquet(self.path)

    def open(self, files):
        """files (path, sha, ...) that aren't done with their present hash."""
        held = self.done()
        return files if held is None else files.join(held.distinct(), ["path", "sha"], "left_anti").select(*files.columns)

    def clear(self):
        scratch.drop_path(self.spark, self.root)


# schema versions

#: Steps from one version of the chunks' schema to the next: (version, columns that it adds).
STEPS = (
    ("001", {"category": "string", "guidance": "struct<also_review:array<string>,required_tests:array<string>,watch_out:array<string>>"}),
    ("002", {"invariants": "array<struct<chunk_id:string,tier:int,marker:string>>"}),
    ("003", {"convention_stats": "map<string,bigint>"}),
    ("004", {"flow_meta": "string", "enforced_at": "array<struct<flow:string,step:string,loc:string>>", "provenance": "string"}),
)


def step_digest(version, columns):
    return hashlib.sha256(json.dumps([version, columns], sort_keys=True).encode()).hexdigest()


def migration_status(applied, steps=STEPS):
    """[(version, "applied" | "pending" | "tampered")]: applied is {version: digest} as a manifest holds it."""
    out = []
    for version, columns in steps:
        if version not in applied:
            out.append((version, "pending"))
        else:
            out.append((version, "applied" if applied[version] == step_digest(version, columns) else "tampered"))
    return out


def migrate(snaps, table="chunks", steps=STEPS, dry_run=False):
    """Bring the served table to the last version: a new version with the added columns, null in old rows; the old version is the backup.

    Returns the versions that were (or, in a dry run, would be) applied.
    """
    m = snaps.manifest()
    if m is None:
        raise ValueError("nothing is served")
    applied = dict(m.get("migrations", {}))
    status = migration_status(applied, steps)
    if [v for v, s in status if s == "tampered"]:
        raise ValueError(f"steps that were applied have changed since: {[v for v, s in status if s == 'tampered']}")
    pending = [v for v, s in status if s == "pending"]
    if dry_run or not pending:
        return pending
    df = snaps.read(table)
    for version, columns in steps:
        if version in pending:
            for c, kind in columns.items():
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(None).cast(kind))
            applied[version] = step_digest(version, columns)
    others = {n: snaps.read(n) for n in snaps.tables() if n != table}
    keep = {k: v for k, v in m.items() if k not in ("version", "schema_version", "migrations")}
    snaps.publish({table: df, **others}, **keep, migrations=applied, backup=m["version"])
    return pending


# symbol graph


def align_nodes(chunks, nodes):
    """chunks (of code) with canonical_id of the node that each belongs to by the ladder of ranges, where it has one."""
    own = nodes.select("file", "start_line", "end_line", F.col("canonical_id").alias("node_id"), F.col("ord") if "ord" in nodes.columns else F.col("start_line").alias("ord"))
    best = ranges.ladder(chunks.select("chunk_id", "file", "start_line", "end_line"), own).select("chunk_id", F.col("node_id").alias("canonical_id"))
    return store.realign(chunks, best)


def realign(snaps, nodes, coordinates, kinds=("symbol", "function_split")):
    """Serve a version whose code chunks are aligned with a graph's nodes, if its digest isn't the recorded one; returns the manifest.

    coordinates: {"commit", "digest", "schema_version", "path"} of the graph.
    """
    m = snaps.manifest()
    if (m.get("graph") or {}).get("digest") == coordinates.get("digest") and coordinates.get("digest"):
        return m
    chunks = snaps.read("chunks")
    code = F.col("chunk_kind").isin(*kinds)
    out = align_nodes(chunks.filter(code), nodes).select(*chunks.columns).unionByName(chunks.filter(~code))
    others = {n: snaps.read(n) for n in snaps.tables() if n != "chunks"}
    keep = {k: v for k, v in m.items() if k not in ("version", "schema_version", "graph")}
    return snaps.publish({"chunks": out, **others}, **keep, graph=coordinates)


# layers


def refresh_layer(chunks, new, condition, old_hash, new_hash, key="chunk_id"):
    """chunks with a layer replaced by `new` if its source's hash has changed, else as they are."""
    return chunks if old_hash == new_hash else store.replace_layer(chunks, new, condition, key)


# footprints


class Footprint:
    """A run's events: spans with their times, kept in memory (a run has some dozens) and appended to a JSON-lines table at its end."""

    VERSION = "1.0"

    def __init__(self, spark, path=None):
        self.spark, self.path, self.run_id, self.events = spark, path, uuid.uuid4().hex[:16], []

    def emit(self, event, latency_ms=None, error=None, trace_id=None, **fields):
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        row = (at, self.VERSION, event, trace_id or uuid.uuid4().hex[:16], self.run_id, latency_ms, error, {k: str(v) for k, v in fields.items()})
        self.events.append(row)

    @contextmanager
    def span(self, event, **fields):
        trace, began = uuid.uuid4().hex[:16], time.monotonic()
        self.emit(f"{event}.start", trace_id=trace, **fields)
        extra = {}
        try:
            yield extra
        except Exception as e:
            self.emit(f"{event}.failed", int(1000 * (time.monotonic() - began)), str(e), trace, **fields)
            raise
        self.emit(f"{event}.done", int(1000 * (time.monotonic() - began)), None, trace, **{**fields, **extra})

    def table(self):
        schema = "ts string, schema_version string, event string, trace_id string, run_id string, latency_ms bigint, error string, fields map<string,string>"
        return self.spark.createDataFrame(self.events, schema)

    def close(self):
        if self.path and self.events:
            self.table().coalesce(1).write.mode("append").json(self.path)
            self.events = []
