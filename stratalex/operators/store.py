"""Versioned snapshots of chunks and vectors: merge, delete, validate, publish."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import functions as F


def upsert(old, new, key="chunk_id"):
    """Rows of old that new doesn't replace, and new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_by(old, gone, key="file"):
    return old.join(gone.select(key).distinct(), key, "left_anti")


def fill_where_empty(rows, values, key, column):
    """column from values where rows has none."""
    own = values.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    out = rows.join(own, rows[key] == F.col("_k"), "left")
    empty = F.col(column).isNull() | (F.col(column) == "")
    return out.withColumn(column, F.when(empty, F.coalesce("_v", column)).otherwise(F.col(column))).drop("_k", "_v")


def fill_array_where_empty(rows, values, key, column):
    """column, an array, from values where rows has none or an empty one."""
    own = values.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    out = rows.join(own, rows[key] == F.col("_k"), "left")
    none = F.coalesce(F.size(column), F.lit(0)) <= 0
    return out.withColumn(column, F.when(none, F.coalesce("_v", column)).otherwise(F.col(column))).drop("_k", "_v")


def realign(rows, ids, key="chunk_id"):
    """canonical_id from ids, where it is not empty and differs."""
    own = ids.select(F.col(key).alias("_k"), F.col("canonical_id").alias("_v"))
    out = rows.join(own, rows[key] == F.col("_k"), "left")
    return out.withColumn("canonical_id", F.when(F.coalesce("_v", F.lit("")) != "", F.col("_v")).otherwise(F.col("canonical_id"))).drop("_k", "_v")


def validate(chunks, vectors, key="chunk_id"):
    """One row: counts, orphans on both sides, symbol chunks and how many have a canonical id."""
    told = chunks.agg(
        F.count("*").alias("chunks"), F.count_if(F.col("chunk_kind") == "symbol").alias("symbol_chunks"),
        F.count_if((F.col("chunk_kind") == "symbol") & (F.coalesce("canonical_id", F.lit("")) != "")).alias("canonical"),
    )
    vec = vectors.agg(F.count("*").alias("vectors"))
    lost = chunks.join(vectors, key, "left_anti").agg(F.count("*").alias("orphan_chunks"))
    bare = vectors.join(chunks, key, "left_anti").agg(F.count("*").alias("orphan_vectors"))
    one = told.join(F.broadcast(vec)).join(F.broadcast(lost)).join(F.broadcast(bare))  # single rows
    rate = F.when(F.col("symbol_chunks") == 0, 1.0).otherwise(F.col("canonical") / F.col("symbol_chunks"))
    return one.withColumn("canonical_rate", rate).withColumn("ok", (F.col("orphan_chunks") == 0) & (F.col("orphan_vectors") == 0))


def delete_layer(old, condition):
    """(rows that don't meet the condition, a column or SQL, one row: n, how many do)."""
    own = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    return old.filter(~own), old.agg(F.count_if(own).alias("n"))


def replace_layer(old, new, condition, key="chunk_id"):
    """old with the rows of a layer replaced by new: what a changed source of that layer asks for."""
    kept, _ = delete_layer(old, condition)
    return upsert(kept, new, key)


#: A layer's rows: flow steps and spines with curated invariants; documents of further roots.
FLOW_LAYER = ("chunk_kind in ('flow_spine', 'flow_step') or (chunk_kind = 'invariant' and provenance = 'curated')")
DOCS_LAYER = ("chunk_kind = 'doc' and category = 'domain' and coalesce(commit_hash, '') = ''")


def stats(tables):
    """One row: rows of each table of a snapshot."""
    from functools import reduce

    counts = [df.agg(F.count("*").alias(name)) for name, df in sorted(tables.items())]
    return reduce(lambda a, b: a.join(F.broadcast(b)), counts)  # single rows


class Snapshots:
    """Version folders under a root; the manifest, written last, names the one that is served.

    A manifest replaces the one before in one rename, so a crash leaves either.
    Versions but the last `keep` are removed after that.
    """

    def __init__(self, spark, root):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: hadoop.Path(f"{self.root}/{p}".rstrip("/"))
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self):
        if not self._fs.exists(self._path("manifest.json")):
            return None
        return json.loads(self.spark.read.text(f"{self.root}/manifest.json", wholetext=True).first()[0])

    def read(self, name):
        m = self.manifest()
        return None if m is None else self.spark.read.parquet(f"{self.root}/{m['version']}/{name}")

    def publish(self, tables, check=None, **told):
        """Write tables as a new version; `check`, given them as read back, may refuse it. Returns the manifest."""
        version = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
        back = {name: self.spark.read.parquet(f"{self.root}/{version}/{name}") for name in tables}
        if check is not None and not check(back):
            self._fs.delete(self._path(version), True)
            raise ValueError("the new version failed validation; the old one stays")
        m = {"version": version, "schema_version": "1.1", **told}
        self._write(m)
        return m

    def _replace(self, source, target):
        """A rename that takes the place of what is there."""
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(self._path(source), self._path(target), options)

    def tables(self):
        """Names of the served version's tables."""
        m = self.manifest()
        return [] if m is None else sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(m["version"])) if s.isDirectory())

    def versions(self):
        """Names of the versions that are there, oldest first."""
        if not self._fs.exists(self._path("")):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path("")) if s.isDirectory()]
        return sorted(x for x in found if x.startswith("v-") and not x.endswith("-postings"))

    def expire(self, keep=3):
        """Remove all versions but the last `keep` and the served one; returns the names of those that went."""
        served = (self.manifest() or {}).get("version")
        gone = [v for v in self.versions()[:-keep or None] if v != served]
        for v in gone:
            self._fs.delete(self._path(v), True)
            self._fs.delete(self._path(f"{v}-postings"), True)
        return gone

    def promote(self, version, check=None):
        """Serve a version that is there already, if `check`, given its tables, agrees; returns the manifest."""
        if not self._fs.exists(self._path(version)):
            raise ValueError(f"no version {version}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(version)) if s.isDirectory()]
        if check is not None and not check({n: self.spark.read.parquet(f"{self.root}/{version}/{n}") for n in names}):
            raise ValueError("the version failed validation; the served one stays")
        m = {**(self.manifest() or {}), "version": version}
        self._write(m)
        return m

    def note(self, **told):
        """Add to the served manifest's entries; returns it."""
        m = {**(self.manifest() or {}), **told}
        self._write(m)
        return m

    def _write(self, m):
        out = self._fs.create(self._path("manifest.json.new"), True)
        out.write(bytearray(json.dumps(m, sort_keys=True).encode()))
        out.close()
        self._replace("manifest.json.new", "manifest.json")
