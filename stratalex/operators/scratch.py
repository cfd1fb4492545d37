"""Tables in the shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid


def shared_dir(spark):
    """The folder of spark.checkpoint.dir; where it is unset and all tasks run on this machine, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = held.get() if held.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="stratalex-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def file_system(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_path(spark, path):
    try:
        p, fs = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


def exists(spark, path):
    p, fs = file_system(spark, path)
    return fs.exists(p)


def settle(df, name):
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratalex-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark, path):
    """A name for the state of a table's files: their paths, sizes and times."""
    import hashlib

    p, fs = file_system(spark, path)
    found, told = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        told.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(told)).encode()).hexdigest()[:24]
