"""Structured Streaming: event profiles with watermarks, and snapshot upkeep per micro-batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalex.operators import store
from stratalex.operators.scratch import settle


def event_profile(events, window="10 minutes", late="1 hour", ts="ts", key="event_type", value="value"):
    """count, sum and mean of each event in tumbling windows; rows later than `late` are left out."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def last_changes(batch, key="chunk_id", order=None):
    """One row per key: the change of the highest place in `order`, a sequence number (ties: the greatest row).

    Without an order a batch may hold one change of a key only.
    """
    if order is None:
        return batch
    rest = [c for c in batch.columns if c not in (key, order)]
    best = batch.groupBy(key).agg(F.max(F.struct(F.col(order), *rest)).alias("_r"))
    return best.select(*[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in batch.columns])


def merged(old, batch, key="chunk_id", gone="deleted"):
    """old with a batch of changes, one a key, applied; old may be None."""
    fresh = batch.filter(~F.coalesce(F.col(gone), F.lit(False))).drop(gone)
    return fresh if old is None else store.upsert(old.join(batch.select(key), key, "left_anti"), fresh, key)


def maintain(changes, snapshots, name="chunks", key="chunk_id", gone="deleted", order=None, checkpoint=None, keep=3):
    """A query that merges the changes that a trigger finds into the served snapshot.

    Rows with `gone` true delete their key; others replace it; of several
    changes of a key the one of the highest `order` counts. A batch is written
    to the shared folder once and read from there. The manifest holds the last
    batch, so a batch that is delivered again is skipped. Each batch writes a
    version: triggers should be rare and large, as each rewrites the table; the
    last `keep` versions stay.
    """

    def apply(batch, epoch):
        served = snapshots.manifest()
        if served is not None and served.get("epoch", -1) >= epoch:
            return
        own = settle(last_changes(batch, key, order), "changes")
        if order is None and own.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError("several changes of a key in one batch need an order")
        snapshots.publish({name: merged(snapshots.read(name), own, key, gone)}, epoch=epoch)
        snapshots.expire(keep)

    writer = changes.writeStream.foreachBatch(apply).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
