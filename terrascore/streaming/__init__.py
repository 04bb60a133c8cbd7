"""The hook by which a stream of snapshots feeds the listings: sync() is a pure function, so foreachBatch can call it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from terrascore.sources.ingest import sync, sync_log
from terrascore.sources.versions import latest, publish, published


def sync_batches(path: str, source_name: str, now: Callable[[int], str], log: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``writeStream.foreachBatch``: each micro-batch is one whole snapshot of a source; the next version of the
    listings is published under path. ``now`` gives the time of a batch from its number. The number is noted with the version,
    so a batch that is run again after a failure is told by it and changes nothing, nor does an empty one."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark, note = batch.sparkSession, f"batch of {source_name}"
        last = latest(spark, path)
        if last and last.notes.get(note, -1) >= number:
            return
        synced = sync(published(spark, path, last.number), batch, source_name, now(number))
        publish(synced.drop("action"), path, expect=last.number, notes={note: number})
        if log:
            log(sync_log(synced, source_name, now(number)))

    return step
