"""Follow a folder of snapshot rows as a stream and diff each against the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera import schema
from tessera.catalog import Store
from tessera.operators import resolve


def follow(store: Store, checkpoint: str, on_diff: Callable[[str, str | None, DataFrame, DataFrame], None], once: bool = True) -> StreamingQuery:
    """Call ``on_diff(snapshot, previous, changed, removed)`` for each new snapshot.

    The snapshots table is the stream: its rows are written after their facts.  The one
    before is that of the same repository.  A batch
    is handled in order of creation; after a failure it comes again, so ``on_diff``
    should write by snapshot id.
    """
    stream = store.spark.readStream.schema(schema.TABLES["snapshots"]).parquet(store.path("snapshots"))

    def each(batch: DataFrame, _: int) -> None:
        order = ["created_at", "id"]
        known: dict[str, list[str]] = {}
        for r in store.read("snapshots").orderBy(*order).select("id", "repository_id").collect():  # one row a scan
            known.setdefault(r["repository_id"], []).append(r["id"])
        for r in batch.orderBy(*order).select("id", "repository_id").collect():
            own = known[r["repository_id"]]
            at = own.index(r["id"])
            prev = own[at - 1] if at else None
            cur = store.read("symbols", r["id"])
            old = store.read("symbols", prev) if prev else cur.where(F.lit(False))
            on_diff(r["id"], prev, resolve.changed(old, cur), resolve.removed(old, cur))

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")).start()
