"""A stream of deliveries into the store: every micro-batch is an idempotent upsert of its dates, so that a batch that is
repeated after a failure changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store, TableSpec


def stream_into(deliveries: DataFrame, store: Store, spec: TableSpec, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing a streaming DataFrame to a dated table. trigger: arguments of DataStreamWriter.trigger."""

    def write(batch: DataFrame, _: int) -> None:
        store.append_dated(spec, batch.dropDuplicates(list(spec.columns)))

    return deliveries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
