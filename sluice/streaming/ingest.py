"""Structured Streaming into a table: each micro-batch is one commit, and a replayed one changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.staging import distinct_rows
from ..warehouse import Warehouse


def start(
    warehouse: Warehouse, table: str, source: str, stream: DataFrame, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Merge a stream of a source's rows; ``trigger`` is as for DataStreamWriter, by default every delay_seconds.

    Spark commits offsets after a micro-batch's version is published, so nothing is lost; the version carries the
    batch's number, so a replay is skipped. Equal rows of a micro-batch count once.
    """
    definition = warehouse.table(table)
    definition.subscription(source)

    def merged(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = distinct_rows(warehouse._checked(definition, source, batch))
        warehouse.commit(table, {source: rows}, batch_id=f"{checkpoint}#{number}")

    every = trigger or {"processingTime": f"{definition.options.delay_seconds} seconds"}
    return stream.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(**every).start()
