"""Streaming extension: positions of a stream snapped to a network in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanwright.operators.snap import Snap, candidates
from spanwright.plans.graph import Graph


def snapped_stream(graph: Graph, positions: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, snap: Snap | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that hands each micro-batch of positions(point_id, x, y, ...) with its places to ``write(rows, batch_id)``.

    A batch is snapped like a table, with the same cells and ties. ``write`` should be idempotent by batch_id, since
    a batch is repeated after a failure.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        write(candidates(graph, batch, snap), batch_id)

    return positions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def component_counts(places: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Positions by event-time window and component, with a watermark for late rows: places(ts, component)."""
    return places.withWatermark(time, late).groupBy(F.window(time, width), "component").agg(F.count("*").alias("positions"))
