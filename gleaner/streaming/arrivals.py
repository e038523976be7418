"""Groups that keep arriving: the build, once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from gleaner.plans.build import Build


def build_arrivals(groups: DataFrame, build_for: Callable[[DataFrame, int], Build], checkpoint: str) -> DataStreamWriter:
    """A writer that runs build_for(batch, batch_id) on each micro-batch of streaming groups.

    A batch that is replayed after a failure finds its responses and stage
    results by hash, so nothing is asked or counted twice as long as build_for
    gives the same folder for the same batch_id.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            build_for(batch, batch_id).run(batch)

    return groups.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
