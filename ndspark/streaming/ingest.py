"""Streams of cells into chunk files: what Structured Streaming offers beyond the batch store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import cells


def append_chunks(stream: DataFrame, dims: list[int], chunk_dims: list[int], folder: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's cells i0..ik, v as chunks under folder, one sub-folder a batch, so a repeated batch replaces itself.

    A chunk's cells must come in one batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        cells.to_chunks(batch, dims, chunk_dims).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
