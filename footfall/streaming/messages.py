"""Message extraction on unbounded input: the extraction functions are row-wise, so they run on a stream unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def extract_stream(messages: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Append a signal table from a message stream, all available input per run, exactly once by its checkpoint."""
    return (extract(messages).writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))
