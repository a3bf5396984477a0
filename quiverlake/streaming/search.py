"""Top-K for a stream of queries: each micro-batch is a block of queries against the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quiverlake.operators.search import topk_batch


def search_stream(vectors: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str, strategy: str = "arrow_exact") -> StreamingQuery:
    """Appends (query_id, rank, id, score) of each batch of queries (query_id, qvalues) to a Parquet table.

    A batch's results go to a folder named after it, which a repeated batch writes again, so results
    stay whole and single when a run is resumed.
    """

    def run(batch: DataFrame, number: int) -> None:
        topk_batch(vectors, batch, k, strategy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
