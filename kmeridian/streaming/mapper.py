"""Query sequences as a stream against static sketches: histograms of each query as it arrives.

What needs all queries of a sketch (genome distance, null pool, q-values) runs over the collected table afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kmeridian.plans.mapping import KERNEL_ROWS, query_histograms


def map_stream(queries: DataFrame, sketch: tuple[DataFrame, DataFrame], out: str, checkpoint: str, hdist: int = 4, bin_shift: int = 0, kernel_rows: int = KERNEL_ROWS) -> StreamingQuery:
    """Starts a query that appends the histogram rows of each micro-batch of (query_id, seq) to a Parquet table. A batch that
    is run again replaces its own rows."""

    def each(batch: DataFrame, epoch: int) -> None:
        query_histograms(batch, *sketch, hdist, bin_shift, kernel_rows).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
