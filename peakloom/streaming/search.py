"""Library search over a stream of query spectra.

The search itself is the batch operator; each micro-batch is one bounded query set
against the static library, so no state or watermark is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.search import search_library
from ..operators.spectra import build_channels


def search_stream(queries: DataFrame, library: DataFrame, p, out_path: str, checkpoint: str, top_n: int = 10,
                  **trigger):
    """Start a query writing hits of every micro-batch to Parquet under its batch id.

    ``queries`` streams (id, pos, peaks).  A replayed batch overwrites its own folder,
    so results are exactly-once.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        built = build_channels(batch, p).persist()
        hits = search_library(built, library, p, top_n)
        hits.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        built.unpersist()

    return (queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
