"""Micro-batch search over a stream of query files.

Each micro-batch of (query_id, query) rows is answered with the batch
operator ``plans.pipeline.search_batch`` against persisted retrievers and
appended to a Parquet sink. The checkpoint location (shared storage) makes
the query restartable after a failure; ``foreachBatch`` output is keyed by
batch id, so a replayed batch overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.plans.pipeline import INTERACTIVE_CONFIG, Retrievers, SplitArtifacts, search_batch

QUERY_SCHEMA = "query_id long, query string"


def start_search_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str,
                        art: SplitArtifacts, retr: Retrievers, cfg=INTERACTIVE_CONFIG, top_n: int = 10,
                        trigger_once: bool = False):
    """Start the streaming query; returns the StreamingQuery handle."""
    stream = spark.readStream.schema(QUERY_SCHEMA).parquet(source_dir)

    def answer(batch: DataFrame, batch_id: int) -> None:
        pages = search_batch(batch, art, retr, cfg, top_n)
        pages.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
