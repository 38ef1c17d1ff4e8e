"""Incremental import as a stream. An extension: the batch import is the base, a stream only feeds it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def import_stream(incoming: DataFrame, store: str, checkpoint: str, *, key: str, digest: str, order: list[str]) -> StreamingQuery:
    """Adds each micro-batch's new items to the Parquet store; what is stored already is skipped, so a batch may come twice; an id with
    another content stops the stream with ImportCollision."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            stored = spark.read.parquet(store)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = batch.limit(0)
        ingest.new_items(batch, stored, key=key, digest=digest, order=order).write.mode("append").parquet(store)

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
