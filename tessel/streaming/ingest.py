"""Incremental ingestion: files as a stream, each address once, state and progress kept by the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessel.operators.ingest import clean_view, new_rows


def read_stream(spark: SparkSession, path: str, schema: StructType, files_each: int = 100, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).format(kind).load(path)


def ingest_once(incoming: DataFrame, raw_path: str, clean_path: str, checkpoint: str, key: str = "url") -> StreamingQuery:
    """Append each new address to the raw and clean tables: all that is there now, then stop. A rerun goes on from the
    checkpoint. A batch that is repeated after a failure finds its rows stored and adds none."""

    def store(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        for path, view in ((raw_path, lambda d: d), (clean_path, clean_view)):
            rows = view(batch)
            try:
                stored = spark.read.schema(rows.schema).parquet(path)
            except Exception as e:  # the table's first batch
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                stored = rows.limit(0)
            new_rows(rows, stored, key).write.mode("append").parquet(path)

    return incoming.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_stream(incoming: DataFrame, key: str = "url", seen_at: str | None = None, keep: str = "7 days") -> DataFrame:
    """The first row of each key. With an event time, keys are forgotten once they are older than keep."""
    if seen_at is None:
        return incoming.dropDuplicates([key])
    return incoming.withWatermark(seen_at, keep).dropDuplicatesWithinWatermark([key])


def refresh_each(incoming: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of fetched bodies to update."""
    return incoming.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
