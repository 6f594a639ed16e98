"""Incremental pickup of new files with exactly-once bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import sinks


def stream_ingest(spark: SparkSession, source: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, *, form: str = "parquet", files_per_batch: int = 1000, **options: str) -> StreamingQuery:
    """Give each new file's rows to sink once; available files now, then stop. sink gets the batch's number, by which a repeated
    batch after a failure can be told (history_sink and batch_folder do)."""
    stream = spark.readStream.format(form).schema(schema).options(maxFilesPerTrigger=files_per_batch, **options).load(source)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_sink(path: str, name: str, *, key: str = "task_id", order: str = "created_at") -> Callable[[DataFrame, int], None]:
    """A sink that puts each batch into the history at path, by key. The batch's number is part of the commit: a batch that the stream gives
    again after a failure, whole or with other rows, changes nothing. name: the stream, whose numbers begin anew with a new checkpoint folder."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.persist()  # read for the buckets, then for the rows; the same files in any case
        try:
            sinks.upsert_history(rows.sparkSession, path, rows, key=key, order=order, batch=(name, batch))
        finally:
            rows.unpersist()

    return put


def stream_history(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, **options) -> StreamingQuery:
    """New files below source into the history at path: each file's rows once, also when a run is killed anywhere and started again."""
    return stream_ingest(spark, source, schema, history_sink(path, checkpoint), checkpoint, **options)


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own partition and overwrites it when repeated."""
    return lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
