"""Logs as they grow: chunks still to be done, messages once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.redelivery import SeenIndex, message_key
from ..operators.schedule import pending
from ..sources.files import progress_log


def analyse_stream(spark: SparkSession, chunks: DataFrame, log: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Each arriving batch of chunks, less what the log calls completed, goes through ``work``, whose progress rows join the log.

    Spark's checkpoint keeps batches; a batch that is run again after a crash finds its finished
    chunks in the log. The query stops after the batches that are there.
    """

    def batch(rows: DataFrame, _: int) -> None:
        try:
            todo = pending(rows, progress_log(spark, log))
        except Exception as e:  # noqa: BLE001 - the log does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            todo = rows
        work(todo).write.mode("append").json(log)

    return chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_stream(messages: DataFrame, index: SeenIndex, out: str, checkpoint: str, key: Column | None = None, order: str = "delivery_no") -> StreamingQuery:
    """Messages of each micro-batch that no earlier one held, in ``out``, a folder a batch of this query.

    ``order`` is unique to each delivery, so that a message that is delivered again has another.
    The index knows the row each message was first seen in, so a batch that Spark runs again after
    a crash writes the same folder anew, and nothing is lost or doubled. A query with a new
    checkpoint writes folders of its own: rows that it delivers again are those it has read again.
    """
    told = checkpoint.rstrip("/").rpartition("/")[2]

    def batch(rows: DataFrame, number: int) -> None:
        index.sweep()
        kept = index.add(rows, message_key() if key is None else key, order)
        rows.join(kept, order, "left_semi").write.mode("overwrite").parquet(f"{out}/query={told}/batch={number}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
