"""Structured Streaming into and out of version logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.log import Log


def changes(batch: DataFrame, order: str, deleted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rows to delete): the newest change of each id in a batch."""
    others = [c for c in batch.columns if c != "id"]
    last = batch.groupBy("id").agg(F.max_by(F.struct(*others), order).alias("row")).select("id", *(F.col(f"row.`{c}`").alias(c) for c in others))
    if deleted is None:
        return last, last.limit(0)
    return last.where(~F.col(deleted)).drop(deleted), last.where(F.col(deleted))


def upsert_stream(stream: DataFrame, log: Log, order: str, checkpoint: str, deleted: str | None = None) -> DataStreamWriter:
    """A writer that applies each micro-batch of changes (id, attributes, ``order``, ``deleted``) as one commit.

    The batch's number is kept in the log's folder, so a batch that runs again after a failure is applied once.
    """
    schema = log.schema()

    def apply(batch: DataFrame, number: int) -> None:
        if log.store.exists("stream.txt") and int(log.store.read("stream.txt")) >= number:
            return
        batch = batch.persist()
        try:
            rows, gone = changes(batch, order, deleted)
            before, folders = log.manifest(), []
            seq = before["seq"] + 1
            folders.append((log.stage(rows, schema, seq), seq))
            if deleted is not None:
                folders.append((log.stage(gone, schema, seq, deleted=True), seq))
            log.publish(before, folders)
            log.store.write("stream.txt", str(number))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Telemetry rows counted by tumbling windows; rows later than ``late`` are left out by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
