"""Structured Streaming: an incremental answer log and a delay feed. Batch code gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drained(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Runs a stream over what is there, into Parquet, and stops. Checkpoint and sink lie in the shared folder."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def tumbling_delay(events: DataFrame, ts: str, delay: str, width: str = "1 hour", late: str = "1 hour", id_col: str = "event_id") -> DataFrame:
    """(start, n, mean_delay) of tumbling windows; repeats of an id within the watermark count once. State is bounded by the watermark."""
    e = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])
    return e.groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(delay).alias("mean_delay")).select(F.col("window.start").alias("start"), "n", "mean_delay")


def latest_rows(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key as it changes, for update mode: Spark's state store holds one row for each key.

    Of rows of one time that with the greatest other columns counts. For very many keys set the RocksDB state store, which keeps them on disk."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(*keys, "r.*").select(*stream.columns)


def logged(stream: DataFrame, keys: list[str], order: str, table: str):
    """Runs ``latest_rows`` over what is there: a batch appends the keys that it changed, as ``table``/batch=<id>, and nothing else.

    State and offsets lie in ``table``-checkpoint, so a stopped or failed run goes on where it was; a batch that is run again writes its own folder again."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    q = latest_rows(stream, keys, order).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{table}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def current(log: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key from the log of ``logged`` (with its ``batch`` column): that of the last batch that changed the key."""
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
