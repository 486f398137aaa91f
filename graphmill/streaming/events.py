"""Event operators. Each is written over a DataFrame and runs on a stream or on a table alike."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_at_once: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def debounce(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Bursts of events of a key, no further apart than the gap: `key, first_ts, last_ts, n_events`.

    On a stream `late` is the watermark; a burst is emitted once no event can join it.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_events")).drop("w")


def windowed_metrics(events: DataFrame, key: str, ts: str, value: str, width: str, late: str | None = None) -> DataFrame:
    """Count, mean and extremes of a value per key and tumbling window."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late:
        timed = timed.withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n_events"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value")
    ).select(F.col("w.start").alias("window_start"), key, "n_events", "mean_value", "min_value", "max_value")


def cooldown(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events that come at least so many seconds after the event before them; the first of a key always does."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    wait = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    return events.withColumn("_wait", wait).where(F.col("_wait").isNull() | (F.col("_wait") >= seconds * 1_000_000)).drop("_wait")


def _state(target: str, batch_id: int | None = None) -> str | None:
    """The folder of the last state that was written whole, up to a batch."""
    where, inner = fs.FileSystem.from_uri(target if "://" in target else f"file://{target}")
    found = [i.path for i in where.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if "/state-" in i.path]
    whole = [p for p in sorted(found) if where.get_file_info(f"{p}/_SUCCESS").type == fs.FileType.File and (batch_id is None or int(p[-12:]) <= batch_id)]
    scheme = target.partition("://")[0] if "://" in target else "file"
    return f"{scheme}://{whole[-1]}" if whole else None


def read_latest(spark, target: str) -> DataFrame:
    """The last row of each key that `upsert_latest` has written."""
    return spark.read.parquet(_state(target))


def upsert_latest(target: str, key: str, ts: str):
    """A foreachBatch sink that keeps the last row of each key; `read_latest` reads the state.

    Each batch is merged with the state before it into a folder named by the batch, so that a batch that is repeated after
    a failure writes the same result, and the state before it stays as it was until the next batch has been written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch
        if batch_id > 0 and (before := _state(target, batch_id - 1)):
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(before))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), ts).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{target}/state-{batch_id:012d}")
        if batch_id > 1 and (old := _state(target, batch_id - 2)):
            where, inner = fs.FileSystem.from_uri(old)
            where.delete_dir(inner)

    return write
