"""Dashboards over time: savings by tumbling and session windows, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_window(events: DataFrame, width: str, *, watermark: str | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Count, errors, sum and mean of a value per window and kind."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    one = rows.groupBy(F.window(ts, width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum(value).alias("s"), F.count(value).alias("c")
    )
    return one.select(F.col("w.start").alias("window_start"), "event_type", "n", "errors", F.round("s", 4).alias("total"), F.round(F.col("s") / F.col("c"), 6).alias("mean"))


def by_session(events: DataFrame, gap: str, *, key: str = "user_id", ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """Sessions of each key that end after ``gap`` without a row."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    one = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return one.select(key, F.col("w.start").alias("session_start"), "n", "errors")


def run_once(stream: DataFrame, folder: str, key: list[str], *, mode: str = "update") -> DataFrame:
    """Run a streaming frame over all that is there now; the latest row of each ``key`` is the result.

    In ``update`` mode a batch only writes the windows that it changed, and the watermark lets go of old ones' state.
    Each batch has a folder of its own below ``folder``: one that is run again replaces its own rows.
    """
    spark, out = stream.sparkSession, f"{folder}/result"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    others = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*key, "r.*")
