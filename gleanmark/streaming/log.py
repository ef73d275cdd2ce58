"""The append-only event log: batch projections and the streams that keep them current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def projected(events: DataFrame) -> DataFrame:
    """One row per event_id: question id, normalised text, kind and origin; repeats of an event count once."""
    once = events.dropDuplicates(["event_id"])
    return once.select("event_id", question_id(F.col("event_type"), F.col("user_id").cast("string")).alias("question_id"), "event_type", origin(F.col("user_id")).alias("origin"))


def question_id(*parts: Column) -> Column:
    """Q- and 16 digits of the SHA-256 of the parts, joined by the unit separator."""
    return F.concat(F.lit("Q-"), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16))


def origin(actor: Column) -> Column:
    return F.when(actor % 10 == 0, "synthetic").when(actor % 10 == 1, "seed").otherwise("user")


def windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and their value by tumbling window and type; works on tables and on streams alike."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def stream(events: DataFrame, sink: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Project a stream of events to Parquet: repeats inside the watermark are dropped, and a batch that is
    replayed overwrites its own folder."""
    once = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])

    def write(batch: DataFrame, number: int) -> None:
        projected(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
