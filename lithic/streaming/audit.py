"""An extension for the append-only audit log: it is read as a stream and counted by time.

Late records count up to the watermark. State is kept a window or session, not a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD = "event_id long, ts timestamp, user_id long, event_type string, value double"


def read_audit(spark: SparkSession, folder: str, kind: str = "json", schema: str = RECORD) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(folder)


def decisions_by_window(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Records and mean value of each decision in each window."""
    held = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return held.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Records of a user without a pause longer than the gap."""
    held = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return held.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_records(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each record once, however often it is appended within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there and stop; ``checkpoint`` makes reruns take only what is new."""
    return stream.writeStream.queryName(name).format("memory").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
