"""Landing decoded packets continuously, and merging several captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelake.sources.nested import LINE_SCHEMA, flatten_packets, packet_lines
from wirelake.streaming.core import with_event_time, write_parquet


def nested_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Nested packet JSON as it arrives in a folder, flattened to packet rows."""
    reader = spark.readStream.schema(LINE_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return flatten_packets(packet_lines(reader.json(folder)))


def land(packets: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds") -> StreamingQuery:
    """Append packets to the table at `path`, one folder per day, each packet exactly once."""
    dated = packets.withColumn("event_date", F.to_date("timestamp"))
    return write_parquet(dated, path, checkpoint, "event_date", every=every)


# What makes two captured packets the same packet.
SAME_PACKET = ("timestamp", "IP_src", "IP_dst", "IP_proto", "TCP_sport", "TCP_dport", "UDP_sport", "UDP_dport", "IP_id")


def merge_captures(*streams: DataFrame, delay: str = "10m", extra_key: tuple[str, ...] = ()) -> DataFrame:
    """Union of several captures; a packet seen by more than one of them is kept once.

    State is dropped once the watermark passes, so it holds `delay` of traffic.
    """
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    timed = with_event_time(everything, delay)
    key = [c for c in (*SAME_PACKET, *extra_key) if c in everything.columns]
    return timed.dropDuplicatesWithinWatermark(key).drop("event_time")
