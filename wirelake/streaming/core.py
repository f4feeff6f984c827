"""Event time, sinks and triggers shared by the streaming jobs.

A watermark needs a TIMESTAMP column, while the packet table holds TIMESTAMP_NTZ. Streams carry `event_time`
(the same instant under UTC) next to `timestamp`, and results are turned back with `from_event_time`.
Rows later than the watermark are dropped; `streaming.late` counts them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelake.functions.scalars import micros_to_timestamp
from wirelake.functions.windows import interval_text
from wirelake.schema import micros
from wirelake.session import scratch_path


def with_event_time(packets: DataFrame, delay: str = "10m") -> DataFrame:
    """Add `event_time` with its watermark."""
    return packets.withColumn("event_time", F.timestamp_micros(micros(packets))).withWatermark(
        "event_time", interval_text(delay))


def from_event_time(column: Column) -> Column:
    return micros_to_timestamp(F.unix_micros(column))


def write_parquet(stream: DataFrame, path: str, checkpoint: str, *partitions: str, every: str | None = None) -> StreamingQuery:
    """Start an append query into parquet files (exactly once). Without `every` it takes what is there and stops."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.format("parquet").start(path)


def state_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session of its own for streams with state, with the settings of `spark`: state lies in RocksDB, outside the heap,
    in `partitions` parts (fixed for a query by its first start). Streams must be read from this session."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass",
                     "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if partitions is not None:
        session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session


# Packets that pass the detectors' filters, long after all others: they move the watermark past every open window.
_LAST = "2200-01-01 00:00:00"
_LAST_PACKETS = (
    "IP_src string, IP_dst string, IP_proto int, IP_len int, TCP_sport int, TCP_dport int, TCP_flags string, UDP_sport int, "
    "UDP_dport int, DNS_id int, DNS_qr int, DNS_qname string, ARP_sender_ip string, ARP_sender_mac string, raw_size int",
    [("0.0.0.0", "0.0.0.1", 6, 0, 1, 1, "S", None, None, None, None, None, None, None, 0),
     ("0.0.0.0", "0.0.0.1", 17, 0, None, None, None, 1, 53, 0, 0, "end", None, None, 0),
     (None, None, None, 0, None, None, None, None, None, None, None, None, "0.0.0.0", "00:00:00:00:00:00", 0)])


def last_packets(spark: SparkSession) -> DataFrame:
    schema, rows = _LAST_PACKETS
    return spark.createDataFrame(rows, schema).withColumn("timestamp", F.lit(_LAST).cast("timestamp_ntz"))


def with_last_packets(packets: DataFrame, folder: str) -> DataFrame:
    """A stream of packets, and of the files that `run_to_end` puts in `folder` when the input has ended."""
    spark = packets.sparkSession
    last = last_packets(spark)
    last.limit(0).write.mode("append").parquet(folder)
    return packets.unionByName(spark.readStream.schema(last.schema).parquet(folder), allowMissingColumns=True)


def run_all_to_end(start: Callable[[], list[StreamingQuery]], spark: SparkSession, end_folder: str) -> None:
    """Runs the queries that `start` starts (over `with_last_packets`, without a trigger of their own) side by side over all
    that is there; then again over the last packets, which close what is open."""
    for last in (False, True):
        if last:
            last_packets(spark).write.mode("append").parquet(end_folder)
        for query in start():
            query.awaitTermination()


def run_to_end(stream: DataFrame, end_folder: str, name: str) -> DataFrame:
    """Run a stream (over `with_last_packets`) over all that is there, then close what is open, and read the result.

    The second start goes on from the checkpoint of the first; it reads the last packets only, after which the
    watermark closes every window, session and slice of the input. Theirs stay open and are never reported.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    schema = stream.schema
    run_all_to_end(lambda: [write_parquet(stream, f"{path}/table", f"{path}/checkpoint")], spark, end_folder)
    return spark.read.schema(schema).parquet(f"{path}/table")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all data that is there and read the written result back."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    schema = stream.schema
    write_parquet(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/table")
