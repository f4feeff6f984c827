"""Mergeable sketches by day, stored once, from which reports over any days are made without reading packets again.

Distinct counts are HyperLogLog sketches of 2^12 registers (standard error 1.6 %), packet sizes KLL sketches with k = 400
(a quantile's rank is off by about 0.7 %). Both have a size that does not grow with the packets, and a union of days
is as exact as a sketch of all their packets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelake.errors import one_of
from wirelake.operators.anomaly import _port
from wirelake.operators.filters import destination_ip, source_ip
from wirelake.schema import length_column, require

REGISTERS = 12
SIZES_K = 400
GRAINS = ("day", "week", "month", "year")


def daily_sketches(packets: DataFrame) -> DataFrame:
    """One row per day: packets, bytes, first and last time, and sketches of hosts, host pairs, destination ports and sizes.

    Packets without a time have no day and are left out; packets without an address or port count for nothing there.
    """
    require(packets, "timestamp")
    source, destination = source_ip(packets), destination_ip(packets)
    pair = F.when(source.isNotNull() & destination.isNotNull(), F.concat_ws(">", source, destination))
    distinct = lambda c: F.hll_sketch_agg(c, REGISTERS)
    days = packets.where(F.col("timestamp").isNotNull()).groupBy(F.to_date("timestamp").alias("event_date")).agg(
        F.count(F.lit(1)).alias("packets"), F.coalesce(F.sum(length_column(packets)), F.lit(0)).alias("bytes"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        distinct(source).alias("sources"), distinct(destination).alias("destinations"), distinct(pair).alias("pairs"),
        distinct(_port(packets, "dport")).alias("ports"), F.kll_sketch_agg_bigint(length_column(packets), SIZES_K).alias("sizes"))
    return days.withColumn("hosts", F.hll_union("sources", "destinations")).drop("sources", "destinations")


def store_sketches(packets: DataFrame, path: str) -> None:
    """Adds the sketches of the days of `packets` to the table at `path`; days that it has already are replaced."""
    daily_sketches(packets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)


def report(sketches: DataFrame, grain: str = "month", quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per day, week, month or year, from daily sketches: packets, bytes, times, estimates of distinct hosts, pairs and
    ports, and sizes at the quantiles (size_p50, ...)."""
    one_of("grain", grain, GRAINS)
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    made = sketches.groupBy(F.trunc("event_date", grain).alias("period") if grain != "day" else F.col("event_date").alias("period")).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), estimate("hosts"), estimate("pairs"), estimate("ports"),
        F.kll_merge_agg_bigint("sizes").alias("sizes"))
    return made.select("*", *[F.kll_sketch_get_quantile_bigint("sizes", F.lit(q)).alias(f"size_p{q * 100:g}") for q in quantiles]).drop("sizes")
