"""Detectors over all protocols."""

from __future__ import annotations

from datetime import time

from pyspark.sql import DataFrame, Window, functions as F

from wirelake.errors import InvalidValueError, positive
from wirelake.functions.addresses import ipv4_long, is_private_ip
from wirelake.functions.lookups import protocol_name
from wirelake.functions.scalars import has_flag, zero_if_null
from wirelake.functions.windows import tumbling
from wirelake.operators import udp
from wirelake.operators.filters import destination_ip, source_ip, tcp_packets
from wirelake.operators.ip import is_fragment
from wirelake.operators.slices import sequential_share
from wirelake.operators.tcp import SCAN_PROFILES, PortScanConfig, custom_scan_config, port_scans, scan_config
from wirelake.schema import length_column, optional, require


def _port(packets: DataFrame, end: str):
    return F.coalesce(optional(packets, f"TCP_{end}", "int"), optional(packets, f"UDP_{end}", "int"))


def _ends(packets: DataFrame, *extra: str) -> DataFrame:
    require(packets, "timestamp")
    return packets.select("timestamp", source_ip(packets).alias("src_ip"), destination_ip(packets).alias("dst_ip"),
                          _port(packets, "sport").alias("src_port"), _port(packets, "dport").alias("dst_port"), *extra)


def detect_port_scanning(packets: DataFrame, config: PortScanConfig | str | None = None, threshold: int | None = None,
                         time_window: str | None = None, ports_contacted: bool = True) -> DataFrame:
    """Port scans over TCP and UDP destination ports; a threshold left out of a custom config is 100."""
    if threshold is None and time_window is not None:
        threshold = 100
    resolved = scan_config(config, threshold, time_window, SCAN_PROFILES["balanced"])
    if config == "custom" and threshold is None:
        resolved = custom_scan_config(100, resolved.time_window)
    rows = packets.withColumns({"IP_src": source_ip(packets), "IP_dst": destination_ip(packets)})
    rows = rows.where(_port(packets, "dport").isNotNull())
    return port_scans(rows, _port(packets, "dport"), resolved, ports_contacted)


def detect_host_scanning(packets: DataFrame, threshold: int = 50, time_window: str = "1m") -> DataFrame:
    """Sources that reach more than `threshold` hosts on one port in a window."""
    positive("threshold", threshold)
    return (
        _ends(packets).where(F.col("dst_port").isNotNull()).groupBy(tumbling(time_window).alias("w"), "src_ip", "dst_port")
        .agg(F.count_distinct("dst_ip").alias("unique_hosts")).where(F.col("unique_hosts") > threshold)
        .select(F.col("w.start").alias("window_start"), "src_ip", "dst_port", "unique_hosts")
        .orderBy(F.desc("unique_hosts"), "window_start", "src_ip", "dst_port")
    )


def detect_vertical_scanning(packets: DataFrame, threshold: int = 50) -> DataFrame:
    """Sources that reach more than `threshold` hosts on one port, and how sequential the addresses are."""
    positive("threshold", threshold)
    return vertical_scans(_ends(packets), threshold)


def vertical_scans(ends: DataFrame, threshold: int) -> DataFrame:
    """Vertical scans in rows of src_ip, dst_ip, dst_port."""
    pairs = ends.select("src_ip", "dst_port", "dst_ip").where(
        F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull() & F.col("dst_ip").isNotNull()).distinct()
    return (
        sequential_share(pairs, ["src_ip", "dst_port"], ipv4_long(F.col("dst_ip")), {"unique_hosts": F.lit(1)})
        .where(F.col("unique_hosts") > threshold)
        .select("src_ip", "dst_port", "unique_hosts", "sequential_share")
        .orderBy(F.desc("unique_hosts"), "src_ip", "dst_port")
    )


def detect_horizontal_scanning(packets: DataFrame, threshold: int = 100) -> DataFrame:
    """Pairs with more than `threshold` distinct destination ports, and how sequential the ports are."""
    positive("threshold", threshold)
    return horizontal_scans(_ends(packets), threshold)


def horizontal_scans(ends: DataFrame, threshold: int) -> DataFrame:
    """Horizontal scans in rows of src_ip, dst_ip, dst_port."""
    rows = ends.where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    share = sequential_share(rows, ["src_ip", "dst_ip"], F.col("dst_port"))
    return (
        share.where(F.col("n") > threshold)
        .select("src_ip", "dst_ip", F.col("n").alias("unique_ports"), "sequential_share")
        .orderBy(F.desc("unique_ports"), "src_ip", "dst_ip")
    )


def detect_syn_flood(packets: DataFrame, threshold: int = 1000, time_window: str = "1m") -> DataFrame:
    """Sources with more than `threshold` bare SYNs in a window, the SYN-ACKs they got back, and the difference.

    A SYN counts for its sender and a SYN-ACK for its receiver, so one aggregation holds both.
    """
    positive("threshold", threshold)
    require(packets, "TCP_flags")
    syn, ack = has_flag(F.col("TCP_flags"), "S"), has_flag(F.col("TCP_flags"), "A")
    return syn_floods(
        _ends(packets, "TCP_flags").where(syn)
        .select("timestamp", F.when(ack, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("src_ip"), ack.alias("_ack"))
        .groupBy(tumbling(time_window).alias("w"), "src_ip")
        .agg(F.count_if(~F.col("_ack")).alias("syn_count"), F.count_if("_ack").alias("syn_ack_received"))
        .select(F.col("w.start").alias("window_start"), "src_ip", "syn_count", "syn_ack_received"), threshold)


def syn_floods(counts: DataFrame, threshold: int) -> DataFrame:
    """Floods in (window_start, src_ip, syn_count, syn_ack_received)."""
    return (
        counts.where(F.col("syn_count") > threshold)
        .withColumn("imbalance", F.col("syn_count") - F.col("syn_ack_received"))
        .orderBy(F.desc("syn_count"), "window_start", "src_ip")
    )


def detect_udp_flood(packets: DataFrame, threshold: int = 1000, time_window: str = "1m") -> DataFrame:
    """Sources with more than `threshold` UDP packets in a window."""
    positive("threshold", threshold)
    return udp.detect_udp_flood(packets, threshold, time_window).where(F.col("packet_count") > threshold)


def detect_land_attack(packets: DataFrame) -> DataFrame:
    """Packets from an address to itself; `same_port` tells whether the ports are equal too."""
    return _ends(packets).where(F.col("src_ip") == F.col("dst_ip")).withColumn(
        "same_port", F.col("src_port").eqNullSafe(F.col("dst_port")))


def detect_tiny_fragments(packets: DataFrame, size_threshold: int = 60) -> DataFrame:
    """Fragments shorter than `size_threshold` bytes."""
    positive("size_threshold", size_threshold)
    return packets.where(is_fragment(packets) & (length_column(packets) < size_threshold))


def detect_null_scan(packets: DataFrame) -> DataFrame:
    """TCP packets without any flag."""
    require(packets, "TCP_flags", "TCP_dport")
    return tcp_packets(packets).where(
        F.col("TCP_dport").isNotNull() & (F.coalesce(F.col("TCP_flags"), F.lit("")) == ""))


def detect_xmas_scan(packets: DataFrame) -> DataFrame:
    """Packets with FIN, PSH and URG all set."""
    require(packets, "TCP_flags")
    flags = F.col("TCP_flags")
    return packets.where(has_flag(flags, "F") & has_flag(flags, "P") & has_flag(flags, "U"))


def detect_traffic_bursts(packets: DataFrame, threshold: float = 3.0, time_window: str = "1m") -> DataFrame:
    """Windows with more packets than mean + `threshold` standard deviations of all non-empty windows.

    The second step sees one row per window of elapsed time, not packets.
    """
    positive("threshold", threshold)
    counts = packets.groupBy(tumbling(time_window).alias("w")).agg(F.count(F.lit(1)).alias("packets"))
    whole = Window.partitionBy("_all")
    return (
        counts.select(F.col("w.start").alias("window_start"), "packets", F.lit(0).alias("_all"))
        .withColumns({"mean": F.avg("packets").over(whole), "std": F.stddev_samp("packets").over(whole)})
        .withColumn("z", F.try_divide(F.col("packets") - F.col("mean"), F.col("std")))
        .where(F.col("packets") > F.col("mean") + threshold * F.col("std")).drop("_all")
        .orderBy(F.desc("packets"), "window_start")
    )


def detect_unusual_protocols(packets: DataFrame, max_share: float = 0.01) -> DataFrame:
    """IP protocols that carry less than `max_share` of the packets with a protocol number (256 rows at most)."""
    positive("max_share", max_share)
    require(packets, "IP_proto")
    counts = packets.where(F.col("IP_proto").isNotNull()).groupBy("IP_proto").agg(F.count(F.lit(1)).alias("count"))
    whole = Window.partitionBy("_all")
    return (
        counts.withColumn("_all", F.lit(0))
        .withColumn("share", F.col("count") / F.sum("count").over(whole))
        .where(F.col("share") < max_share)
        .select("IP_proto", protocol_name(F.col("IP_proto")).alias("name"), "count", "share")
        .orderBy("count", "IP_proto")
    )


def _hours(bound) -> float:
    if isinstance(bound, time):
        return bound.hour + bound.minute / 60 + bound.second / 3600
    if isinstance(bound, (int, float)) and 0 <= bound <= 24:
        return float(bound)
    raise InvalidValueError(f"business hours must be hours (0..24) or times, got {bound!r}")


def off_hours(business_hours=(9, 17)):
    """Whether `timestamp` lies outside [start, end) of the day."""
    start, end = map(_hours, business_hours)
    now = F.hour("timestamp") + F.minute("timestamp") / 60.0 + F.second("timestamp") / 3600.0
    return (now < start) | (now >= end)


def detect_off_hours_activity(packets: DataFrame, business_hours=(9, 17)) -> DataFrame:
    """Sources active outside [start, end) of the day (UTC wall clock): packets, bytes, first and last seen."""
    size = length_column(packets) if "IP_len" in packets.columns else F.lit(None).cast("bigint")
    return (
        packets.where(off_hours(business_hours)).groupBy(source_ip(packets).alias("src_ip"))
        .agg(F.count(F.lit(1)).alias("packets"), zero_if_null(F.sum(size)).alias("bytes"),
             F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        .where(F.col("src_ip").isNotNull()).orderBy(F.desc("packets"), "src_ip")
    )


def detect_data_exfiltration(packets: DataFrame, threshold: int = 100_000_000) -> DataFrame:
    """Private sources that send more than `threshold` bytes to public addresses.

    Bytes are summed per pair first, so a hot source is spread over its destinations and these need no
    distinct count. Catalyst moves the address filter below that grouping.
    """
    positive("threshold", threshold)
    pairs = packets.groupBy(source_ip(packets).alias("src_ip"), destination_ip(packets).alias("dst_ip")).agg(
        zero_if_null(F.sum(length_column(packets))).alias("b"), F.count(F.lit(1)).alias("n"))
    return exfiltration(pairs, threshold)


def exfiltration(pairs: DataFrame, threshold: int) -> DataFrame:
    """Private sources over the threshold in (src_ip, dst_ip, b bytes, n packets)."""
    return (
        pairs.where(is_private_ip(F.col("src_ip")) & ~is_private_ip(F.col("dst_ip"))).groupBy("src_ip")
        .agg(F.sum("b").alias("outbound_bytes"), F.sum("n").alias("packets"),
             F.count(F.lit(1)).alias("unique_destinations"))
        .where(F.col("outbound_bytes") > threshold).orderBy(F.desc("outbound_bytes"), "src_ip")
    )
