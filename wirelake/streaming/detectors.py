"""Windowed detectors on a stream of packets, in append mode: a window is reported once the watermark closes it.

Distinct counts are exact and spread: a first aggregation keys on (window, keys, value), a second one counts its
rows per (window, keys). State of a scanner or a hot host is thus divided over its ports and peers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wirelake.errors import positive
from wirelake.functions.scalars import has_flag, zero_if_null
from wirelake.functions.windows import interval_text, window_seconds
from wirelake.operators.anomaly import _port
from wirelake.operators.filters import destination_ip, source_ip, tcp_packets, udp_packets
from wirelake.operators.slices import distinct_entries
from wirelake.operators.summary import behavior_features
from wirelake.operators.tcp import SCAN_PROFILES, PortScanConfig, scan_config
from wirelake.schema import length_column
from wirelake.streaming.core import from_event_time, with_event_time


def _window(width: str) -> Column:
    return F.window("event_time", interval_text(width))


def _again(width: str) -> Column:
    """The window of a row that is itself the result of a windowed aggregation."""
    return F.window(F.window_time("w"), interval_text(width))


def _start(column: str = "w") -> Column:
    return from_event_time(F.col(f"{column}.start")).alias("window_start")


def _ends(packets: DataFrame, delay: str, *extra: str) -> DataFrame:
    size = length_column(packets) if "IP_len" in packets.columns else F.lit(None).cast("bigint")
    rows = packets.select("timestamp", source_ip(packets).alias("src_ip"), destination_ip(packets).alias("dst_ip"),
                          _port(packets, "dport").alias("dst_port"), size.alias("length"), *extra)
    return with_event_time(rows, delay)


def live_packet_rate(packets: DataFrame, time_window: str = "1m", delay: str = "10m") -> DataFrame:
    """Packets and bytes per window and per second; for UDP alone pass `udp_packets(stream)`."""
    seconds = window_seconds(time_window)
    counts = _ends(packets, delay).groupBy(_window(time_window).alias("w")).agg(
        F.count(F.lit(1)).alias("packet_count"), zero_if_null(F.sum("length")).alias("byte_count"))
    return counts.select(_start(), "packet_count", "byte_count",
                         (F.col("packet_count") / seconds).alias("packets_per_second"),
                         (F.col("byte_count") / seconds).alias("bytes_per_second"))


def live_port_scans(packets: DataFrame, config: PortScanConfig | str | None = None, threshold: int | None = None,
                    time_window: str | None = None, delay: str = "10m") -> DataFrame:
    """TCP pairs with more than the threshold of distinct destination ports in a window."""
    chosen = scan_config(config, threshold, time_window, SCAN_PROFILES["balanced"])
    ports = (
        _ends(tcp_packets(packets), delay).where(F.col("dst_port").isNotNull())
        .groupBy(_window(chosen.time_window).alias("w"), "src_ip", "dst_ip", "dst_port")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        ports.groupBy(_again(chosen.time_window).alias("w2"), "src_ip", "dst_ip")
        .agg(F.count(F.lit(1)).alias("unique_ports"), F.sum("_n").alias("total_packets"))
        .where(F.col("unique_ports") > chosen.threshold)
        .select(_start("w2"), F.col("src_ip").alias("scanner_ip"), F.col("dst_ip").alias("target_ip"),
                "unique_ports", "total_packets")
    )


def live_host_scans(packets: DataFrame, threshold: int = 50, time_window: str = "1m", delay: str = "10m") -> DataFrame:
    """Sources that reach more than `threshold` hosts on one port in a window."""
    positive("threshold", threshold)
    hosts = (
        _ends(packets, delay).where(F.col("dst_port").isNotNull() & F.col("dst_ip").isNotNull())
        .groupBy(_window(time_window).alias("w"), "src_ip", "dst_port", "dst_ip").agg(F.count(F.lit(1)).alias("_n"))
    )
    return (
        hosts.groupBy(_again(time_window).alias("w2"), "src_ip", "dst_port")
        .agg(F.count(F.lit(1)).alias("unique_hosts")).where(F.col("unique_hosts") > threshold)
        .select(_start("w2"), "src_ip", "dst_port", "unique_hosts")
    )


def live_syn_flood(packets: DataFrame, threshold: int = 1000, time_window: str = "1m", delay: str = "10m") -> DataFrame:
    """Sources with more than `threshold` bare SYNs in a window, and the SYN-ACKs they got back."""
    positive("threshold", threshold)
    syn, ack = has_flag(F.col("TCP_flags"), "S"), has_flag(F.col("TCP_flags"), "A")
    rows = _ends(packets, delay, "TCP_flags").where(syn)
    sender = F.when(ack, F.col("dst_ip")).otherwise(F.col("src_ip"))
    return (
        rows.groupBy(_window(time_window).alias("w"), sender.alias("src_ip"))
        .agg(F.count_if(~ack).alias("syn_count"), F.count_if(ack).alias("syn_ack_received"))
        .where(F.col("syn_count") > threshold)
        .select(_start(), "src_ip", "syn_count", "syn_ack_received",
                (F.col("syn_count") - F.col("syn_ack_received")).alias("imbalance"))
    )


def live_udp_flood(packets: DataFrame, threshold: int = 1000, time_window: str = "1m", delay: str = "10m") -> DataFrame:
    """Sources with at least `threshold` UDP packets in a window."""
    positive("threshold", threshold)
    return (
        _ends(udp_packets(packets), delay).groupBy(_window(time_window).alias("w"), "src_ip")
        .agg(F.count(F.lit(1)).alias("packet_count"), zero_if_null(F.sum("length")).alias("byte_count"))
        .where(F.col("packet_count") >= threshold).select(_start(), "src_ip", "packet_count", "byte_count")
    )


def live_dns_tunneling(packets: DataFrame, length_threshold: int = 100, time_window: str = "1m", delay: str = "10m") -> DataFrame:
    """Sources of queries for names longer than the threshold in a window: how many, and the longest."""
    positive("length_threshold", length_threshold)
    size = F.length("DNS_qname")
    asked = F.coalesce((F.col("DNS_qr") == 0) & (size > length_threshold), F.lit(False))
    return (
        _ends(packets, delay, "DNS_qname", "DNS_qr").where(F.col("DNS_qname").isNotNull())
        .groupBy(_window(time_window).alias("w"), "src_ip").agg(F.count_if(asked).alias("queries"), F.max(F.when(asked, size)).alias("longest"))
        .where(F.col("queries") > 0).select(_start(), "src_ip", "queries", "longest")
    )


class _Bursts(StatefulProcessor):
    """Count, mean and sum of squared deviations of all windows so far (Welford), under one key."""

    def __init__(self, threshold: float, least: int):
        self.threshold, self.least = threshold, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, mean double, squares double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, mean, squares = self.seen.get() if self.seen.exists() else (0, 0.0, 0.0)
        for start, packets in sorted((row["window_start"], row["packets"]) for row in rows):
            std = math.sqrt(squares / (n - 1)) if n > 1 else 0.0
            if n >= self.least and packets > mean + self.threshold * std:
                yield Row(window_start=start, packets=packets, mean=mean, std=std, z=(packets - mean) / std if std else None)
            n += 1
            step = packets - mean
            mean += step / n
            squares += step * (packets - mean)
        self.seen.update((n, mean, squares))


def live_traffic_bursts(packets: DataFrame, threshold: float = 3.0, time_window: str = "1m", least: int = 10, delay: str = "10m") -> DataFrame:
    """Windows with more packets than mean + `threshold` standard deviations of all earlier windows that have packets.

    The first `least` windows are never bursts. A window is compared with those before it only, so a row never changes;
    `detect_traffic_bursts` compares with all windows of a table. Windows, not packets, reach the one key that holds the
    running moments. Needs a session of `state_session`.
    """
    positive("threshold", threshold)
    positive("least", least)
    counts = _ends(packets, delay).groupBy(_window(time_window).alias("w")).agg(F.count(F.lit(1)).alias("packets"))
    schema = "window_start timestamp_ntz, packets long, mean double, std double, z double"
    return counts.select(_start(), F.window_time("w").alias("at"), "packets", F.lit(0).alias("all")).groupBy("all").transformWithState(
        _Bursts(threshold, max(2, least)), schema, "append", "EventTime")


def live_behavioral_summary(packets: DataFrame, time_window: str = "1m", group_by: str = "source_ip",
                            delay: str = "10m") -> DataFrame:
    """Behaviour table per (window, host): the columns of `behavioral_summary`, all of them exact.

    Two chained aggregations as there: packets become entries that are combined on (window, host, column, value), which
    spreads a busy host's state over its peers and ports, and closed entries are counted per (window, host).
    """
    base, sums, distincts = behavior_features(packets, group_by)
    made = distinct_entries(with_event_time(base, delay), ["event_time", group_by], sums, distincts)
    entries = made.rows.groupBy(_window(time_window).alias("w"), group_by, *made.by).agg(*made.partial)
    counted = entries.groupBy(_again(time_window).alias("w2"), group_by).agg(*made.total)
    return counted.select(_start("w2"), group_by, *[c for c in counted.columns if c not in ("w2", group_by)])
