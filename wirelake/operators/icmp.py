"""ICMP statistics and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelake.errors import positive
from wirelake.functions.lookups import ICMP_MESSAGE_TYPES, lookup
from wirelake.functions.scalars import ratio, zero_if_null
from wirelake.functions.windows import tumbling
from wirelake.operators.filters import destination_ip, icmp_packets, source_ip
from wirelake.operators.ip import is_fragment
from wirelake.operators.slices import interval_stats, match_first
from wirelake.schema import length_column, micros, optional, require


def _icmp(packets: DataFrame, *columns: str) -> DataFrame:
    """ICMP packets with src_ip and dst_ip added."""
    require(packets, *columns)
    return icmp_packets(packets).withColumns({"src_ip": source_ip(packets), "dst_ip": destination_ip(packets)})


def get_message_type_distribution(packets: DataFrame) -> DataFrame:
    """Packets per message type, with its name."""
    return (
        _icmp(packets, "ICMP_type").where(F.col("ICMP_type").isNotNull()).groupBy("ICMP_type")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("ICMP_type", lookup(F.col("ICMP_type"), ICMP_MESSAGE_TYPES, "Unknown").alias("type_name"), "count")
        .orderBy(F.desc("count"), "ICMP_type")
    )


def get_echo_request_reply_ratio(packets: DataFrame) -> DataFrame:
    """Echo requests, replies, replies per request, and requests without one."""
    counts = _icmp(packets, "ICMP_type").agg(
        F.count_if(F.col("ICMP_type") == 8).alias("requests"), F.count_if(F.col("ICMP_type") == 0).alias("replies"))
    return counts.select("requests", "replies", ratio(F.col("replies"), F.col("requests")).alias("ratio"),
                         F.greatest(F.col("requests") - F.col("replies"), F.lit(0)).alias("unanswered"))


def analyze_ping_patterns(packets: DataFrame, ip: str, horizon: str = "5s") -> DataFrame:
    """Pings an address sends: requests, replies to it, mean interval, its variation, round trip, pattern.

    regular: coefficient of variation <= 0.1; bursty: > 1; else irregular.
    """
    echo = _icmp(packets, "ICMP_type", "timestamp").where(
        ((F.col("ICMP_type") == 8) & (F.col("src_ip") == ip)) | ((F.col("ICMP_type") == 0) & (F.col("dst_ip") == ip)))
    is_reply = F.col("ICMP_type") == 0
    rows = echo.select(
        "timestamp", is_reply.alias("_is_reply"), micros(packets).alias("_us"),
        F.when(is_reply, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("peer"),
        optional(packets, "ICMP_id", "int").alias("icmp_id"), optional(packets, "ICMP_seq", "int").alias("icmp_seq"))
    matched = match_first(rows, ["peer", "icmp_id", "icmp_seq"], [], [], horizon)
    counts = echo.agg(F.count_if(~is_reply).alias("requests"), F.count_if(is_reply).alias("replies"))
    rtt = matched.agg(F.avg((F.col("_reply._us") - F.col("_us")) / 1000.0).alias("avg_rtt_ms"))
    sent = rows.where(~F.col("_is_reply")).select("timestamp", F.lit(ip).alias("ip_address"))
    pace = interval_stats(sent, ["ip_address"])
    pace = pace.select(F.col("avg").alias("avg_interval_s"), F.try_divide("std", "avg").alias("cv"))
    parts = counts.unionByName(rtt, allowMissingColumns=True).unionByName(pace, allowMissingColumns=True)
    names = ("requests", "replies", "avg_interval_s", "cv", "avg_rtt_ms")
    return parts.agg(F.lit(ip).alias("ip_address"), *[F.max(n).alias(n) for n in names]).withColumn(
        "pattern", F.when(F.col("cv") <= 0.1, "regular").when(F.col("cv") > 1.0, "bursty").otherwise("irregular"))


def detect_icmp_flood(packets: DataFrame, threshold: int = 1000, time_window: str = "1m") -> DataFrame:
    """Sources with more than `threshold` ICMP packets in a window."""
    positive("threshold", threshold)
    return (
        _icmp(packets, "timestamp").groupBy(tumbling(time_window).alias("w"), "src_ip")
        .agg(F.count(F.lit(1)).alias("packet_count"))
        .where(F.col("packet_count") > threshold)
        .select(F.col("w.start").alias("window_start"), "src_ip", "packet_count")
        .orderBy(F.desc("packet_count"), "window_start", "src_ip")
    )


def detect_icmp_tunneling(packets: DataFrame, max_payload: int = 64) -> DataFrame:
    """Pairs with an ICMP payload above `max_payload` bytes (payload: ICMP_data, else IP_len less 28)."""
    positive("max_payload", max_payload)
    payload = F.coalesce(F.octet_length(optional(packets, "ICMP_data", "binary")).cast("bigint"),
                         length_column(packets) - 28)
    return (
        _icmp(packets).withColumn("_payload", payload).groupBy("src_ip", "dst_ip")
        .agg(F.count(F.lit(1)).alias("packets"), F.max("_payload").alias("max_payload"),
             zero_if_null(F.sum(length_column(packets))).alias("total_bytes"))
        .where(F.col("max_payload") > max_payload).orderBy(F.desc("max_payload"), "src_ip", "dst_ip")
    )


def detect_smurf_attack(packets: DataFrame, broadcasts: list[str] | None = None, time_window: str = "1m") -> DataFrame:
    """Echo requests to a broadcast address, with the replies their (spoofed) source got in the window."""
    echo = _icmp(packets, "ICMP_type", "timestamp").withColumn("_w", tumbling(time_window).start)
    to_all = F.col("dst_ip").endswith(".255")  # 255.255.255.255 included
    if broadcasts:
        to_all = to_all | F.col("dst_ip").isin(*broadcasts)
    asked = (
        echo.where((F.col("ICMP_type") == 8) & to_all)
        .groupBy(F.col("_w").alias("window_start"), "src_ip", F.col("dst_ip").alias("broadcast_ip"))
        .agg(F.count(F.lit(1)).alias("requests"))
    )
    answered = (
        echo.where(F.col("ICMP_type") == 0).groupBy(F.col("_w").alias("window_start"), F.col("dst_ip").alias("src_ip"))
        .agg(F.count(F.lit(1)).alias("replies"))
    )
    return (
        asked.join(answered, ["window_start", "src_ip"], "left").withColumn("replies", zero_if_null(F.col("replies")))
        .select("window_start", "src_ip", "broadcast_ip", "requests", "replies")
        .orderBy(F.desc("requests"), "window_start", "src_ip", "broadcast_ip")
    )


def detect_ping_of_death(packets: DataFrame, max_size: int = 65_535) -> DataFrame:
    """Fragmented ICMP datagrams whose reassembled payload would be larger than `max_size`."""
    header = F.coalesce(optional(packets, "IP_ihl", "int"), F.lit(5)) * 4
    end = F.coalesce(optional(packets, "IP_frag", "int"), F.lit(0)).cast("bigint") * 8 + length_column(packets) - header
    return (
        _icmp(packets).where(is_fragment(packets))
        .groupBy("src_ip", "dst_ip", optional(packets, "IP_id", "int").alias("ip_id"))
        .agg(F.count(F.lit(1)).alias("fragments"), F.max(end).alias("reassembled_size"))
        .where(F.col("reassembled_size") > max_size).orderBy(F.desc("reassembled_size"), "src_ip", "dst_ip", "ip_id")
    )


def get_icmp_packet_count(packets: DataFrame) -> DataFrame:
    return icmp_packets(packets).agg(F.count(F.lit(1)).alias("count"))


def get_top_icmp_sources(packets: DataFrame, n: int = 10) -> DataFrame:
    positive("n", n)
    return (
        _icmp(packets).where(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "src_ip").limit(n)
    )
