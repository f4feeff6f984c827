"""ARP tables and detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelake.errors import positive
from wirelake.functions.addresses import ipv4_long
from wirelake.functions.scalars import ratio
from wirelake.operators.filters import arp_packets
from wirelake.operators.slices import sequential_share, with_previous
from wirelake.schema import micros, optional, require

# MAC addresses that bind to no host.
NO_HOST_MACS = ("00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff")


def _arp(packets: DataFrame, *columns: str) -> DataFrame:
    require(packets, *columns)
    return arp_packets(packets)


def get_arp_table(packets: DataFrame) -> DataFrame:
    """IP to MAC bindings seen in either role, with first and last time and number of observations."""
    arp = _arp(packets, "timestamp", "ARP_sender_ip", "ARP_sender_mac")
    end = lambda role: F.struct(
        optional(packets, f"ARP_{role}_ip", "string").alias("ip_address"),
        optional(packets, f"ARP_{role}_mac", "string").alias("mac_address"))
    return (
        arp.select("timestamp", F.explode(F.array(end("sender"), end("target"))).alias("x")).select("timestamp", "x.*")
        .where(F.col("ip_address").isNotNull() & F.col("mac_address").isNotNull()
               & ~F.lower("mac_address").isin(*NO_HOST_MACS))
        .groupBy("ip_address", "mac_address")
        .agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
             F.count(F.lit(1)).alias("observations"))
    )


def _duplicates(packets: DataFrame, key: str, value: str, count: str) -> DataFrame:
    """Keys bound to several values: one row per key and value, with the number of values."""
    table = get_arp_table(packets).select(key, value)
    several = table.groupBy(key).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)
    return several.join(table, key).select(key, count, value)


def get_duplicate_ips(packets: DataFrame) -> DataFrame:
    """Addresses claimed by several MACs, one row per MAC."""
    return _duplicates(packets, "ip_address", "mac_address", "mac_count")


def get_duplicate_macs(packets: DataFrame) -> DataFrame:
    """MACs that claim several addresses, one row per address."""
    return _duplicates(packets, "mac_address", "ip_address", "ip_count")


def detect_arp_spoofing(packets: DataFrame, slice_width: str = "5m") -> DataFrame:
    """Every change of the MAC behind a sender address, in time order."""
    arp = _arp(packets, "timestamp", "ARP_sender_ip", "ARP_sender_mac").where(
        F.col("ARP_sender_ip").isNotNull() & F.col("ARP_sender_mac").isNotNull())
    rows = arp.select("timestamp", micros(packets).alias("_us"), F.col("ARP_sender_ip").alias("ip_address"),
                      F.col("ARP_sender_mac").alias("new_mac"),
                      F.coalesce(F.col("ARP_sender_ip") == optional(packets, "ARP_target_ip", "string"),
                                 F.lit(False)).alias("is_gratuitous"))
    changes = with_previous(rows, ["ip_address"], ["_us", "new_mac", "is_gratuitous"], ["new_mac"], slice_width)
    return changes.where(F.col("_prev.new_mac") != F.col("new_mac")).select(
        "ip_address", F.col("_prev.new_mac").alias("old_mac"), "new_mac", F.col("timestamp").alias("changed_at"),
        "is_gratuitous")


def detect_gratuitous_arp_flood(packets: DataFrame, threshold: int = 100) -> DataFrame:
    """MACs that send more than `threshold` gratuitous ARP packets (sender address = target address)."""
    positive("threshold", threshold)
    return (
        _arp(packets, "ARP_sender_ip", "ARP_target_ip", "ARP_sender_mac")
        .where(F.col("ARP_sender_ip") == F.col("ARP_target_ip"))
        .groupBy(F.col("ARP_sender_mac").alias("sender_mac")).agg(F.count(F.lit(1)).alias("packet_count"))
        .where(F.col("packet_count") > threshold).orderBy(F.desc("packet_count"), "sender_mac")
    )


def get_arp_request_response_ratio(packets: DataFrame) -> DataFrame:
    """Requests (opcode 1), responses (opcode 2), responses per request."""
    counts = _arp(packets, "ARP_opcode").agg(F.count_if(F.col("ARP_opcode") == 1).alias("requests"),
                                             F.count_if(F.col("ARP_opcode") == 2).alias("responses"))
    return counts.withColumn("ratio", ratio(F.col("responses"), F.col("requests")))


def detect_arp_scanning(packets: DataFrame, threshold: int = 20) -> DataFrame:
    """Senders that ask for at least `threshold` distinct addresses, and how sequential these are."""
    positive("threshold", threshold)
    asked = (
        _arp(packets, "ARP_opcode", "ARP_sender_ip", "ARP_target_ip")
        .where((F.col("ARP_opcode") == 1) & F.col("ARP_sender_ip").isNotNull() & F.col("ARP_target_ip").isNotNull())
        .groupBy(F.col("ARP_sender_ip").alias("sender_ip"), F.col("ARP_target_ip").alias("target_ip"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        sequential_share(asked, ["sender_ip"], ipv4_long(F.col("target_ip")),
                         {"requests": F.col("n"), "unique_targets": F.lit(1)})
        .where(F.col("unique_targets") >= threshold)
        .select("sender_ip", "requests", "unique_targets", "sequential_share")
        .orderBy(F.desc("unique_targets"), "sender_ip")
    )


def get_arp_packet_count(packets: DataFrame) -> DataFrame:
    return arp_packets(packets).agg(F.count(F.lit(1)).alias("count"))


def get_most_active_arp_ips(packets: DataFrame, n: int = 10) -> DataFrame:
    """Addresses by ARP packets in which they are sender or target."""
    positive("n", n)
    ends = F.array_distinct(F.array(*[F.col(c) for c in ("ARP_sender_ip", "ARP_target_ip") if c in packets.columns]))
    return (
        _arp(packets, "ARP_sender_ip").select(F.explode(ends).alias("ip_address"))
        .where(F.col("ip_address").isNotNull()).groupBy("ip_address").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "ip_address").limit(n)
    )
