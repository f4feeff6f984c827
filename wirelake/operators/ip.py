"""IP-level statistics over all packets that have an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelake.errors import InvalidThresholdError, one_of, positive
from wirelake.functions.addresses import in_subnet, is_private_ip
from wirelake.functions.lookups import DSCP_CLASSES, lookup, protocol_name
from wirelake.functions.scalars import has_flag, ratio, zero_if_null
from wirelake.operators.filters import destination_ip, find_ip_information, source_ip
from wirelake.schema import integral, length_column, optional, require


def pair_totals(packets: DataFrame) -> DataFrame:
    """Packets and bytes per (source, destination), ends that are missing kept as null.

    Every per-host figure below is rolled up from this table: the packets are shuffled once, combined on the
    map side and spread over pairs, so a host with a third of all packets is not one task.
    """
    return packets.groupBy(source_ip(packets).alias("src"), destination_ip(packets).alias("dst")).agg(
        F.count(F.lit(1)).alias("n"), zero_if_null(F.sum(length_column(packets))).alias("b"))


def _host_totals(packets: DataFrame) -> DataFrame:
    """Sent and received packets, bytes and distinct peers per address."""
    return _totals_of(pair_totals(packets))


def _totals_of(pairs: DataFrame) -> DataFrame:
    """`_host_totals` of `pair_totals`."""
    zero = F.lit(0).cast("bigint")
    sent = F.struct(F.col("src").alias("ip_address"), F.col("dst").alias("to"), F.lit(None).cast("string").alias("from"),
                    F.col("n").alias("ps"), F.col("b").alias("bs"), zero.alias("pr"), zero.alias("br"))
    received = F.struct(F.col("dst").alias("ip_address"), F.lit(None).cast("string").alias("to"), F.col("src").alias("from"),
                        zero.alias("ps"), zero.alias("bs"), F.col("n").alias("pr"), F.col("b").alias("br"))
    return (
        pairs.select(F.explode(F.array(sent, received)).alias("x")).select("x.*")
        .where(F.col("ip_address").isNotNull()).groupBy("ip_address")
        .agg(F.sum("ps").alias("packets_sent"), F.sum("bs").alias("bytes_sent"),
             F.sum("pr").alias("packets_received"), F.sum("br").alias("bytes_received"),
             F.count("to").alias("unique_destinations"), F.count("from").alias("unique_sources"))
    )


def _traffic(pairs: DataFrame) -> DataFrame:
    columns = ["ip_address", "packets_sent", "bytes_sent", "packets_received", "bytes_received"]
    return _totals_of(pairs).select(
        *columns, (F.col("packets_sent") + F.col("packets_received")).alias("total_packets"),
        (F.col("bytes_sent") + F.col("bytes_received")).alias("total_bytes"))


def get_most_active_ips(packets: DataFrame, n: int = 10, by: str = "packets") -> DataFrame:
    """Top addresses by packets or bytes, sent plus received."""
    one_of("by", by, ("packets", "bytes"))
    positive("n", n)
    return most_active(pair_totals(packets), n, by)


def most_active(pairs: DataFrame, n: int, by: str) -> DataFrame:
    """Top addresses of `pair_totals`."""
    return _traffic(pairs).orderBy(F.desc(f"total_{by}"), "ip_address").limit(n)


def get_sender_only_ips(packets: DataFrame) -> DataFrame:
    """Addresses that send and never receive."""
    return (
        _host_totals(packets).where(F.col("packets_received") == 0)
        .select("ip_address", "packets_sent", "bytes_sent", "unique_destinations")
        .orderBy(F.desc("packets_sent"), "ip_address")
    )


def get_receiver_only_ips(packets: DataFrame) -> DataFrame:
    """Addresses that receive and never send."""
    return (
        _host_totals(packets).where(F.col("packets_sent") == 0)
        .select("ip_address", "packets_received", "bytes_received", "unique_sources")
        .orderBy(F.desc("packets_received"), "ip_address")
    )


def get_asymmetric_ips(packets: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Addresses whose share of sent packets is above `threshold` or below 1 - `threshold`."""
    if not 0 <= threshold <= 1:
        raise InvalidThresholdError(f"threshold must lie in [0, 1], got {threshold}")
    return asymmetric(pair_totals(packets), threshold)


def asymmetric(pairs: DataFrame, threshold: float) -> DataFrame:
    """Unbalanced addresses of `pair_totals`."""
    share = ratio(F.col("packets_sent"), F.col("total_packets"), 0.5)
    return (
        _traffic(pairs).withColumn("send_ratio", share)
        .where((F.col("send_ratio") > threshold) | (F.col("send_ratio") < F.lit(1.0) - threshold))
        .orderBy(F.desc("total_packets"), "ip_address")
    )


def get_communication_matrix(packets: DataFrame) -> DataFrame:
    """Packets and bytes per (source, destination)."""
    return (
        pair_totals(packets).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        .select(F.col("src").alias("source_ip"), F.col("dst").alias("destination_ip"),
                F.col("n").alias("packets"), F.col("b").alias("bytes"))
    )


def detect_hub_ips(packets: DataFrame, threshold: int = 50) -> DataFrame:
    """Addresses with at least `threshold` distinct peers in either direction (itself is not a peer)."""
    positive("threshold", threshold)
    return hubs(packets.groupBy(source_ip(packets).alias("src"), destination_ip(packets).alias("dst")).agg(F.count(F.lit(1)).alias("n")), threshold)


def hubs(pairs: DataFrame, threshold: int) -> DataFrame:
    """Hubs of (src, dst, n)."""
    end = lambda me, other: F.struct(F.col(me).alias("ip_address"), F.col(other).alias("peer"), F.col("n"))
    return (
        pairs.where(F.col("src") != F.col("dst"))
        .select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("x")).select("x.*")
        .groupBy("ip_address").agg(F.count_distinct("peer").alias("unique_peers"), F.sum("n").alias("packets"))
        .where(F.col("unique_peers") >= threshold).orderBy(F.desc("unique_peers"), "ip_address")
    )


def get_ip_traffic_stats(packets: DataFrame, ip: str) -> DataFrame:
    """One row about an address: packets and bytes each way, protocols, peers, first and last packet."""
    mine = find_ip_information(packets, ip)
    size = zero_if_null(length_column(packets))
    flat = mine.select("timestamp", source_ip(packets).alias("src"), destination_ip(packets).alias("dst"),
                       size.alias("size"), optional(packets, "IP_proto", "int").cast("int").alias("proto"))
    sent, received = F.col("src") == ip, F.col("dst") == ip
    peer = F.when(sent, F.when(F.col("dst") != ip, F.col("dst"))).otherwise(F.col("src"))
    return flat.withColumn("peer", peer).agg(
        F.lit(ip).alias("ip_address"),
        F.count_if(sent).alias("packets_sent"), zero_if_null(F.sum(F.when(sent, F.col("size")))).alias("bytes_sent"),
        F.count_if(received).alias("packets_received"),
        zero_if_null(F.sum(F.when(received, F.col("size")))).alias("bytes_received"),
        # at most 256 protocol numbers
        F.array_join(F.array_sort(F.collect_set(protocol_name(F.col("proto")))), ",").alias("protocols"),
        F.count_distinct("peer").alias("unique_peers"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def _private_ends(packets: DataFrame) -> DataFrame:
    """Packets with the private flag of both ends."""
    return packets.withColumns({"_src_private": is_private_ip(source_ip(packets)),
                                "_dst_private": is_private_ip(destination_ip(packets))})


def get_internal_vs_external_ratio(packets: DataFrame) -> DataFrame:
    """Packets and share per direction, over packets with two valid addresses.

    Addresses are classified once per pair, not once per packet; the last step sees nine rows at most.
    """
    pairs = packets.groupBy(source_ip(packets).alias("src"), destination_ip(packets).alias("dst")).agg(
        F.count(F.lit(1)).alias("n"))
    counts = pairs.groupBy(is_private_ip(F.col("src")).alias("s"), is_private_ip(F.col("dst")).alias("d")).agg(
        F.sum("n").alias("packets"))
    direction = (F.when(F.col("s") & F.col("d"), "internal").when(F.col("s") & ~F.col("d"), "outbound")
                 .when(~F.col("s") & F.col("d"), "inbound").when(~F.col("s") & ~F.col("d"), "external"))
    valid = F.when(F.col("direction").isNotNull(), F.col("packets"))
    return (
        counts.select(direction.alias("direction"), "packets", F.lit(0).alias("_all"))
        .withColumn("ratio", ratio(F.col("packets"), F.sum(valid).over(Window.partitionBy("_all"))))
        .where(F.col("direction").isNotNull()).drop("_all")
    )


def identify_internal_network(packets: DataFrame, subnet: str) -> DataFrame:
    """Every address seen, and whether it lies in `subnet` (CIDR, IPv4 or IPv6)."""
    hosts = packets.select(F.explode(F.array(source_ip(packets), destination_ip(packets))).alias("ip_address"))
    return hosts.where(F.col("ip_address").isNotNull()).distinct().withColumn(
        "is_internal", in_subnet(F.col("ip_address"), subnet))


def get_border_traffic(packets: DataFrame) -> DataFrame:
    """Packets with exactly one private end."""
    return _private_ends(packets).where(F.col("_src_private") != F.col("_dst_private")).drop(
        "_src_private", "_dst_private")


def get_lateral_traffic(packets: DataFrame) -> DataFrame:
    """Packets with two private ends."""
    return _private_ends(packets).where(F.col("_src_private") & F.col("_dst_private")).drop(
        "_src_private", "_dst_private")


def is_fragment(packets: DataFrame) -> Column:
    """More-fragments flag set, or a fragment offset above 0."""
    more = F.coalesce(has_flag(optional(packets, "IP_flags", "string"), "MF"), F.lit(False))
    return more | F.coalesce(optional(packets, "IP_frag", "int") > 0, F.lit(False))


def get_fragmentation_stats(packets: DataFrame) -> DataFrame:
    """Packets, fragments, their ratio, and packets with the don't-fragment flag."""
    require(packets, "IP_flags")
    counts = packets.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_fragment(packets)).alias("fragmented"),
        F.count_if(has_flag(F.col("IP_flags"), "DF")).alias("dont_fragment"))
    return counts.withColumn("fragmentation_ratio", ratio(F.col("fragmented"), F.col("total")))


def _fragments_by_source(packets: DataFrame) -> DataFrame:
    require(packets, "IP_flags")
    return packets.where(is_fragment(packets)).groupBy(source_ip(packets).alias("src_ip")).agg(
        F.count(F.lit(1)).alias("fragments"))


def get_top_fragmenting_ips(packets: DataFrame, n: int = 10) -> DataFrame:
    positive("n", n)
    return _fragments_by_source(packets).orderBy(F.desc("fragments"), "src_ip").limit(n)


def detect_excessive_fragmentation(packets: DataFrame, threshold: int = 100) -> DataFrame:
    """Sources with more than `threshold` fragments."""
    positive("threshold", threshold)
    return (_fragments_by_source(packets).where(F.col("fragments") > threshold)
            .orderBy(F.desc("fragments"), "src_ip"))


def get_fragment_size_distribution(packets: DataFrame, bucket_bytes: int = 64) -> DataFrame:
    """Fragments per size bucket (lower bound shown)."""
    positive("bucket_bytes", bucket_bytes)
    bucket = (F.floor(length_column(packets) / bucket_bytes) * bucket_bytes).cast("bigint")
    return (packets.where(is_fragment(packets)).groupBy(bucket.alias("size_bucket"))
            .agg(F.count(F.lit(1)).alias("fragments")).orderBy("size_bucket"))


def _dscp(packets: DataFrame) -> Column:
    require(packets, "IP_tos")
    return F.shiftright(integral(packets, "IP_tos").cast("int"), 2)


def _class_name(dscp: Column) -> Column:
    return lookup(dscp, DSCP_CLASSES, "OTHER")


def analyze_tos_bits(packets: DataFrame) -> DataFrame:
    """Packets per TOS byte, with the name of its DSCP class."""
    require(packets, "IP_tos")
    return (
        packets.where(F.col("IP_tos").isNotNull()).groupBy(integral(packets, "IP_tos").cast("int").alias("tos"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("tos", _class_name(F.shiftright("tos", 2)).alias("class_name"), "count")
        .orderBy(F.desc("count"), "tos")
    )


def analyze_dscp_values(packets: DataFrame) -> DataFrame:
    """Packets per DSCP value (upper six TOS bits)."""
    return (
        packets.where(F.col("IP_tos").isNotNull()).groupBy(_dscp(packets).alias("dscp"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("dscp", _class_name(F.col("dscp")).alias("class_name"), "count")
        .orderBy(F.desc("count"), "dscp")
    )


def detect_priority_traffic(packets: DataFrame) -> DataFrame:
    """Packets marked EF (46) or AF4x / CS4-range 34..38."""
    dscp = _dscp(packets)
    return packets.where((dscp == 46) | dscp.between(34, 38))


def analyze_ecn_flags(packets: DataFrame) -> DataFrame:
    """Packets that are not ECN-capable, capable (1, 2, 3), and marked with congestion (3)."""
    require(packets, "IP_tos")
    ecn = integral(packets, "IP_tos").cast("int").bitwiseAND(3)
    return packets.agg(F.count_if(ecn == 0).alias("not_ect"), F.count_if(ecn.isin(1, 2, 3)).alias("ect"),
                       F.count_if(ecn == 3).alias("ce"), F.count("IP_tos").alias("total"))
