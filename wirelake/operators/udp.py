"""UDP statistics and detectors over the packet table. Addresses are the IPv4 ones, else the IPv6 ones, per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wirelake.errors import InvalidThresholdError, positive
from wirelake.functions.lookups import AMPLIFIER_PORTS, UDP_SERVICES, classify_port, lookup
from wirelake.functions.scalars import create_flow_id, safe_cast_to_int, zero_if_null
from wirelake.functions.windows import tumbling, window_seconds
from wirelake.operators.filters import destination_ip, source_ip, udp_packets
from wirelake.operators.slices import sums_and_distincts
from wirelake.schema import integral, length_column, optional, require, whole_seconds_between


def _udp(packets: DataFrame, *columns: str, ports_as_zero: bool = False) -> DataFrame:
    """UDP packets as (timestamp, src_ip, dst_ip, src_port, dst_port, length) with the columns needed."""
    require(packets, *columns)
    port = (lambda c: F.coalesce(c, F.lit(0))) if ports_as_zero else (lambda c: c)
    names = {
        "timestamp": optional(packets, "timestamp", "timestamp_ntz"),
        "src_ip": source_ip(packets),
        "dst_ip": destination_ip(packets),
        "src_port": port(integral(packets, "UDP_sport").cast("int") if "UDP_sport" in packets.columns
                         else F.lit(None).cast("int")),
        "dst_port": port(integral(packets, "UDP_dport").cast("int") if "UDP_dport" in packets.columns
                         else F.lit(None).cast("int")),
        "length": length_column(packets) if "IP_len" in packets.columns else F.lit(None).cast("bigint"),
    }
    return udp_packets(packets).select(*[c.alias(n) for n, c in names.items()])


def detect_unidirectional_traffic(packets: DataFrame) -> DataFrame:
    """Flows whose reverse 4-tuple never occurs.

    Both directions share a key with the smaller endpoint first, so one aggregation sees both; no self join.
    A flow whose two endpoints are equal is its own reverse and is left out, as are rows with a null part.
    """
    flows = _udp(packets, "UDP_sport", "UDP_dport", "timestamp", "IP_len").dropna(
        subset=["src_ip", "dst_ip", "src_port", "dst_port"])
    src, dst = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    flows = flows.where(src != dst).withColumn("_up", src < dst)
    ends = {"ip_a": ("src_ip", "dst_ip"), "port_a": ("src_port", "dst_port"),
            "ip_b": ("dst_ip", "src_ip"), "port_b": ("dst_port", "src_port")}
    for name, (up, down) in ends.items():
        flows = flows.withColumn(name, F.when(F.col("_up"), F.col(up)).otherwise(F.col(down)))
    one_way = (
        flows.groupBy(*ends)
        .agg(F.bool_and("_up").alias("_all_up"), F.bool_or("_up").alias("_any_up"),
             F.count(F.lit(1)).alias("packet_count"), zero_if_null(F.sum("length")).alias("total_bytes"),
             F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        .where(F.col("_all_up") == F.col("_any_up"))
    )
    pick = lambda up, down: F.when(F.col("_any_up"), F.col(up)).otherwise(F.col(down))
    return one_way.select(
        pick("ip_a", "ip_b").alias("src_ip"), pick("ip_b", "ip_a").alias("dst_ip"),
        pick("port_a", "port_b").alias("src_port"), pick("port_b", "port_a").alias("dst_port"),
        "packet_count", "total_bytes", "first_seen", "last_seen",
    ).orderBy(F.desc("packet_count"), "src_ip", "dst_ip", "src_port", "dst_port")


def get_most_used_ports(packets: DataFrame, n: int = 10) -> DataFrame:
    """Top destination ports (null reads as port 0) with packets, distinct sources, name and class."""
    positive("n", n)
    top = (
        _udp(packets, "UDP_dport", ports_as_zero=True)
        .groupBy(F.col("dst_port").alias("port"))
        .agg(F.count(F.lit(1)).alias("count"), F.count_distinct("src_ip").alias("unique_sources"))
        .orderBy(F.desc("count"), "port").limit(n)
    )
    return top.withColumns({"port_name": lookup(F.col("port"), UDP_SERVICES, "Unknown"),
                            "port_class": classify_port(F.col("port"))})


def get_udp_flow_stats(packets: DataFrame) -> DataFrame:
    """Per directional flow: packets, bytes, mean size, first and last packet, whole seconds between them.

    Null ports and lengths read as 0.
    """
    key = ["src_ip", "dst_ip", "src_port", "dst_port"]
    size = safe_cast_to_int(F.col("length"))
    return (
        _udp(packets, "UDP_sport", "UDP_dport", "timestamp", "IP_len", ports_as_zero=True).groupBy(*key)
        .agg(F.count(F.lit(1)).alias("packet_count"), F.sum(size).alias("total_bytes"),
             F.avg(size).alias("avg_packet_size"),
             F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
        .withColumn("duration_seconds", whole_seconds_between("first_seen", "last_seen"))
        .withColumn("flow_id", create_flow_id(*[F.col(c) for c in key], F.lit("UDP")))
        .orderBy(F.desc("packet_count"), *key)
    )


def calculate_packet_rate(packets: DataFrame, time_window: str = "1m") -> DataFrame:
    """Packets and bytes per tumbling window, and per second of it; windows without packets give no row."""
    seconds = window_seconds(time_window)
    return (
        _udp(packets, "timestamp", "IP_len").groupBy(tumbling(time_window).alias("w"))
        .agg(F.count(F.lit(1)).alias("packet_count"), zero_if_null(F.sum("length")).alias("byte_count"))
        .select(F.col("w.start").alias("window_start"), "packet_count", "byte_count",
                (F.col("packet_count") / seconds).alias("packets_per_second"),
                (F.col("byte_count") / seconds).alias("bytes_per_second"))
        .orderBy("window_start")
    )


def detect_udp_flood(packets: DataFrame, threshold: int = 1000, time_window: str = "1m") -> DataFrame:
    """Sources with at least `threshold` UDP packets in a window."""
    positive("threshold", threshold)
    base = _udp(packets, "timestamp", "IP_len").withColumn("window_start", tumbling(time_window).start)
    sums = {"packet_count": ("sum", F.lit(1)), "byte_count": ("sum", F.coalesce("length", F.lit(0)))}
    return (
        sums_and_distincts(base, ["window_start", "src_ip"], sums,
                           {"unique_destinations": "dst_ip", "unique_ports": "dst_port"})
        .where(F.col("packet_count") >= threshold)
        .orderBy(F.desc("packet_count"), "window_start", "src_ip")
    )


def detect_udp_amplification(packets: DataFrame, min_amplification_ratio: float = 10.0) -> DataFrame:
    """Client / reflector pairs of an amplifying service whose responses are much larger than the requests.

    A packet is a request when its destination port is such a service and a response when its source port is;
    one with both counts on both sides. Both sides meet in one aggregation keyed (reflector, port, client).
    """
    if min_amplification_ratio <= 1:
        raise InvalidThresholdError(f"min_amplification_ratio must be above 1, got {min_amplification_ratio}")
    role = lambda name, reflector, port, client: F.when(
        F.col(port).isin(*AMPLIFIER_PORTS),
        F.struct(F.lit(name).alias("role"), F.col(reflector).alias("reflector_ip"),
                 F.col(port).alias("service_port"), F.col(client).alias("victim_ip")))
    roles = F.array(role("request", "dst_ip", "dst_port", "src_ip"), role("response", "src_ip", "src_port", "dst_ip"))
    is_request, is_response = F.col("role") == "request", F.col("role") == "response"
    size = F.col("length")
    return (
        _udp(packets, "UDP_sport", "UDP_dport", "IP_len").select("length", F.explode(roles).alias("r"))
        .select("length", "r.*").where(F.col("victim_ip").isNotNull() & F.col("reflector_ip").isNotNull())
        .groupBy("victim_ip", "reflector_ip", "service_port")
        .agg(F.count_if(is_request).alias("request_count"), F.avg(F.when(is_request, size)).alias("avg_request_size"),
             F.count_if(is_response).alias("_responses"), F.avg(F.when(is_response, size)).alias("avg_response_size"))
        .where((F.col("request_count") > 0) & (F.col("_responses") > 0)).drop("_responses")
        .withColumn("amplification_ratio", F.try_divide("avg_response_size", "avg_request_size"))
        .where(F.col("amplification_ratio") >= min_amplification_ratio)
        .orderBy(F.desc("amplification_ratio"), "victim_ip", "reflector_ip", "service_port")
    )


def identify_udp_scan(packets: DataFrame, threshold: int = 100) -> DataFrame:
    """Sources that touch at least `threshold` distinct destination ports."""
    positive("threshold", threshold)
    sums = {"total_packets": ("sum", F.lit(1)), "first_seen": ("min", F.col("timestamp")),
            "last_seen": ("max", F.col("timestamp"))}
    return (
        sums_and_distincts(_udp(packets, "UDP_dport", "timestamp"), ["src_ip"], sums,
                           {"unique_ports_scanned": "dst_port", "unique_destinations": "dst_ip"})
        .withColumn("scan_duration_seconds", whole_seconds_between("first_seen", "last_seen"))
        .where(F.col("unique_ports_scanned") >= threshold)
        .orderBy(F.desc("unique_ports_scanned"), "src_ip")
    )
