"""TCP statistics and detectors. Every function takes the packet table and looks at its TCP packets.

A connection is directional: (IP_src, IP_dst, TCP_sport, TCP_dport). Flag tests are substring tests on
TCP_flags, so a SYN count includes SYN-ACK packets, and null flags match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelake.errors import one_of, positive
from wirelake.functions.lookups import TCP_FLAG_NAMES, TCP_SERVICES, lookup
from wirelake.functions.scalars import has_flag, ratio, zero_if_null
from wirelake.functions.windows import parse_time_window, tumbling, window_seconds
from wirelake.operators.filters import tcp_packets
from wirelake.operators.slices import value_stats, with_position
from wirelake.schema import (CONNECTION_KEY, integral, length_column, micros, optional, require,
                             seconds_between)


def _tcp(packets: DataFrame, *columns: str) -> DataFrame:
    require(packets, *columns)
    return tcp_packets(packets)


def _flag(letter: str) -> Column:
    return has_flag(F.col("TCP_flags"), letter)


def get_connection_success_ratio(packets: DataFrame) -> DataFrame:
    """SYN-ACKs over SYN-ACKs plus RSTs; 0 when there are neither."""
    made, refused = F.count_if(_flag("S") & _flag("A")), F.count_if(_flag("R"))
    return _tcp(packets, "TCP_flags").agg(ratio(made, made + refused).alias("success_ratio"))


def detect_incomplete_connections(packets: DataFrame) -> DataFrame:
    """Connections with a SYN and no FIN."""
    return incomplete(
        _tcp(packets, *CONNECTION_KEY, "TCP_flags").groupBy(*CONNECTION_KEY)
        .agg(F.count_if(_flag("S")).alias("syn_count"), F.count_if(_flag("F")).alias("fin_count")))


def incomplete(connections: DataFrame) -> DataFrame:
    """Those of (connection key, syn_count, fin_count) with a SYN and no FIN."""
    return connections.where((F.col("syn_count") > 0) & (F.col("fin_count") == 0)).orderBy(F.desc("syn_count"), *CONNECTION_KEY)


def get_connection_duration_stats(packets: DataFrame) -> DataFrame:
    """min, max, mean, median of (last FIN - first SYN) in whole seconds; no row when no connection has both."""
    spans = (
        _tcp(packets, *CONNECTION_KEY, "TCP_flags", "timestamp").groupBy(*CONNECTION_KEY)
        .agg(F.min(F.when(_flag("S"), micros(packets))).alias("opened"),
             F.max(F.when(_flag("F"), micros(packets))).alias("closed"))
    )
    seconds = ((F.col("closed") - F.col("opened")) / 1e6).cast("bigint")
    stats = value_stats(spans, seconds, {"median": 0.5})
    return stats.select("min", "max", F.col("avg").alias("mean"), "median")


def connection_durations(packets: DataFrame) -> DataFrame:
    """start, end and duration (seconds) per connection."""
    return (
        _tcp(packets, *CONNECTION_KEY, "timestamp").groupBy(*CONNECTION_KEY)
        .agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
        .withColumn("duration_s", seconds_between("start_time", "end_time"))
    )


def identify_long_lived_connections(packets: DataFrame, threshold: str = "5m") -> DataFrame:
    limit = window_seconds(threshold)
    return (connection_durations(packets).where(F.col("duration_s") > limit)
            .orderBy(F.desc("duration_s"), *CONNECTION_KEY))


def identify_short_lived_connections(packets: DataFrame, threshold: str) -> DataFrame:
    limit = window_seconds(threshold)
    return (connection_durations(packets).where(F.col("duration_s") < limit)
            .orderBy("duration_s", *CONNECTION_KEY))


def get_handshake_analysis(packets: DataFrame) -> DataFrame:
    """Packets per handshake step, and how many whole handshakes they can make."""
    steps = _tcp(packets, "TCP_flags").agg(
        F.count_if(_flag("S") & ~_flag("A")).alias("total_syn"),
        F.count_if(_flag("S") & _flag("A")).alias("total_syn_ack"),
        F.count_if(_flag("A") & ~_flag("S") & ~_flag("R") & ~_flag("F")).alias("total_ack"))
    return (steps.withColumn("complete_handshakes", F.least("total_syn", "total_syn_ack", "total_ack"))
            .withColumn("incomplete_handshakes", F.col("total_syn") - F.col("complete_handshakes")))


def get_flag_distribution(packets: DataFrame) -> DataFrame:
    """Packets per flag and their percent of all TCP packets (null flags included in the base)."""
    counts = _tcp(packets, "TCP_flags").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(_flag(x)).alias(x) for x in TCP_FLAG_NAMES])
    entries = F.array(*[
        F.struct(F.lit(name).alias("flag"), F.lit(x).alias("flag_char"), F.col(x).alias("count"),
                 ratio(F.col(x) * 100, F.col("total")).alias("percentage"))
        for x, name in TCP_FLAG_NAMES.items()])
    return counts.select(F.explode(entries).alias("e")).select("e.*").orderBy(F.desc("count"), "flag")


def _flag_count(packets: DataFrame, letter: str) -> DataFrame:
    return _tcp(packets, "TCP_flags").agg(F.count_if(_flag(letter)).alias("count"))


def get_syn_count(packets: DataFrame) -> DataFrame:
    """Packets with SYN, SYN-ACKs included."""
    return _flag_count(packets, "S")


def get_rst_count(packets: DataFrame) -> DataFrame:
    return _flag_count(packets, "R")


def get_fin_count(packets: DataFrame) -> DataFrame:
    return _flag_count(packets, "F")


def get_ack_count(packets: DataFrame) -> DataFrame:
    return _flag_count(packets, "A")


def get_psh_count(packets: DataFrame) -> DataFrame:
    return _flag_count(packets, "P")


def analyze_flag_sequences(packets: DataFrame) -> DataFrame:
    """Flags of each connection in time order: one row per packet with its `position` (from 1) and the connection's
    `packet_count`. `flag_text` joins the flags of chosen connections.

    Every connection has this grain, whatever its size; equal times are ordered by sequence number, then flags. Packets
    without a time come after all others, by sequence number; packets without flags are left out.
    """
    tcp = _tcp(packets, *CONNECTION_KEY, "TCP_flags", "timestamp").where(F.col("TCP_flags").isNotNull())
    seq = optional(packets, "TCP_seq", "bigint")
    late = F.lit(1 << 60) + F.coalesce(F.greatest(seq, F.lit(0)) + 1, F.lit(0))  # cut into slices like times
    tcp = tcp.select(*CONNECTION_KEY, "TCP_flags", F.coalesce(micros(packets), late).alias("_us"), seq.alias("_seq"))
    placed = with_position(tcp, CONNECTION_KEY, ["_us", "_seq", "TCP_flags"], total="packet_count")
    return placed.select(*CONNECTION_KEY, "position", "TCP_flags", "packet_count")


def flag_text(sequences: DataFrame) -> DataFrame:
    """Flags joined by spaces, one row per connection: for connections that the caller has chosen."""
    entries = F.array_sort(F.collect_list(F.struct("position", "TCP_flags")))
    return sequences.groupBy(*CONNECTION_KEY, "packet_count").agg(
        F.array_join(F.transform(entries, lambda e: e["TCP_flags"]), " ").alias("flag_sequence"))


def get_window_size_stats(packets: DataFrame) -> DataFrame:
    """min, max, mean, median, std (ddof 1) of TCP_window; no row when it is never set."""
    _tcp(packets, "TCP_window")
    size = integral(packets, "TCP_window").cast("int")
    # A window is 16 bits wide, so the value table behind `median` is bounded.
    stats = tcp_packets(packets).agg(
        F.count(size).alias("n"), F.min(size).alias("min"), F.max(size).alias("max"), F.avg(size).alias("mean"),
        F.median(size).alias("median"), F.stddev_samp(size).alias("std"))
    return stats.where(F.col("n") > 0).drop("n")


def detect_retransmissions(packets: DataFrame) -> DataFrame:
    """Sequence numbers seen more than once in a connection."""
    key = [*CONNECTION_KEY, "TCP_seq"]
    return (
        _tcp(packets, *key).groupBy(*key).agg(F.count(F.lit(1)).alias("seq_count"))
        .where(F.col("seq_count") > 1).orderBy(F.desc("seq_count"), *key)
    )


def get_throughput_by_connection(packets: DataFrame) -> DataFrame:
    """Bytes, duration and bytes per second of connections that last longer than an instant."""
    return (
        _tcp(packets, *CONNECTION_KEY, "timestamp").groupBy(*CONNECTION_KEY)
        .agg(zero_if_null(F.sum(length_column(packets))).alias("total_bytes"),
             F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
        .withColumn("duration_s", seconds_between("start_time", "end_time"))
        .where(F.col("duration_s") > 0)
        .withColumn("bytes_per_sec", F.col("total_bytes") / F.col("duration_s"))
        .select(*CONNECTION_KEY, "total_bytes", "duration_s", "bytes_per_sec")
        .orderBy(F.desc("bytes_per_sec"), *CONNECTION_KEY)
    )


def get_most_used_ports(packets: DataFrame, n: int = 10) -> DataFrame:
    """Top destination ports with service name and percent of all TCP packets."""
    positive("n", n)
    # One row per port (16 bits), so the total is taken over the counts and the packets are read once.
    counts = _tcp(packets, "TCP_dport").groupBy("TCP_dport").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("_all"))
    return (
        counts.withColumn("_all", F.lit(0)).withColumn("percentage", F.col("count") * 100.0 / total)
        .where(F.col("TCP_dport").isNotNull()).orderBy(F.desc("count"), "TCP_dport").limit(n)
        .select("TCP_dport", lookup(F.col("TCP_dport"), TCP_SERVICES, "Unknown").alias("service_name"), "count",
                "percentage")
    )


def detect_non_standard_ports(packets: DataFrame, min_packets: int = 100) -> DataFrame:
    """Ephemeral destination ports (49152..65535) that take more than `min_packets` packets on a host."""
    return (
        _tcp(packets, "IP_dst", "TCP_dport").where(F.col("TCP_dport").between(49152, 65535))
        .groupBy("IP_dst", "TCP_dport").agg(F.count(F.lit(1)).alias("packet_count"))
        .where(F.col("packet_count") > min_packets).orderBy(F.desc("packet_count"), "IP_dst", "TCP_dport")
    )


def get_ephemeral_vs_wellknown_ratio(packets: DataFrame) -> DataFrame:
    """Packets per destination port class and their percent of all TCP packets."""
    port = F.col("TCP_dport")
    counts = _tcp(packets, "TCP_dport").agg(
        F.count_if((port >= 0) & (port < 1024)).alias("well_known"),
        F.count_if((port >= 1024) & (port < 49152)).alias("registered"),
        F.count_if((port >= 49152) & (port < 65536)).alias("ephemeral"),
        F.count(F.lit(1)).alias("total"))
    return counts.withColumns({
        f"{c}_percent": ratio(F.col(c) * 100, F.col("total")) for c in ("well_known", "registered", "ephemeral")})


@dataclass(frozen=True)
class PortScanConfig:
    """Distinct ports a pair may use per window, the window, and a label."""

    threshold: int
    time_window: str
    sensitivity: str
    description: str = "Custom configuration"


# The built-in scan profiles.
SCAN_PROFILES = {
    "aggressive": PortScanConfig(15, "1m", "high", "fast, aggressive scans"),
    "balanced": PortScanConfig(20, "5m", "medium", "typical enterprise networks"),
    "stealth": PortScanConfig(25, "30m", "low", "slow scans that try to stay unseen"),
    "honeypot": PortScanConfig(5, "1m", "very_high", "maximum sensitivity"),
}


def custom_scan_config(threshold: int, time_window: str, description: str = "Custom configuration") -> PortScanConfig:
    """A config whose sensitivity label follows from the threshold."""
    positive("threshold", threshold)
    parse_time_window(time_window)
    labels = ((10, "very_high"), (20, "high"), (30, "medium"))
    label = next((name for limit, name in labels if threshold < limit), "low")
    return PortScanConfig(threshold, time_window, label, description)


def scan_config(config: PortScanConfig | str | None, threshold: int | None, time_window: str | None,
                default: PortScanConfig) -> PortScanConfig:
    """Resolve a config, a profile name, or loose parameters (either may be left out)."""
    if isinstance(config, PortScanConfig):
        return config
    if config is not None and config != "custom":
        return SCAN_PROFILES[one_of("profile", config, SCAN_PROFILES)]
    if threshold is None and time_window is None:
        return default
    return custom_scan_config(default.threshold if threshold is None else threshold,
                              time_window or default.time_window)


def port_scans(packets: DataFrame, port: Column, config: PortScanConfig, ports_contacted: bool = True) -> DataFrame:
    """Pairs of hosts with more than `config.threshold` distinct destination ports in a tumbling window.

    The distinct count shuffles on (window, pair, port), so a scanner that sends a third of all packets is
    spread over its ports. With `ports_contacted` the packets of the pairs found are read again: one row per
    packet with a port, in time order (`position`, from 1), repeats kept. Every scan has this grain, whatever its size.
    """
    positive("threshold", config.threshold)
    base = packets.select(F.col("IP_src").alias("scanner_ip"), F.col("IP_dst").alias("target_ip"), "timestamp",
                          port.alias("_port"), tumbling(config.time_window).start.alias("window_start"))
    key = ["window_start", "scanner_ip", "target_ip"]
    found = scans_of_ports(
        base.groupBy(*key, "_port")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("timestamp").alias("_a"), F.max("timestamp").alias("_z")), config.threshold)
    if not ports_contacted:
        return found.orderBy(F.desc("unique_ports"), *key)
    rows = base.withColumn("_us", micros(base)).where(F.col("_port").isNotNull())
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key]
    rows = rows.alias("r").join(found.alias("f"), same).select("f.*", "r._us", "r._port")
    placed = with_position(rows, key, ["_us", "_port"])
    return placed.select(*found.columns, "position", F.col("_port").alias("port"))


def scans_of_ports(ports: DataFrame, threshold: int) -> DataFrame:
    """Scans from (window_start, scanner_ip, target_ip, _port, _n, _a, _z): packets to each port, the first and the last."""
    return (
        ports.groupBy("window_start", "scanner_ip", "target_ip")
        .agg(F.count("_port").alias("unique_ports"), F.sum("_n").alias("total_packets"),
             F.min("_a").alias("scan_start"), F.max("_z").alias("scan_end"))
        .where(F.col("unique_ports") > threshold)
        .withColumn("scan_duration_s", seconds_between("scan_start", "scan_end"))
        .withColumn("severity", F.when(F.col("unique_ports") > 50, "critical")
                    .when(F.col("unique_ports") > 30, "high").otherwise("medium"))
    )


def detect_port_scanning(packets: DataFrame, config: PortScanConfig | str | None = None,
                         threshold: int | None = None, time_window: str | None = None,
                         ports_contacted: bool = True) -> DataFrame:
    """TCP port scans; see `port_scans`. Profiles: aggressive, balanced (default), stealth, honeypot."""
    tcp = _tcp(packets, "timestamp", "IP_src", "IP_dst", "TCP_dport")
    resolved = scan_config(config, threshold, time_window, SCAN_PROFILES["balanced"])
    return port_scans(tcp, integral(tcp, "TCP_dport").cast("int"), resolved, ports_contacted)
