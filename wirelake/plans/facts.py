"""What the daily audit needs of a packet table, gathered in one pass and a narrow second one.

Each packet is expanded once to entries (kind, key) with mergeable partial states: one for its minute, pair of hosts and
destination port, one for its connection. Entries are combined inside tasks before one shuffle, and the result is
written to the shared folder; every check then rolls the written table up to its own key. Keys are fine, so a host with a
third of all packets is spread over its minutes, peers and ports. Packets of the small protocols (DNS, ARP, ICMP), whose
checks look at single packets, are written as they are.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wirelake.functions.scalars import has_flag, zero_if_null
from wirelake.functions.windows import tumbling
from wirelake.operators.anomaly import _port, off_hours
from wirelake.operators.filters import destination_ip, source_ip
from wirelake.operators.summary import view_tests
from wirelake.schema import CONNECTION_KEY, integral, length_column, optional, require
from wirelake.session import scratch_path

TRAFFIC, CONNECTION = 0, 1
#: Columns of the packets that are kept as they are, by how their names begin.
_KEPT = ("timestamp", "raw_size", "IP", "TCP_sport", "TCP_dport", "UDP_sport", "UDP_dport", "DNS", "ARP", "ICMP")


@dataclass(frozen=True)
class Facts:
    """`sums` has one row per entry; `minor` the packets of DNS, ARP and ICMP."""

    sums: DataFrame
    minor: DataFrame

    @property
    def traffic(self) -> DataFrame:
        """(minute, src_ip, dst_ip, dst_port, udp) with n, bytes, syn, syn_ack, first, last, off_n, off_bytes."""
        return self.sums.where(F.col("kind") == TRAFFIC)

    @property
    def connections(self) -> DataFrame:
        """(connection key, syn_count, fin_count) of TCP packets."""
        names = zip(CONNECTION_KEY, ("src_ip", "dst_ip", "src_port", "dst_port"))
        return self.sums.where(F.col("kind") == CONNECTION).select(
            *[F.col(c).alias(n) for n, c in names], F.col("any_syn").alias("syn_count"), F.col("fin").alias("fin_count"))

    @property
    def pairs(self) -> DataFrame:
        """(src, dst, n packets, b bytes), as `ip.pair_totals`."""
        return self.traffic.groupBy(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst")).agg(
            F.sum("n").alias("n"), F.sum("bytes").alias("b"))

    def ports(self) -> DataFrame:
        """(window_start, scanner_ip, target_ip, _port, _n, _a, _z) per minute, for `tcp.scans_of_ports`."""
        return self.traffic.where(F.col("dst_port").isNotNull()).groupBy(
            F.col("minute").alias("window_start"), F.col("src_ip").alias("scanner_ip"), F.col("dst_ip").alias("target_ip"),
            F.col("dst_port").alias("_port")).agg(F.sum("n").alias("_n"), F.min("first").alias("_a"), F.max("last").alias("_z"))

    def syn_counts(self) -> DataFrame:
        """(window_start, src_ip, syn_count, syn_ack_received) per minute: a SYN counts for its sender, a SYN-ACK for its receiver."""
        none = F.lit(0).cast("bigint")
        sides = F.array(F.struct(F.col("src_ip"), F.col("syn"), none.alias("syn_ack")),
                        F.struct(F.col("dst_ip").alias("src_ip"), none.alias("syn"), F.col("syn_ack")))
        return self.traffic.where((F.col("syn") > 0) | (F.col("syn_ack") > 0)).select("minute", F.explode(sides).alias("x")) \
            .groupBy(F.col("minute").alias("window_start"), F.col("x.src_ip").alias("src_ip")).agg(
                F.sum("x.syn").alias("syn_count"), F.sum("x.syn_ack").alias("syn_ack_received"))

    def udp_counts(self) -> DataFrame:
        """(window_start, src_ip, packet_count) of UDP packets per minute."""
        return self.traffic.where("udp").groupBy(F.col("minute").alias("window_start"), "src_ip").agg(F.sum("n").alias("packet_count"))

    def off_hours(self) -> DataFrame:
        """(src_ip, packets) outside business hours."""
        return self.traffic.where((F.col("off_n") > 0) & F.col("src_ip").isNotNull()).groupBy("src_ip").agg(F.sum("off_n").alias("packets"))

    def totals(self) -> DataFrame:
        """One row: n packets, the first and the last time."""
        return self.traffic.agg(zero_if_null(F.sum("n")).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def gather(packets: DataFrame, business_hours=(9, 17)) -> Facts:
    """The facts of a packet table, computed now: two scans of it, side by side."""
    require(packets, "timestamp", "IP_proto", "TCP_flags", "IP_len", *CONNECTION_KEY)
    flags = F.col("TCP_flags")
    syn, ack = has_flag(flags, "S"), has_flag(flags, "A")
    proto = integral(packets, "IP_proto")
    yes = lambda test: F.coalesce(test, F.lit(False)).cast("int")
    key = lambda kind, minute, src, dst, sport, dport, udp: F.struct(
        F.lit(kind).alias("kind"), minute.alias("minute"), src.alias("src_ip"), dst.alias("dst_ip"), sport.cast("int").alias("src_port"),
        dport.cast("int").alias("dst_port"), udp.alias("udp"))
    empty = F.lit(None)
    traffic = key(TRAFFIC, tumbling("1m").start, source_ip(packets), destination_ip(packets), empty, _port(packets, "dport"),
                  F.coalesce(proto == 17, F.lit(False)))
    connection = F.when(proto == 6, key(CONNECTION, empty.cast("timestamp_ntz"), F.col("IP_src"), F.col("IP_dst"), integral(packets, "TCP_sport"),
                                        integral(packets, "TCP_dport"), F.lit(False)))
    off, size = yes(off_hours(business_hours)), zero_if_null(length_column(packets))
    rows = packets.select(F.explode(F.array(traffic, connection)).alias("key"), "timestamp", size.alias("bytes"), yes(syn & ~ack).alias("syn"),
                          yes(syn & ack).alias("syn_ack"), yes(syn).alias("any_syn"), yes(has_flag(flags, "F")).alias("fin"), off.alias("off_n")) \
        .where(F.col("key").isNotNull())
    sums = rows.groupBy(*[F.col(f"key.{c}").alias(c) for c in ("kind", "minute", "src_ip", "dst_ip", "src_port", "dst_port", "udp")]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("bytes", "syn", "syn_ack", "any_syn", "fin", "off_n")],
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    tests = view_tests(packets)
    minor = packets.where(tests["dns"] | tests["arp"] | tests["icmp"]).select(*[c for c in packets.columns if c.startswith(_KEPT)])

    def store(part: tuple[str, DataFrame]) -> DataFrame:
        name, df = part
        path = scratch_path(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    with ThreadPoolExecutor(2) as pool:
        return Facts(*pool.map(store, (("sums", sums), ("minor", minor))))
