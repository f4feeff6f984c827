"""Whole-table summaries and the per-host behaviour table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wirelake.errors import one_of
from wirelake.functions.scalars import has_flag, zero_if_null
from wirelake.functions.windows import tumbling
from wirelake.operators.filters import destination_ip, source_ip
from wirelake.operators.slices import sums_and_distincts
from wirelake.schema import PORT_COLUMNS, integral, length_column, require, seconds_between


def get_packet_count(packets: DataFrame) -> DataFrame:
    return packets.agg(F.count(F.lit(1)).alias("packet_count"))


def get_date_range(packets: DataFrame) -> DataFrame:
    """start, end and duration in seconds; nulls where the table has no timestamp."""
    if "timestamp" not in packets.columns:
        return packets.sparkSession.range(1).select(
            F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("timestamp_ntz").alias("end"),
            F.lit(None).cast("double").alias("duration"))
    return (
        packets.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
        .withColumn("duration", seconds_between("start", "end"))
    )


def view_tests(packets: DataFrame) -> dict[str, Column]:
    """Row tests of the protocol views; a protocol whose columns are absent matches nothing."""
    have = set(packets.columns)
    never = F.lit(False)
    proto = (lambda n: F.coalesce(integral(packets, "IP_proto") == n, never)) if "IP_proto" in have else (lambda n: never)
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, never)
    return {
        "tcp": proto(6),
        "udp": proto(17),
        "dns": any_of([F.coalesce(integral(packets, c) == 53, never) for c in PORT_COLUMNS if c in have]),
        "arp": any_of([F.col(c).isNotNull() for c in packets.columns if "ARP" in c]),
        "icmp": proto(1),
        "ip": F.lit(True),
    }


def get_analyzers_available(packets: DataFrame) -> DataFrame:
    """One row of booleans: whether each protocol view has rows. ip, flow and anomaly take every packet."""
    tests = view_tests(packets)
    tests["flow"] = tests["anomaly"] = tests["ip"]
    return packets.agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(n) for n, t in tests.items()])


def protocol_counts(packets: DataFrame) -> DataFrame:
    """Packets per protocol view in one pass (every packet counts as ip)."""
    counts = [F.count_if(t).alias(n) for n, t in view_tests(packets).items()]
    return packets.agg(F.count(F.lit(1)).alias("total"), *counts)


def protocol_distribution(packets: DataFrame) -> DataFrame:
    require(packets, "IP_proto")
    return packets.groupBy("IP_proto").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "IP_proto")


def unique_hosts(packets: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct addresses seen at either end. `approximate` uses a sketch instead of a shuffle of hosts."""
    hosts = packets.select(F.explode(F.array(source_ip(packets), destination_ip(packets))).alias("ip"))
    count = F.approx_count_distinct("ip") if approximate else F.count_distinct("ip")
    return hosts.agg(count.alias("unique_hosts"))


def _long(df: DataFrame, metrics: dict[tuple[str, str], Column]) -> DataFrame:
    """One row -> rows of (category, metric, value)."""
    entries = [F.struct(F.lit(category).alias("category"), F.lit(metric).alias("metric"),
                        value.cast("string").alias("value")) for (category, metric), value in metrics.items()]
    return df.select(F.explode(F.array(*entries)).alias("m")).select("m.*")


def generate_summary(packets: DataFrame, path: str | None = None) -> DataFrame:
    """The summary as rows of (category, metric, value): packet_counts, date_range, analyzers_available,
    protocols, general.unique_hosts and, when `path` is given, file_info.

    One scan: each packet becomes an entry for the totals, one for its protocol and one for each of its hosts; entries are
    combined inside tasks on (kind, value), and a second step counts hosts and lists protocols.
    """
    timed = "timestamp" in packets.columns
    tests = view_tests(packets)
    when = F.col("timestamp").cast("timestamp_ntz") if timed else F.lit(None).cast("timestamp_ntz")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    entries = [entry("total", F.lit(None)), entry("host", source_ip(packets)), entry("host", destination_ip(packets))]
    entries += [entry("protocol", F.col("IP_proto"))] if "IP_proto" in packets.columns else []
    rows = packets.select(F.explode(F.array(*entries)).alias("x"), *[t.cast("int").alias(f"is_{n}") for n, t in tests.items()],
                          when.alias("at"), F.lit(1).alias("one"))
    nothing = packets.sparkSession.range(1).select(F.explode(F.array(*[entry(k, F.lit(None)) for k in ("total", "host")])).alias("x"),
                                                   F.lit(0).alias("one"))  # so that an empty table has totals
    total = F.col("x.kind") == "total"
    combined = rows.unionByName(nothing, allowMissingColumns=True).groupBy("x.kind", "x.value").agg(
        F.sum("one").alias("n"), *[zero_if_null(F.sum(F.when(total, F.col(f"is_{n}")))).alias(n) for n in tests],
        F.min("at").alias("start"), F.max("at").alias("end"))
    protocol = F.when(F.col("kind") == "protocol", F.col("value"))
    found = combined.groupBy("kind", protocol.alias("value")).agg(
        F.sum("n").alias("n"), F.count("value").alias("hosts"), *[F.sum(n).alias(n) for n in tests],
        F.min("start").alias("start"), F.max("end").alias("end")).withColumn("duration", seconds_between("start", "end"))
    metrics = {("packet_counts", "total"): F.col("n")} | {("packet_counts", n): F.col(n) for n in tests}
    metrics |= {("date_range", n): F.col(n) for n in ("start", "end", "duration")}
    metrics |= {("analyzers_available", n): F.col(n) > 0 for n in tests}
    metrics |= {("analyzers_available", n): F.col("n") > 0 for n in ("flow", "anomaly")}
    shown = lambda wanted: F.array(*[F.struct(F.lit(c).alias("category"), m.alias("metric"), v.cast("string").alias("value"))
                                     for c, m, v in wanted])
    lists = F.when(F.col("kind") == "total", shown([(c, F.lit(m), v) for (c, m), v in metrics.items()])) \
        .when(F.col("kind") == "host", shown([("general", F.lit("unique_hosts"), F.col("hosts"))])) \
        .otherwise(shown([("protocols", F.coalesce("value", F.lit("None")), F.col("n"))]))
    parts = [found.select(F.explode(lists).alias("m")).select("m.*")]
    if path is not None:
        from wirelake.sources.parquet import get_file_info

        shown = ("path", "size_bytes", "size_mb", "size_formatted")
        parts.append(_long(get_file_info(packets.sparkSession, path), {("file_info", n): F.col(n) for n in shown}))
    return reduce(DataFrame.unionByName, parts)


def export_summary_report(packets: DataFrame, format: str, output: str, path: str | None = None) -> None:
    """Write `generate_summary` as json, csv or parquet."""
    one_of("format", format, ("json", "csv", "parquet"))
    writer = generate_summary(packets, path).write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(output)


def behavior_features(packets: DataFrame, group_by: str) -> tuple[DataFrame, dict, dict]:
    """(packets with the host in `group_by`, sums, distincts) of the behaviour table, as `sums_and_distincts` takes them.

    A feature is left out when its column is absent.
    """
    one_of("group_by", group_by, ("source_ip", "destination_ip"))
    require(packets, "timestamp")
    have, sending = set(packets.columns), group_by == "source_ip"
    host, peer = (source_ip, destination_ip) if sending else (destination_ip, source_ip)
    base = packets.withColumns({group_by: host(packets), "_peer": peer(packets)}).where(F.col(group_by).isNotNull())
    sums = {"packet_count": ("sum", F.lit(1)),
            "total_bytes_sent" if sending else "total_bytes_received":
                ("sum", F.coalesce(length_column(packets), F.lit(0)))}
    tests = {}
    if "IP_proto" in have:
        for name, number in (("tcp", 6), ("udp", 17), ("icmp", 1)):
            tests[f"{name}_packet_count"] = integral(packets, "IP_proto") == number
    if "TCP_flags" in have:
        for name, letter in (("syn", "S"), ("rst", "R"), ("fin", "F"), ("psh", "P")):
            tests[f"{name}_count"] = has_flag(F.col("TCP_flags"), letter)
    if "IP_flags" in have:
        tests["ip_fragment_count"] = F.col("IP_flags") == "MF"
        tests["ip_dont_fragment_count"] = F.col("IP_flags") == "DF"
    sums |= {name: ("sum", F.coalesce(test, F.lit(False)).cast("int")) for name, test in tests.items()}
    distincts = {"unique_dst_ip_count" if sending else "unique_src_ip_count": "_peer"}
    for column, name in (("TCP_dport", "unique_tcp_dst_port_count"), ("UDP_dport", "unique_udp_dst_port_count")):
        if column in have:
            distincts[name] = column
    return base, sums, distincts


def behavioral_summary(packets: DataFrame, time_window: str = "1m", group_by: str = "source_ip") -> DataFrame:
    """Feature table per (time window, host): volume, distinct peers and ports, protocol and flag counts.

    A feature is left out when its column is absent. See `sums_and_distincts` for the plan.
    """
    base, sums, distincts = behavior_features(packets, group_by)
    return sums_and_distincts(base.withColumn("window_start", tumbling(time_window).start), ["window_start", group_by], sums, distincts)
