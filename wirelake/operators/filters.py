"""Protocol views, address filters and row selections over the packet table."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wirelake.errors import EmptyTableError, one_of, positive
from wirelake.operators.slices import value_stats
from wirelake.schema import PORT_COLUMNS, integral, micros, require

# Protocol names accepted by `get_by_protocol`.
PROTOCOLS = ("TCP", "UDP", "IP", "IPv6", "DHCP", "DNS", "ARP", "ICMP")


def get_by_protocol(packets: DataFrame, protocol: str) -> DataFrame:
    """The columns whose name contains `protocol` (case matters; 'IP' also matches IPv6 columns)."""
    one_of("protocol", protocol, PROTOCOLS)
    return packets.select([c for c in packets.columns if protocol in c])


def find_ip_information(packets: DataFrame, ip: str) -> DataFrame:
    """Packets sent or received by an address, over the IPv4 and IPv6 columns."""
    ends = [c for c in ("IP_src", "IP_dst", "IPv6_src", "IPv6_dst") if c in packets.columns]
    if not ends:
        return packets.where(F.lit(False))
    return packets.where(reduce(or_, [F.col(c) == ip for c in ends]))


def get_timestamps(packets: DataFrame) -> DataFrame:
    return packets.select([c for c in packets.columns if "timestamp" in c])


def get_timestamps_by_ip(packets: DataFrame, ip: str) -> DataFrame:
    return get_timestamps(find_ip_information(packets, ip))


def _protocol(packets: DataFrame, number: int, include_ipv6: bool, v6_number: int | None = None) -> DataFrame:
    require(packets, "IP_proto")
    test = integral(packets, "IP_proto") == number
    if include_ipv6 and "IPv6_nh" in packets.columns:
        test = test | (F.col("IP_proto").isNull() & (F.col("IPv6_nh") == (v6_number or number)))
    return packets.where(test)


def tcp_packets(packets: DataFrame, include_ipv6: bool = False) -> DataFrame:
    return _protocol(packets, 6, include_ipv6)


def udp_packets(packets: DataFrame, include_ipv6: bool = False) -> DataFrame:
    return _protocol(packets, 17, include_ipv6)


def icmp_packets(packets: DataFrame, include_ipv6: bool = False) -> DataFrame:
    """IP protocol 1 (58 over IPv6 when asked for); no rows where the table has no IP_proto."""
    if "IP_proto" not in packets.columns:
        return packets.where(F.lit(False))
    return _protocol(packets, 1, include_ipv6, 58)


def dns_packets(packets: DataFrame) -> DataFrame:
    """Packets with port 53 at either end, over UDP or TCP."""
    ports = [c for c in PORT_COLUMNS if c in packets.columns]
    if not ports:
        return packets.where(F.lit(False))
    return packets.where(reduce(or_, [integral(packets, c) == 53 for c in ports]))


def arp_packets(packets: DataFrame) -> DataFrame:
    """Packets with any ARP field; no rows where the table has no ARP column."""
    columns = [c for c in packets.columns if "ARP" in c]
    if not columns:
        return packets.where(F.lit(False))
    return packets.where(reduce(or_, [F.col(c).isNotNull() for c in columns]))


def check_rows(packets: DataFrame, what: str) -> DataFrame:
    """Opt-in check that a view has rows (runs a job that stops at the first row found)."""
    if packets.isEmpty():
        raise EmptyTableError(f"no {what} packets")
    return packets


def _unified(packets: DataFrame, end: str) -> Column:
    columns = [c for c in (f"IP_{end}", f"IPv6_{end}") if c in packets.columns]
    if not columns:
        require(packets, f"IP_{end}")
    return F.coalesce(*[F.col(c) for c in columns])


def source_ip(packets: DataFrame) -> Column:
    return _unified(packets, "src")


def destination_ip(packets: DataFrame) -> Column:
    return _unified(packets, "dst")


def unified_ips(packets: DataFrame) -> DataFrame:
    """Add `_source_ip` and `_destination_ip`: the IPv4 address, else the IPv6 one, row by row."""
    return packets.withColumns(
        {"_source_ip": source_ip(packets), "_destination_ip": destination_ip(packets)})


def _row_order(packets: DataFrame) -> list[str]:
    """Timestamp first, then every orderable column, so that equal times have one order."""
    ties = [f.name for f in packets.schema if f.name != "timestamp" and not isinstance(f.dataType, T.MapType)]
    return (["timestamp"] if "timestamp" in packets.columns else []) + ties


def head(packets: DataFrame, n: int = 10) -> DataFrame:
    """First n packets by time."""
    return packets.orderBy(*[F.col(c).asc_nulls_last() for c in _row_order(packets)]).limit(n)


def tail(packets: DataFrame, n: int = 10) -> DataFrame:
    """Last n packets by time, in time order."""
    order = _row_order(packets)
    last = packets.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
    return last.orderBy(*[F.col(c).asc_nulls_last() for c in order])


def sample(packets: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """n random packets without replacement (all of them where there are fewer)."""
    positive("n", n)
    return packets.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def describe(packets: DataFrame, *columns: str) -> DataFrame:
    """One row per column: count, null_count, mean, std, min, 25 / 50 / 75 %, max.

    Integers, booleans (0 and 1), timestamps (as epoch seconds) and fractions get exact linear-interpolated quartiles;
    text gets counts and text bounds, other types counts only. Fractions are taken as doubles, whatever their size: NaN is
    a value, greater than all others, and mean and deviation are NaN where it occurs. All columns of a kind share one
    shuffle of (column, value, count); whole values are taken from their column's minimum on, so that times, which lie
    close together far from zero, fall into many buckets.
    """
    columns = list(columns) or packets.columns
    fields = {f.name: f.dataType for f in packets.schema}
    require(packets, *columns)
    numbers, fractions, texts, others = {}, {}, [], []
    for name in columns:
        kind = fields[name]
        if isinstance(kind, T.IntegralType):
            numbers[name] = F.col(name).cast("bigint")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            numbers[name] = micros(packets, name)
        elif isinstance(kind, T.StringType):
            texts.append(name)
        elif isinstance(kind, T.BooleanType):
            numbers[name] = F.col(name).cast("int").cast("bigint")
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            fractions[name] = F.col(name).cast("double")
        else:
            others.append(name)
    parts = []
    if numbers:
        timed = [n for n in numbers if isinstance(fields[n], (T.TimestampNTZType, T.TimestampType))]
        is_time = F.col("column").isin(timed) if timed else F.lit(False)
        entries = F.array(*[F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in numbers.items()])
        long = packets.select(F.explode(entries).alias("x")).select("x.*")
        lows = long.groupBy("column").agg(F.min("value").alias("low"))
        placed = long.join(F.broadcast(lows), "column")  # one row per described column
        levels = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
        quartiles = value_stats(placed, F.col("value") - F.col("low"), levels, ["column"]).join(F.broadcast(lows), "column") \
            .withColumns({c: F.col(c) + F.col("low") for c in ("min", "avg", "max", *levels)})
        moments = long.groupBy("column").agg(
            F.count(F.when(F.col("value").isNull(), 1)).alias("null_count"), F.stddev_samp("value").alias("std"))
        unit = F.when(is_time, F.lit(1e6)).otherwise(F.lit(1.0))
        show = lambda c: (F.col(c) / unit).alias(c)
        parts.append(moments.join(quartiles, "column", "left").select(
            "column", F.coalesce("count", F.lit(0)).alias("count"), "null_count", show("std"),
            (F.col("avg") / unit).alias("mean"), show("min"), show("p25"), show("p50"), show("p75"), show("max"),
            F.lit(None).cast("string").alias("min_text"), F.lit(None).cast("string").alias("max_text")))
    if fractions:
        entries = F.array(*[F.struct(F.lit(n).alias("column"), v.alias("value")) for n, v in fractions.items()])
        long = packets.select(F.explode(entries).alias("x")).select("x.*")
        moments = long.groupBy("column").agg(
            F.count("value").alias("count"), F.count(F.when(F.col("value").isNull(), 1)).alias("null_count"), F.stddev_samp("value").alias("std"),
            F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
        quartiles = value_stats(long, F.col("value"), {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"], fractions=True)
        parts.append(moments.join(quartiles.select("column", "p25", "p50", "p75"), "column", "left"))
    if texts:
        entries = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in texts])
        parts.append(
            packets.select(F.explode(entries).alias("x")).select("x.*").groupBy("column").agg(
                F.count("value").alias("count"), F.count(F.when(F.col("value").isNull(), 1)).alias("null_count"),
                F.min("value").alias("min_text"), F.max("value").alias("max_text")))
    if others:
        counts = F.array(*[F.struct(F.lit(n).alias("column"), F.count(n).alias("count"), F.count_if(F.col(n).isNull()).alias("null_count"))
                           for n in others])
        parts.append(packets.agg(counts.alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    full = ["column", "count", "null_count", "std", "mean", "min", "p25", "p50", "p75", "max", "min_text", "max_text"]
    made = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    kinds = {"column": "string", "count": "bigint", "null_count": "bigint", "min_text": "string", "max_text": "string"}
    return made.select(*[F.col(c) if c in made.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in full])
