"""Flows: packets grouped by (source, destination, ports, protocol), with or without an idle timeout.

Packets without both addresses belong to no flow. Ports are the TCP ones, else the UDP ones, else null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelake.errors import InvalidThresholdError, InvalidValueError, one_of, positive
from wirelake.functions.lookups import PROTOCOL_NAMES, protocol_name
from wirelake.functions.scalars import create_flow_id, zero_if_null
from wirelake.functions.windows import tumbling, window_micros, window_seconds
from wirelake.operators.filters import destination_ip, source_ip
from wirelake.operators.slices import interval_stats, value_stats
from wirelake.schema import length_column, micros, optional, require, seconds_between

FLOW_KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")

# Idle timeouts in seconds.
DEFAULT_TIMEOUT = 300
PROTOCOL_TIMEOUTS = {6: 3600, 17: 120}

_SECOND = 1_000_000


def flow_packets(packets: DataFrame) -> DataFrame:
    """(timestamp, src_ip, dst_ip, src_port, dst_port, protocol, length) of packets that belong to a flow."""
    require(packets, "timestamp", "IP_proto")
    port = lambda end: F.coalesce(optional(packets, f"TCP_{end}", "int"), optional(packets, f"UDP_{end}", "int"))
    return packets.select(
        "timestamp", source_ip(packets).alias("src_ip"), destination_ip(packets).alias("dst_ip"),
        port("sport").alias("src_port"), port("dport").alias("dst_port"),
        F.coalesce(F.col("IP_proto").cast("int"), optional(packets, "IPv6_nh", "int")).alias("protocol"),
        (length_column(packets) if "IP_len" in packets.columns else F.lit(None).cast("bigint")).alias("length"),
    ).where(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())


def _flow_id() -> Column:
    name = F.coalesce(protocol_name(F.col("protocol")), F.lit("*"))
    return create_flow_id(F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), name)


def _timeout_micros(timeout) -> Column:
    """`timeout`: seconds, window text, or 'protocol' for the fixed per-protocol values."""
    if timeout == "protocol":
        chain = F.lit(DEFAULT_TIMEOUT * _SECOND)
        for number, seconds in PROTOCOL_TIMEOUTS.items():
            chain = F.when(F.col("protocol") == number, F.lit(seconds * _SECOND)).otherwise(chain)
        return chain.cast("bigint")
    seconds = window_seconds(timeout) if isinstance(timeout, str) else float(timeout)
    positive("timeout", seconds)
    return F.lit(int(seconds * _SECOND)).cast("bigint")


def create_flows(packets: DataFrame, timeout=None) -> DataFrame:
    """One row per flow: flow_id, flow_seq, key, packet_count, byte_count, start_time, end_time, duration_s.

    With a timeout, a gap longer than it starts the next flow of the same key (flow_seq 1, 2, ...; flow_id gets
    '#seq'). Two packets in one bucket of the timeout's width are never that far apart, so packets are first
    aggregated to buckets (map-side combine, no sort). Only buckets are ordered per key, and a key has at most
    one per timeout of elapsed time, however many packets it sends.
    """
    flows = flow_packets(packets)
    sums = [F.count(F.lit(1)).alias("packet_count"), zero_if_null(F.sum("length")).alias("byte_count"),
            F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time")]
    if timeout is None:
        result = flows.groupBy(*FLOW_KEY).agg(*sums).withColumn("flow_seq", F.lit(1).cast("bigint"))
        flow_id = _flow_id()
    else:
        limit = _timeout_micros(timeout)
        us = micros(flows)
        buckets = flows.withColumn("_us", us).groupBy(*FLOW_KEY, F.floor(F.col("_us") / limit).alias("_bucket")).agg(
            *sums, F.min("_us").alias("_from"), F.max("_us").alias("_to"))
        ordered = Window.partitionBy(*FLOW_KEY).orderBy("_bucket")
        gap = F.col("_from") - F.lag("_to").over(ordered)
        buckets = buckets.withColumn("_new", F.coalesce((gap > limit).cast("bigint"), F.lit(1).cast("bigint")))
        buckets = buckets.withColumn(
            "flow_seq", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        result = buckets.groupBy(*FLOW_KEY, "flow_seq").agg(
            F.sum("packet_count").alias("packet_count"), F.sum("byte_count").alias("byte_count"),
            F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
        flow_id = F.concat(_flow_id(), F.lit("#"), F.col("flow_seq").cast("string"))
    return result.withColumn("duration_s", seconds_between("start_time", "end_time")).select(
        flow_id.alias("flow_id"), "flow_seq", *FLOW_KEY, "packet_count", "byte_count", "start_time", "end_time",
        "duration_s")


def get_all_flows(packets: DataFrame, timeout=None) -> DataFrame:
    return create_flows(packets, timeout)


def _either(packets: DataFrame, columns: tuple[str, str], value) -> Column:
    """coalesce(first, second) = value, spelled with plain comparisons that a parquet scan can use."""
    first, second = [F.col(c) if c in packets.columns else F.lit(None) for c in columns]
    if value is None:
        return first.isNull() & second.isNull()
    return (first == value) | (first.isNull() & (second == value))


def get_flow_by_id(packets: DataFrame, flow_id: str, timeout=None) -> DataFrame:
    """The packets of one flow. The id is taken apart, so the filters reach the scan as plain comparisons."""
    found = re.fullmatch(r"(.+):(\d+|\*)->(.+):(\d+|\*):([^:#]+)(?:#(\d+))?", flow_id)
    if not found:
        raise InvalidValueError(f"not a flow id: {flow_id!r}")
    src, sport, dst, dport, name, seq = found.groups()
    numbers = {v: k for k, v in PROTOCOL_NAMES.items()}
    number = numbers.get(name, name.removeprefix("Protocol-"))
    wanted = (_either(packets, ("IP_src", "IPv6_src"), src) & _either(packets, ("IP_dst", "IPv6_dst"), dst)
              & _either(packets, ("TCP_sport", "UDP_sport"), None if sport == "*" else int(sport))
              & _either(packets, ("TCP_dport", "UDP_dport"), None if dport == "*" else int(dport))
              & _either(packets, ("IP_proto", "IPv6_nh"), None if number == "*" else int(number)))
    packets = packets.where(wanted)
    mine = flow_packets(packets)
    if seq is None:
        return mine
    if timeout is None:
        raise InvalidValueError("a flow id with '#seq' needs the timeout it was made with")
    # The sessions of one flow; the wanted one is a single row.
    span = create_flows(packets, timeout)
    span = span.where(F.col("flow_id") == flow_id).select(*FLOW_KEY, "start_time", "end_time")
    pairs = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in FLOW_KEY]
    return (mine.alias("p").join(F.broadcast(span.alias("s")), pairs, "inner")
            .where(F.col("timestamp").between(F.col("start_time"), F.col("end_time"))).select("p.*"))


def _flow_stats(packets: DataFrame, value: Column, timeout, scale: float = 1.0) -> DataFrame:
    stats = value_stats(create_flows(packets, timeout), value, {"median": 0.5}, scale=scale)
    return stats.select("min", "max", "avg", "median")


def get_flow_duration_stats(packets: DataFrame, timeout=None) -> DataFrame:
    """min, max, avg, median of flow durations in seconds."""
    return _flow_stats(packets, F.round(F.col("duration_s") * _SECOND), timeout, float(_SECOND))


def get_flow_packet_count_stats(packets: DataFrame, timeout=None) -> DataFrame:
    return _flow_stats(packets, F.col("packet_count"), timeout)


def get_flow_byte_count_stats(packets: DataFrame, timeout=None) -> DataFrame:
    return _flow_stats(packets, F.col("byte_count"), timeout)


def get_bidirectional_flow_stats(packets: DataFrame) -> DataFrame:
    """Both directions of a conversation in one row; a is the sender of its first packet (ties: smaller end)."""
    none = F.lit(-1)
    flows = flow_packets(packets)
    src = F.struct(F.col("src_ip"), F.coalesce("src_port", none))
    dst = F.struct(F.col("dst_ip"), F.coalesce("dst_port", none))
    flows = flows.withColumn("_fwd", src <= dst).withColumn("_us", micros(flows))
    ends = {"_ip1": ("src_ip", "dst_ip"), "_port1": ("src_port", "dst_port"),
            "_ip2": ("dst_ip", "src_ip"), "_port2": ("dst_port", "src_port")}
    for name, (fwd, rev) in ends.items():
        flows = flows.withColumn(name, F.when(F.col("_fwd"), F.col(fwd)).otherwise(F.col(rev)))
    both = flows.groupBy(*ends, "protocol").agg(
        F.count_if("_fwd").alias("_np"), F.count_if(~F.col("_fwd")).alias("_nq"),
        zero_if_null(F.sum(F.when(F.col("_fwd"), F.col("length")))).alias("_bp"),
        zero_if_null(F.sum(F.when(~F.col("_fwd"), F.col("length")))).alias("_bq"),
        F.min(F.when(F.col("_fwd"), F.col("_us"))).alias("_tp"),
        F.min(F.when(~F.col("_fwd"), F.col("_us"))).alias("_tq"))
    up = F.coalesce(F.col("_tp") <= F.col("_tq"), F.col("_tp").isNotNull())
    pick = lambda a, b, name: F.when(up, F.col(a)).otherwise(F.col(b)).alias(name)
    return both.select(
        pick("_ip1", "_ip2", "ip_a"), pick("_port1", "_port2", "port_a"), pick("_ip2", "_ip1", "ip_b"),
        pick("_port2", "_port1", "port_b"), "protocol", pick("_np", "_nq", "up_packets"),
        pick("_nq", "_np", "down_packets"), pick("_bp", "_bq", "up_bytes"), pick("_bq", "_bp", "down_bytes"),
        ((F.col("_np") == 0) | (F.col("_nq") == 0)).alias("is_unidirectional"))


def identify_long_duration_flows(packets: DataFrame, threshold: str = "5m", timeout=None) -> DataFrame:
    limit = window_seconds(threshold)
    return (create_flows(packets, timeout).where(F.col("duration_s") > limit)
            .orderBy(F.desc("duration_s"), "flow_id"))


def identify_high_volume_flows(packets: DataFrame, threshold: int = 1_000_000, timeout=None) -> DataFrame:
    positive("threshold", threshold)
    return (create_flows(packets, timeout).where(F.col("byte_count") > threshold)
            .orderBy(F.desc("byte_count"), "flow_id"))


def detect_beacon_behavior(packets: DataFrame, tolerance: float = 0.1, min_packets: int = 5) -> DataFrame:
    """Flows whose gaps between packets hardly vary (std / mean <= tolerance)."""
    if not 0 <= tolerance <= 1:
        raise InvalidThresholdError(f"tolerance must lie in [0, 1], got {tolerance}")
    stats = interval_stats(flow_packets(packets), FLOW_KEY)
    return (
        stats.where((F.col("packets") >= min_packets) & (F.col("avg") > 0))
        .select(*FLOW_KEY, "packets", F.col("avg").alias("mean_interval_s"), F.col("std").alias("stddev_interval_s"),
                F.try_divide("std", "avg").alias("cv"))
        .where(F.col("cv") <= tolerance).orderBy("cv", *FLOW_KEY)
    )


def get_top_flows_by_packets(packets: DataFrame, n: int = 10, timeout=None) -> DataFrame:
    positive("n", n)
    return create_flows(packets, timeout).orderBy(F.desc("packet_count"), "flow_id").limit(n)


def get_top_flows_by_bytes(packets: DataFrame, n: int = 10, timeout=None) -> DataFrame:
    positive("n", n)
    return create_flows(packets, timeout).orderBy(F.desc("byte_count"), "flow_id").limit(n)


def _per_window(packets: DataFrame, time_window: str, value: Column, name: str, rate: str) -> DataFrame:
    seconds = window_seconds(time_window)
    return (
        packets.groupBy(tumbling(time_window).alias("w")).agg(value.alias(name))
        .select(F.col("w.start").alias("window_start"), name, (F.col(name) / seconds).alias(rate))
        .orderBy("window_start")
    )


def calculate_packets_per_second(packets: DataFrame, time_window: str = "1m") -> DataFrame:
    return _per_window(packets, time_window, F.count(F.lit(1)), "packet_count", "packets_per_second")


def calculate_bytes_per_second(packets: DataFrame, time_window: str = "1m") -> DataFrame:
    total = zero_if_null(F.sum(length_column(packets)))
    return _per_window(packets, time_window, total, "byte_count", "bytes_per_second")


def calculate_inter_arrival_times(packets: DataFrame, group_by: str = "flow", slice_width: str = "1s") -> DataFrame:
    """Gaps between consecutive packets per flow, source, destination, or over all packets ('global')."""
    keys = {"flow": list(FLOW_KEY), "src_ip": ["src_ip"], "dst_ip": ["dst_ip"], "global": []}
    one_of("group_by", group_by, keys)
    rows = flow_packets(packets) if group_by != "global" else packets.select("timestamp")
    stats = interval_stats(rows, keys[group_by], slice_width)
    return stats.where(F.col("n_intervals") > 0).drop("packets")


def whole_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole groups: no run of equal values in the first `width` columns is cut."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        new = np.flatnonzero(_begins(rows, width))
        cut = int(new[-1])
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held = rows.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _begins(rows: pa.Table, width: int) -> np.ndarray:
    """Where a row differs from the one before it in the first `width` columns."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for column in rows.columns[:width]:
        codes = column.combine_chunks().dictionary_encode().indices.to_numpy()
        out[1:] |= codes[1:] != codes[:-1]
    return out


def lag_products(rows: pa.Table, lags: int, dense: int = 5_000) -> pa.RecordBatch:
    """(src_ip, level, lag, c): sums of x[t] x[t + lag] over the bins t of each slice that are its own, from rows (src_ip,
    level, slice, t, x, mine) sorted by the first four."""
    begin = _begins(rows, 3)
    first = np.flatnonzero(begin)
    group = np.cumsum(begin) - 1
    t, x, mine = (rows.column(c).to_numpy() for c in ("t", "x", "mine"))
    size = np.diff(np.append(first, len(t)))
    sums = np.zeros((len(first), lags + 1))
    # Few bins: the step-th neighbour of every bin of all slices at once; bins are distinct, so step <= lags.
    few = np.flatnonzero((size < dense)[group])
    gf, tf, xf, mf = group[few], t[few], x[few], mine[few].astype(bool)
    for step in range(1, lags + 1):
        lag = tf[step:] - tf[:-step]
        near = (gf[step:] == gf[:-step]) & (lag <= lags)
        if not near.any():
            break
        near &= mf[:-step]
        np.add.at(sums, (gf[:-step][near], lag[near]), (xf[:-step] * xf[step:])[near])
    for g in np.flatnonzero(size >= dense).tolist():
        own = slice(int(first[g]), int(first[g] + size[g]))
        sums[g] = dense_products(t[own], x[own], mine[own].astype(bool), lags)
    g, lag = np.nonzero(sums)
    at = pa.array(first[g])
    return pa.RecordBatch.from_arrays([rows.column("src_ip").combine_chunks().take(at), rows.column("level").combine_chunks().take(at),
                                       pa.array(lag), pa.array(sums[g, lag])], names=["src_ip", "level", "lag", "c"])


def dense_products(t: np.ndarray, x: np.ndarray, mine: np.ndarray, lags: int) -> np.ndarray:
    """The sums of one slice by Fourier transform; where it can't be rounded to whole numbers safely, by the sums themselves."""
    span = int(t[-1] - t[0]) + 1
    all_bins, own_bins = np.zeros(span), np.zeros(span)
    all_bins[t - t[0]] = x
    own_bins[(t - t[0])[mine]] = x[mine]
    n = 1 << (span + lags).bit_length()
    made = np.fft.irfft(np.conj(np.fft.rfft(own_bins, n)) * np.fft.rfft(all_bins, n), n)[:lags + 1]
    whole = np.rint(made)
    if float(all_bins @ all_bins) >= 1 << 40 or np.abs(made - whole).max() > 0.2:
        whole = np.array([own_bins[:span - k] @ all_bins[k:] if k < span else 0.0 for k in range(lags + 1)])
    whole[0] = 0
    return whole


def detect_periodic_patterns(packets: DataFrame, ip: str | None = None, bin_width: str = "1s", lags: int = 300,
                             min_strength: float = 0.5, min_periods: int = 3, slice_width: str = "7d", levels: int = 7) -> DataFrame:
    """Dominant period of the packets of each source (or of one), by autocorrelation of packets per bin.

    With x the counts per bin, T bins, C(k) = sum x[t] x[t+k]:
    strength(k) = (C(k) - (T-k) mean^2) / (C(0) - T mean^2), which favours a period over its multiples.
    Bins grow tenfold from level to level (7 levels from 1 s on: periods up to 300 bins of 10^6 s); a level looks at
    the lags that finer ones do not reach, up to `lags` bins. The finest level with a period that is strong enough
    wins, in it the largest strength, the shortest lag on ties; the series must span `min_periods` periods.

    Packets are counted per (source, bin) first. C(k) is summed over slices of the series, each with the next
    `lags` bins as a halo, so one task holds a batch of slices, each a bounded number of bins. Lag products are whole
    numbers, made by numpy inside the task for all slices of a batch at once, by Fourier transform for dense ones; Spark
    sums them.
    """
    bin_us, slice_us = window_micros(bin_width), window_micros(slice_width)
    bins_per_slice = max(slice_us // bin_us, lags)
    rows = packets.select("timestamp", source_ip(packets).alias("src_ip")).where(
        F.col("src_ip").isNotNull() & F.col("timestamp").isNotNull())
    if ip is not None:
        rows = rows.where(F.col("src_ip") == ip)
    finest = rows.groupBy("src_ip", F.floor(micros(rows) / F.lit(bin_us)).alias("t")).agg(F.count(F.lit(1)).alias("x"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("t") / F.lit(10 ** k)).alias("t"))
                               for k in range(levels)])).alias("bin")
    bins = finest.select("src_ip", "x", each).select("src_ip", "bin.level", "bin.t", "x").groupBy("src_ip", "level", "t") \
        .agg(F.sum("x").cast("double").alias("x"))

    own = F.floor(F.col("t") / bins_per_slice)
    near = F.col("t") - own * bins_per_slice < lags
    sliced = bins.select("src_ip", "level", "t", "x", own.alias("own"),
                         F.explode(F.when(near, F.array(own, own - 1)).otherwise(F.array(own))).alias("slice"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 3):
            yield lag_products(part, lags)

    ordered = sliced.select("src_ip", "level", "slice", "t", "x", (F.col("own") == F.col("slice")).alias("mine")) \
        .repartition("src_ip", "level", "slice").sortWithinPartitions("src_ip", "level", "slice", "t")
    products = (
        ordered.mapInArrow(run, "src_ip string, level int, lag long, c double")
        .where((F.col("level") == 0) | (F.col("lag") > lags // 10))
        .groupBy("src_ip", "level", "lag").agg(F.sum("c").alias("c"))
    )
    series = bins.groupBy("src_ip", "level").agg(
        F.sum("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("xx"), (F.max("t") - F.min("t") + 1).alias("bins"))
    mean = F.col("n") / F.col("bins")
    strength = F.try_divide(F.col("c") - mean * mean * (F.col("bins") - F.col("lag")),
                            F.col("xx") - mean * mean * F.col("bins"))
    return (
        products.join(series, ["src_ip", "level"]).where(F.col("bins") - 1 >= F.col("lag") * min_periods)
        .withColumn("strength", strength).where(F.col("strength") >= min_strength)
        .groupBy("src_ip")
        .agg(F.min(F.struct("level", (-F.round("strength", 9)).alias("s"), "lag")).alias("best"))
        .select("src_ip", (F.col("best.lag") * F.pow(F.lit(10.0), F.col("best.level")) * F.lit(window_seconds(bin_width))).alias("period_s"),
                (-F.col("best.s")).alias("strength"))
        .orderBy(F.desc("strength"), "src_ip")
    )
