"""Flows, DNS matching and ARP bindings on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wirelake.functions.scalars import micros_to_timestamp, zero_if_null
from wirelake.functions.windows import interval_text, window_micros
from wirelake.operators.arp import arp_packets
from wirelake.operators.dns import _dns
from wirelake.operators.flow import DEFAULT_TIMEOUT, FLOW_KEY, PROTOCOL_TIMEOUTS, flow_packets
from wirelake.schema import micros, optional
from wirelake.streaming.core import from_event_time, with_event_time


def live_flows(packets: DataFrame, timeout: str = "protocol", delay: str = "10m") -> DataFrame:
    """Finished flows: session windows per 5-tuple, closed by the idle timeout ('5m', or 'protocol' for fixed ones)."""
    flows = with_event_time(flow_packets(packets), delay)
    if timeout == "protocol":
        gap = F.lit(f"{DEFAULT_TIMEOUT} seconds")
        for number, seconds in PROTOCOL_TIMEOUTS.items():
            gap = F.when(F.col("protocol") == number, F.lit(f"{seconds} seconds")).otherwise(gap)
    else:
        gap = interval_text(timeout)
    return (
        flows.groupBy(F.session_window("event_time", gap).alias("w"), *FLOW_KEY)
        .agg(F.count(F.lit(1)).alias("packet_count"), zero_if_null(F.sum("length")).alias("byte_count"),
             F.min("event_time").alias("_a"), F.max("event_time").alias("_z"))
        .select(*FLOW_KEY, "packet_count", "byte_count", from_event_time(F.col("_a")).alias("start_time"),
                from_event_time(F.col("_z")).alias("end_time"))
    )


_ANSWER = ("DNS_id int, client_ip string, server_ip string, client_port int, us long, DNS_qname string, "
           "wait_us long, DNS_rcode int, request_bytes long, response_bytes long")


def _answer_queries(batches: Iterator[pd.DataFrame], reach: int) -> Iterator[pd.DataFrame]:
    """Per row (one transaction key in one slice): each query with its first response within `reach` µs."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            replies = sorted((p["us"], p["DNS_rcode"], p["length"]) for p in row.packets if p["is_reply"])
            times = np.array([r[0] for r in replies], dtype=np.int64)
            for p in row.packets:
                if p["is_reply"]:
                    continue
                at = int(np.searchsorted(times, p["us"], side="left"))
                found = replies[at] if at < len(replies) and replies[at][0] - p["us"] <= reach else (None, None, None)
                wait = None if found[0] is None else found[0] - p["us"]
                out.append((row.DNS_id, row.client_ip, row.server_ip, row.client_port, p["us"], p["DNS_qname"],
                            wait, found[1], p["length"], found[2]))
        names = [part.split()[0] for part in _ANSWER.split(", ")]
        frame = pd.DataFrame(out, columns=names, dtype=object)
        yield frame


def live_dns_answers(packets: DataFrame, horizon: str = "5s", width: str = "1m", delay: str = "1m") -> DataFrame:
    """Each query with the wait for its first response within `horizon` (null: none), when its time slice closes.

    Packets of one transaction key are gathered per time slice (state: one slice of the key) instead of joined,
    so a busy key makes no pairs of queries and responses. A response early in a slice is also put into the
    slice before. In a gathered slice the first response is found by binary search. The watermark runs on the
    slices: one is reported when packets more than `width` + `delay` after its start have come in.
    """
    reach, span = window_micros(horizon), max(window_micros(width), window_micros(horizon))
    dns = _dns(packets).where(F.col("DNS_qr").isin(0, 1)).withColumn("_is_reply", F.col("DNS_qr") == 1)
    side = lambda request, reply: F.when(F.col("_is_reply"), F.col(reply)).otherwise(F.col(request))
    rows = dns.select(
        F.coalesce("DNS_id", F.lit(-1)).alias("DNS_id"), side("src_ip", "dst_ip").alias("client_ip"),
        side("dst_ip", "src_ip").alias("server_ip"), side("sport", "dport").alias("client_port"),
        F.struct(micros(dns).alias("us"), F.col("_is_reply").alias("is_reply"),
                 F.coalesce("DNS_rcode", F.lit(-1)).alias("DNS_rcode"),
                 F.coalesce("length", F.lit(0)).alias("length"), "DNS_qname").alias("packet"))
    own = F.floor(F.col("packet.us") / F.lit(span))
    early = F.col("packet.is_reply") & (F.col("packet.us") - own * span <= reach)
    slices = F.when(early, F.array(own, own - 1)).otherwise(F.array(own))
    gathered = (
        rows.withColumn("slice", F.explode(slices))
        .withColumn("slice_time", F.timestamp_micros(F.col("slice") * span))
        .withWatermark("slice_time", f"{span + window_micros(delay)} microseconds")
        .groupBy("slice_time", "DNS_id", "client_ip", "server_ip", "client_port")
        .agg(F.collect_list("packet").alias("packets"))
    )
    answers = gathered.select("DNS_id", "client_ip", "server_ip", "client_port", "packets").mapInPandas(
        lambda batches: _answer_queries(batches, reach), _ANSWER)
    return answers.select(micros_to_timestamp(F.col("us")).alias("timestamp"), "DNS_id", "client_ip", "server_ip",
                          "client_port", "DNS_qname", "wait_us", "DNS_rcode", "request_bytes", "response_bytes")


class _Bindings(StatefulProcessor):
    """The last MAC of an address, handed from slice to slice; forgotten after `idle` microseconds without a packet."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "mac string, us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mac, us = self.last.get() if self.last.exists() else (None, None)
        for at, new, gratuitous in sorted((row["us"], row["mac"], row["gratuitous"]) for row in rows):
            if us is not None and at - us > self.idle:
                mac = None
            if mac is not None and mac != new:
                yield Row(ip_address=key[0], old_mac=mac, new_mac=new, us=at, is_gratuitous=gratuitous)
            us, mac = at, new
        self.last.update((mac, us))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((us + self.idle) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())


def live_arp_changes(packets: DataFrame, width: str = "1m", delay: str = "10m", idle: str = "30d") -> DataFrame:
    """Changes of the MAC behind a sender address, in event time: the same for any order in which packets come in.

    Packets of an address are gathered per time slice of `width` until the watermark passes it, so a busy address is
    many bounded rows of state. A closed slice goes on as its runs of equal MACs, and the last MAC is handed from slice
    to slice. Packets later than `delay` are dropped (and counted, see `streaming.late`); an address silent for longer
    than `idle` is forgotten, and its next packet is no change. Needs a session of `state_session`.
    """
    arp = arp_packets(with_event_time(packets, delay)).where(F.col("ARP_sender_ip").isNotNull() & F.col("ARP_sender_mac").isNotNull())
    gathered = (
        arp.select("event_time", F.col("ARP_sender_ip").alias("ip_address"), F.struct(
            micros(packets).alias("us"), F.col("ARP_sender_mac").alias("mac"),
            F.coalesce(F.col("ARP_sender_ip") == optional(packets, "ARP_target_ip", "string"), F.lit(False)).alias("gratuitous")).alias("packet"))
        .groupBy(F.window("event_time", interval_text(width)).alias("w"), "ip_address")
        .agg(F.array_sort(F.collect_list("packet")).alias("packets"))
    )
    runs = F.expr("filter(packets, (x, i) -> i = 0 or i = size(packets) - 1 or x.mac <> packets[i - 1].mac)")
    handed = gathered.select("ip_address", F.window_time("w").alias("slice_time"), F.explode(runs).alias("run")) \
        .select("ip_address", "slice_time", "run.*")
    found = handed.groupBy("ip_address").transformWithState(
        _Bindings(window_micros(idle)), "ip_address string, old_mac string, new_mac string, us long, is_gratuitous boolean", "append", "EventTime")
    return found.select("ip_address", "old_mac", "new_mac", micros_to_timestamp(F.col("us")).alias("changed_at"), "is_gratuitous")
