"""Streaming queries, run over all that is there and read back, with oracles for what the watermark has closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelake.catalog.entry import bucket, tables
from wirelake.catalog.packet_sql import oracle
from wirelake.catalog.tables import _SENT, _behavior
from wirelake.catalog.protocols import _FK, _FLOW_ROWS, _MATCHED, _scan, ENTRIES as DETECTORS
from wirelake.operators.filters import udp_packets
from wirelake.session import scratch_path
from wirelake.sources import nested, parquet
from wirelake.sources.events_view import packets_from_events, packets_from_folder
from wirelake.streaming import alerts, detectors, ingest, stateful
from wirelake.streaming.core import run_all_to_end, run_available, run_to_end, state_session, with_last_packets

_PARTITIONS = 8


def packet_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The packet view over a stream of the events table."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return packets_from_events(events)


def live(build, sql: str | None, stream=packet_stream):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session, end = state_session(spark, _PARTITIONS), scratch_path(spark, "end")
        return run_to_end(build(with_last_packets(stream(session, folder), end)), end, "live")

    return tables(run, oracle(sql) if sql else None)


def _rate(test: str) -> str:
    return (f"SELECT {bucket('1 hour')} AS window_start, count(*) AS packet_count, CAST(coalesce(sum(IP_len), 0) AS BIGINT) "
            "AS byte_count, round(count(*) / 3600.0, 6) AS packets_per_second, round(coalesce(sum(IP_len), 0) / 3600.0, 6) "
            f"AS bytes_per_second FROM p WHERE {test} GROUP BY 1")


_PORT = "coalesce(TCP_dport, UDP_dport)"


def _ingested(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "ingest")
    nested.write_json(nested.nest_packets(packets_from_folder(spark, folder)), f"{path}/json")
    query = ingest.land(ingest.nested_stream(spark, f"{path}/json"), f"{path}/table", f"{path}/checkpoint", every=None)
    query.awaitTermination()
    return parquet.load_landed(spark, f"{path}/table").select(
        "timestamp", "IP_src", "IP_dst", "TCP_flags", "DNS_qname", "ARP_sender_mac", "raw_size")


_MERGE_KEY = ("TCP_seq", "TCP_flags", "DNS_id", "DNS_qr", "ICMP_type", "ICMP_id", "ARP_sender_ip", "ARP_sender_mac", "ARP_opcode", "raw_size")


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    """Two captures of the same traffic; each packet is to be kept once."""
    session = state_session(spark, _PARTITIONS)
    both = ingest.merge_captures(packet_stream(session, folder), packet_stream(session, folder), extra_key=_MERGE_KEY)
    rows = run_available(both.select("timestamp", "IP_src"), "merged")
    return rows.groupBy("IP_src").agg(F.count(F.lit(1)).alias("packets"), F.min("timestamp").alias("first_seen"))


def shuffled_stream(spark: SparkSession, folder: str) -> DataFrame:
    """ARP packets out of order: files of packets up to two days apart, one file a micro-batch."""
    path = scratch_path(spark, "shuffled")
    rows = packets_from_folder(spark, folder).where("ARP_sender_ip is not null").withColumn(
        "file", F.floor((F.unix_micros(F.col("timestamp").cast("timestamp")) + F.pmod(F.xxhash64("timestamp", "raw_size"), F.lit(172_800_000_000)))
                        / F.lit(345_600_000_000)))
    # Events are read once; then the packets of each file, one after the other, as a stream takes files by their time.
    rows.where("file is not null").repartition("file").write.partitionBy("file").parquet(f"{path}/dealt")
    dealt = spark.read.schema(rows.schema).parquet(f"{path}/dealt")
    for file in sorted(r.file for r in dealt.select("file").distinct().collect()):
        dealt.where(F.col("file") == file).drop("file").coalesce(1).write.mode("append").parquet(f"{path}/files")
    return spark.readStream.schema(rows.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/files")


def _live_alerts(p: DataFrame) -> dict[str, DataFrame]:
    """The detections of all live detectors."""
    return {
        "port_scan": alerts.port_scan_alerts(detectors.live_port_scans(p, threshold=15, time_window="1m")),
        "host_scan": alerts.host_scan_alerts(detectors.live_host_scans(p, 1, "1h")),
        "syn_flood": alerts.syn_flood_alerts(detectors.live_syn_flood(p, 2, "1h")),
        "udp_flood": alerts.udp_flood_alerts(detectors.live_udp_flood(p, 2, "1h")),
        "dns_tunneling": alerts.dns_tunneling_alerts(detectors.live_dns_tunneling(p, 100, "1h")),
        "arp_spoofing": alerts.arp_alerts(stateful.live_arp_changes(p)),
    }


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    session, end, path = state_session(spark, _PARTITIONS), scratch_path(spark, "end"), scratch_path(spark, "alerts")
    found = _live_alerts(with_last_packets(packet_stream(session, folder), end))
    start = lambda: [alerts.write_feed(d, f"{path}/{n}", f"{path}/checkpoint/{n}", "2h") for n, d in found.items()]
    run_all_to_end(start, session, end)
    return alerts.alerts(spark, *[f"{path}/{n}" for n in found])


_SESSIONS = f"""{_FLOW_ROWS},
s AS (SELECT *, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY {_FK} ORDER BY timestamp)
      <= 300000000 THEN 0 ELSE 1 END AS fresh FROM f),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY {_FK} ORDER BY timestamp RANGE UNBOUNDED PRECEDING) AS seq FROM s),
g AS (SELECT {_FK}, count(*) AS packet_count, CAST(sum(IP_len) AS BIGINT) AS byte_count, min(timestamp) AS start_time,
      max(timestamp) AS end_time FROM n GROUP BY {_FK}, seq)
SELECT * FROM g"""

_ANSWERS = f"""{_MATCHED}
SELECT timestamp, client_ip, server_ip, port AS client_port, DNS_id, DNS_qname,
  coalesce(epoch_us(rts) - epoch_us(timestamp), -1) AS wait_us, coalesce(DNS_rcode, -1) AS DNS_rcode
FROM m"""


_DETECTIONS = {
    ("high", "Port Scan"): "SELECT window_start AS seen, scanner_ip AS host, concat(unique_ports, ' ports of ', target_ip) AS description "
                           f"FROM ({_scan('IP_proto = 6', 'TCP_dport', '1 minute', 15, False)})",
    ("high", "Host Scan"): f"SELECT {bucket('1 hour')} AS seen, IP_src AS host, concat(count(DISTINCT IP_dst), ' hosts on port ', {_PORT}) AS description "
                           f"FROM p WHERE {_PORT} IS NOT NULL GROUP BY 1, 2, {_PORT} HAVING count(DISTINCT IP_dst) > 1",
    ("critical", "SYN Flood"): f"SELECT window_start AS seen, src_ip AS host, concat(syn_count, ' SYN packets') AS description FROM ({DETECTORS['anomaly_syn_flood'].rows})",
    ("high", "UDP Flood"): f"SELECT {bucket('1 hour')} AS seen, IP_src AS host, concat(count(*), ' UDP packets') AS description "
                           "FROM p WHERE IP_proto = 17 GROUP BY 1, 2 HAVING count(*) >= 2",
    ("high", "DNS Tunneling"): f"SELECT {bucket('1 hour')} AS seen, IP_src AS host, concat(count(*), ' queries, the longest of ', max(length(DNS_qname)), ' characters') "
                               "AS description FROM p WHERE DNS_qr = 0 AND length(DNS_qname) > 100 GROUP BY 1, 2",
    ("high", "ARP Spoofing"): f"SELECT changed_at AS seen, ip_address AS host, concat(old_mac, ' to ', new_mac) AS description FROM ({DETECTORS['arp_spoofing'].rows})",
}
_ALERTS = "WITH d AS (" + " UNION ALL ".join(
    f"SELECT '{severity}' AS severity, '{category}' AS category, seen, host, description FROM ({sql})" for (severity, category), sql in _DETECTIONS.items()) + """),
k AS (SELECT *, CASE WHEN epoch_us(seen) - lag(epoch_us(seen)) OVER (PARTITION BY category, host ORDER BY seen) <= 7200000000 THEN 0 ELSE 1 END AS fresh,
  max(epoch_us(seen)) OVER (PARTITION BY category) AS newest FROM d WHERE host IS NOT NULL),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY category, host ORDER BY seen RANGE UNBOUNDED PRECEDING) AS number FROM k)
SELECT severity, category, host, min(seen) AS opened_at, max(seen) AS last_at, count(*) AS detections,
  arg_min(description, struct_pack(a := seen, b := description)) AS description,
  CASE WHEN any_value(newest) - epoch_us(max(seen)) > 7200000000 THEN 'closed' ELSE 'open' END AS status
FROM n GROUP BY severity, category, host, number"""


def _ports(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("src_port", "dst_port")})


ENTRIES = {
    "stream_ingest": tables(_ingested, oracle(
        "SELECT timestamp, IP_src, IP_dst, TCP_flags, DNS_qname, ARP_sender_mac, raw_size FROM p")),
    "stream_packet_rate": live(lambda p: detectors.live_packet_rate(p, "1h"), _rate("true")),
    "stream_udp_rate": live(lambda p: detectors.live_packet_rate(udp_packets(p), "1h"), _rate("IP_proto = 17")),
    "stream_port_scans": live(
        lambda p: detectors.live_port_scans(p, "balanced"),
        f"SELECT {bucket('5 minutes')} AS window_start, IP_src AS scanner_ip, IP_dst AS target_ip, "
        "count(DISTINCT TCP_dport) AS unique_ports, count(*) AS total_packets FROM p WHERE IP_proto = 6 GROUP BY 1, 2, 3 "
        "HAVING count(DISTINCT TCP_dport) > 20"),
    "stream_host_scans": live(
        lambda p: detectors.live_host_scans(p, 1, "1h"),
        f"SELECT {bucket('1 hour')} AS window_start, IP_src AS src_ip, {_PORT} AS dst_port, "
        f"count(DISTINCT IP_dst) AS unique_hosts FROM p WHERE {_PORT} IS NOT NULL GROUP BY 1, 2, 3 "
        "HAVING count(DISTINCT IP_dst) > 1"),
    "stream_syn_flood": live(
        lambda p: detectors.live_syn_flood(p, 2, "1h"), DETECTORS["anomaly_syn_flood"].rows),
    "stream_udp_flood": live(
        lambda p: detectors.live_udp_flood(p, 2, "1h"),
        f"SELECT {bucket('1 hour')} AS window_start, IP_src AS src_ip, count(*) AS packet_count, "
        "CAST(sum(IP_len) AS BIGINT) AS byte_count FROM p WHERE IP_proto = 17 GROUP BY 1, 2 HAVING count(*) >= 2"),
    "stream_behavior": live(lambda p: detectors.live_behavioral_summary(p, "1h"), _SENT),
    "stream_behavior_by_destination": live(
        lambda p: detectors.live_behavioral_summary(p, "1d", "destination_ip"),
        _behavior("IP_dst", "IP_src", "destination_ip", "total_bytes_received", "unique_src_ip_count", "1 day")),
    "stream_bursts": live(lambda p: detectors.live_traffic_bursts(p, 2.0, "1h"), f"""
WITH c AS (SELECT {bucket('1 hour')} AS window_start, count(*) AS packets FROM p GROUP BY 1),
s AS (SELECT *, count(*) OVER w AS n, avg(packets) OVER w AS m, stddev_samp(packets) OVER w AS sd FROM c
  WINDOW w AS (ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT window_start, packets, round(m, 6) AS mean, round(sd, 6) AS std, round((packets - m) / sd, 6) AS z
FROM s WHERE n >= 10 AND packets > m + 2 * sd"""),
    "stream_dns_tunneling": live(
        lambda p: detectors.live_dns_tunneling(p, 100, "1h"),
        f"SELECT {bucket('1 hour')} AS window_start, IP_src AS src_ip, count(*) AS queries, CAST(max(length(DNS_qname)) AS INTEGER) AS longest "
        "FROM p WHERE DNS_qr = 0 AND length(DNS_qname) > 100 GROUP BY 1, 2"),
    "stream_flows": live(lambda p: _ports(stateful.live_flows(p, "5m")), _SESSIONS),
    "stream_dns_answers": live(
        lambda p: stateful.live_dns_answers(p).select(
            "timestamp", "client_ip", "server_ip", "client_port", "DNS_id", "DNS_qname",
            F.coalesce("wait_us", F.lit(-1)).alias("wait_us"), F.coalesce("DNS_rcode", F.lit(-1)).alias("DNS_rcode")),
        _ANSWERS),
    "stream_arp_changes": live(lambda p: stateful.live_arp_changes(p, delay="4d"), DETECTORS["arp_spoofing"].rows, shuffled_stream),
    "stream_merge_captures": tables(_merged, oracle(
        "SELECT IP_src, count(*) AS packets, min(timestamp) AS first_seen FROM (SELECT DISTINCT timestamp, IP_src, IP_dst, IP_proto, "
        f"TCP_sport, TCP_dport, UDP_sport, UDP_dport, {', '.join(_MERGE_KEY)} FROM p) GROUP BY 1")),
    "stream_alerts": tables(_alerts, oracle(_ALERTS)),
}
