"""Queries and oracles of the workflow checks and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelake.catalog.entry import bucket, packets, sql_private
from wirelake.catalog.protocols import ENTRIES as DETECTORS, _PORT, _scan
from wirelake.plans import findings, workflows as w
from wirelake.session import scratch_path
from wirelake.sources import parquet

_HOST = "192.168.1.5"
_SCANNER = "10.0.9.9"


def _rows(name: str) -> str:
    return DETECTORS[name].rows


def _finding(rows: str, severity: str, category: str, description: str, details: str = "NULL", more_than: int = 0) -> str:
    before, _, after = description.partition("{n}")
    text = f"concat('{before}', n, '{after}')" if "{n}" in description else f"'{description}'"
    return (f"SELECT '{severity}' AS severity, '{category}' AS category, {text} AS description, details, n FROM "
            f"(SELECT count(*) AS n, CAST({details} AS VARCHAR) AS details FROM ({rows}) t) WHERE n > {more_than}")


def _all(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_STATS = ("SELECT 'info' AS severity, 'Statistics' AS category, concat('Analyzed ', format('{:,}', count(*)), ' packets') "
          "AS description, concat(CAST(min(timestamp) AS VARCHAR), ' to ', CAST(max(timestamp) AS VARCHAR)) AS details, "
          "count(*) AS n FROM p")


def _n1(threshold: int, window: str) -> str:
    return _scan(f"{_PORT} IS NOT NULL", _PORT, window, threshold, each_port=False)


def _scans(threshold: int = 100, window: str = "1 minute") -> str:
    return _finding(_n1(threshold, window), "high", "Port Scan", "Detected {n} potential port scanning sources",
                    "concat('Top scanner: ', max((unique_ports, scanner_ip))[2])")


def _syn(threshold: int, window: str) -> str:
    return (f"SELECT {bucket(window)} AS window_start, IP_src AS src_ip FROM p WHERE contains(TCP_flags, 'S') "
            f"AND NOT contains(TCP_flags, 'A') GROUP BY ALL HAVING count(*) > {threshold}")


def _syn_floods(threshold: int = 1000, window: str = "1 minute") -> str:
    return _finding(_syn(threshold, window), "critical", "SYN Flood", "Detected {n} potential SYN flood attacks",
                    "concat('Affected sources: ', count(DISTINCT src_ip))")


def _udp(threshold: int, window: str) -> str:
    return (f"SELECT {bucket(window)} AS window_start, IP_src AS src_ip FROM p WHERE IP_proto = 17 GROUP BY ALL "
            f"HAVING count(*) > {threshold}")


def _udp_floods(threshold: int = 500, window: str = "1 minute") -> str:
    return _finding(_udp(threshold, window), "high", "UDP Flood", "Detected {n} potential UDP flood attacks")


def _tunnels(threshold: int = 100) -> str:
    return _finding(_rows("dns_tunneling").replace("> 100", f"> {threshold}"), "high", "DNS Tunneling",
                    "Detected {n} potential DNS tunneling queries", "concat('Longest query length: ', max(query_length))")


_DNS_THREATS = _all(
    _tunnels(),
    _finding(_rows("dns_dga_domains").replace("entropy >= 2.8", "entropy >= 3.5"), "high", "DGA Domains",
             "Detected {n} potential DGA-generated domains"),
    _finding(_rows("dns_amplification"), "medium", "DNS Amplification", "Detected {n} potential DNS amplification attempts"))
_ARP_THREATS = _all(
    _finding(_rows("arp_spoofing"), "critical", "ARP Spoofing", "Detected {n} potential ARP spoofing attempts",
             "concat('Addresses affected: ', count(DISTINCT ip_address))"),
    _finding(_rows("arp_scanning").replace(">= 3", ">= 20"), "medium", "ARP Scanning", "Detected {n} hosts performing ARP scanning"))
_ICMP_TUNNELS = _finding(_rows("icmp_tunneling"), "high", "ICMP Tunneling",
                         "Detected {n} host pairs with potential ICMP tunneling")
_ICMP_THREATS = _all(
    _finding(f"SELECT {bucket('1 minute')} AS w, IP_src FROM p WHERE IP_proto = 1 GROUP BY ALL HAVING count(*) > 100",
             "medium", "ICMP Flood", "Detected {n} potential ICMP flood sources"), _ICMP_TUNNELS)
_FAILED = _finding(_rows("tcp_incomplete_connections"), "medium", "Failed Connections",
                   "High number of incomplete TCP connections: {n}", more_than=100)


def _hubs(threshold: int) -> str:
    return _finding(_rows("ip_hubs").replace(">= 20", f">= {threshold}"), "medium", "Hub IPs",
                    "Detected {n} IPs communicating with at least %d unique hosts" % threshold)


_SUSPICIOUS = _all(
    _hubs(50), _finding(_rows("ip_asymmetric").replace("> 0.6", "> 0.9").replace("1.0 - 0.6", "1.0 - 0.9"), "low",
                        "Asymmetric Traffic", "Detected {n} IPs with >90% traffic imbalance"))


def _exfiltration(threshold: int = 100_000_000, category: str = "Data Exfiltration") -> str:
    rows = (f"SELECT IP_src AS src_ip, sum(IP_len) AS outbound_bytes FROM p WHERE IP_src IS NOT NULL AND "
            f"{sql_private('IP_src')} AND NOT {sql_private('IP_dst')} GROUP BY 1 HAVING sum(IP_len) > {threshold}")
    return _finding(rows, "critical", category, "Detected {n} IPs with more than %d bytes of outbound transfer" % threshold,
                    "concat('Top source: ', max((outbound_bytes, src_ip))[2])")


_OFF_HOURS = _finding(_rows("anomaly_off_hours"), "low", "Off-Hours Activity",
                      "Detected {n} sources active outside business hours",
                      "concat('Business hours: 9-17; packets: ', sum(packets))")


def _beacons(category: str = "Beaconing Detected") -> str:
    return _finding(_rows("flow_beacons"), "high", category, "Detected {n} flows with periodic communication patterns")


def _patterns(hosts: int = 50, ports: int = 100) -> str:
    return _all(
        _finding(_rows("anomaly_vertical_scans").replace("n > 5", f"n > {hosts}"), "medium", "Vertical Scan",
                 "Detected {n} vertical scanning patterns"),
        _finding(_rows("anomaly_horizontal_scans").replace("n > 50", f"n > {ports}"), "medium", "Horizontal Scan",
                 "Detected {n} horizontal scanning patterns"))


_AUDIT = _all(_STATS, _scans(), _syn_floods(), _udp_floods(), _DNS_THREATS, _ARP_THREATS, _ICMP_THREATS, _FAILED,
              _SUSPICIOUS, _exfiltration(), _OFF_HOURS, _beacons(), _patterns())


def _section(rows: str, name: str, **metrics: str) -> str:
    return _all(*[f"SELECT '{name}' AS section, '{m.replace('_', ' ') if m[0].isupper() else m}' AS metric, "
                  f"CAST({e} AS VARCHAR) AS value FROM ({rows}) t" for m, e in metrics.items()])


_MINE = f"SELECT * FROM p WHERE IP_src = '{_HOST}' OR IP_dst = '{_HOST}'"
_BASICS = _section(_MINE, "Basic Information", Total_Packets="count(*)", First_Seen="min(timestamp)", Last_Seen="max(timestamp)")
_TRAFFIC = _section(_rows("ip_traffic_stats"), "Traffic Statistics", **{c: f'"{c}"' for c in (
    "packets_sent bytes_sent packets_received bytes_received protocols unique_peers first_seen last_seen").split()})
_PROTOCOLS = (f"SELECT 'Protocol Breakdown' AS section, coalesce(CASE IP_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' "
              f"WHEN 1 THEN 'ICMP' END, 'None') AS metric, CAST(count(*) AS VARCHAR) AS value FROM ({_MINE}) GROUP BY IP_proto")


def _connections(ip: str) -> str:
    return _finding(f"SELECT DISTINCT CASE WHEN IP_src = '{ip}' THEN IP_dst ELSE IP_src END AS peer FROM p "
                    f"WHERE IP_src = '{ip}' OR IP_dst = '{ip}'", "info", "Connections",
                    "IP communicated with {n} unique hosts")


def _scanning(ip: str, threshold: int = 50, window: str = "1 minute") -> str:
    return _finding(f"SELECT * FROM ({_n1(threshold, window)}) WHERE scanner_ip = '{ip}'", "high", "Port Scanning",
                    f"IP {ip} is performing port scanning")


def _attacks(ip: str, syn: int = 500, udp: int = 300) -> str:
    return _all(
        _finding(f"SELECT * FROM ({_syn(syn, '1 minute')}) WHERE src_ip = '{ip}'", "critical", "SYN Flood",
                 f"IP {ip} is source of SYN flood attack"),
        _finding(f"SELECT * FROM ({_udp(udp, '1 minute')}) WHERE src_ip = '{ip}'", "high", "UDP Flood",
                 f"IP {ip} is source of UDP flood attack"))


def _dns_activity(ip: str, top: int = 20) -> str:
    rows = _rows("dns_top_querying_ips").replace("LIMIT 10", f"LIMIT {top}")
    return _finding(f"SELECT * FROM ({rows}) WHERE src_ip = '{ip}'", "info", "DNS Activity",
                    f"IP {ip} is among top {top} DNS queriers")


_INVESTIGATION = _all(*[part for part in (_connections(_SCANNER), _scanning(_SCANNER), _attacks(_SCANNER),
                                          _dns_activity(_SCANNER))])
_C2 = _all(_beacons("Beaconing"),
           _finding(_rows("tcp_long_lived_connections").replace("> 300", "> 1800"), "medium", "Long-lived Connections",
                    "Detected {n} connections lasting >30 minutes"), _tunnels(80))
_THEFT = _all(_exfiltration(50_000_000, "Large Outbound Transfer"), _tunnels(100), _ICMP_TUNNELS)
_LATERAL = _all(_hubs(30), _finding(_n1(20, "5 minutes"), "high", "Internal Port Scanning",
                                    "Detected {n} potential internal port scans"))
_COUNTS = ("SELECT v.severity, count(a.severity) AS findings FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), "
           f"('info')) AS v(severity) LEFT JOIN ({_AUDIT}) a ON a.severity = v.severity GROUP BY 1")


_TALKERS = ("SELECT 'Top 5 Bandwidth Consumers' AS section, ip_address AS metric, CAST(total_bytes AS VARCHAR) "
            f"AS value FROM ({_rows('ip_most_active_by_bytes')})")
_REPORT_COLUMNS = ("severity", "category", "description", "details", "n", "findings", "section", "metric", "value")


def _report_json(p):
    """The audit report written as JSON and read back: findings, counts by severity and sections."""
    report = w.daily_audit(p)
    path = scratch_path(p.sparkSession, "report")
    report.to_json(path)
    kinds = {"n": "long", "findings": "long"}
    schema = "title string, " + ", ".join(f"{c} {kinds.get(c, 'string')}" for c in _REPORT_COLUMNS)
    parts = [p.sparkSession.read.schema(schema).json(f"{path}/{part}").withColumn("part", F.lit(part)) for part in ("findings", "severity_counts", "sections")]
    return findings.union(parts).where("metric is null or metric <> 'duration'")


def _report_sql() -> str:
    network = _section("SELECT * FROM p", "Network Statistics", total_packets="count(*)", start="min(timestamp)", end="max(timestamp)")
    parts = {"findings": _AUDIT, "severity_counts": _COUNTS, "sections": _all(network, _TALKERS)}
    return " UNION ALL BY NAME ".join(f"SELECT 'Daily Security Audit Report' AS title, '{part}' AS part, a.* FROM ({sql}) a" for part, sql in parts.items())


def _clustered(p):
    """An investigation of the landed table in the layout for hosts."""
    path = scratch_path(p.sparkSession, "clustered")
    parquet.save_clustered(p, path)
    return w.ip_investigation(parquet.load_landed(p.sparkSession, path), _SCANNER).findings


ENTRIES = {
    "check_basic_stats": packets(w.basic_stats, _STATS),
    "check_port_scans": packets(lambda p: w.check_port_scans(p, 25, "1m"), _scans(25)),
    "check_syn_floods": packets(lambda p: w.check_syn_floods(p, 2, "1h"), _syn_floods(2, "1 hour")),
    "check_udp_floods": packets(lambda p: w.check_udp_floods(p, 1, "1h"), _udp_floods(1, "1 hour")),
    "check_dns_threats": packets(w.check_dns_threats, _DNS_THREATS),
    "check_arp_threats": packets(w.check_arp_threats, _ARP_THREATS),
    "check_icmp_threats": packets(w.check_icmp_threats, _ICMP_THREATS),
    "check_top_talkers": packets(w.top_talkers, _TALKERS),
    "check_failed_connections": packets(w.check_failed_connections, _FAILED),
    "check_suspicious_ips": packets(w.check_suspicious_ips, _SUSPICIOUS),
    "check_data_exfiltration": packets(lambda p: w.check_data_exfiltration(p, 2000), _exfiltration(2000)),
    "check_off_hours_activity": packets(w.check_off_hours_activity, _OFF_HOURS),
    "check_beaconing": packets(w.check_beaconing, _beacons()),
    "check_scanning_patterns": packets(lambda p: w.check_scanning_patterns(p, 5, 50), _patterns(5, 50)),
    "audit_daily": packets(lambda p: w.daily_audit(p).findings, _AUDIT),
    "audit_severity_counts": packets(lambda p: w.daily_audit(p).severity_counts(), _COUNTS),
    "audit_add_finding": packets(
        lambda p: w.hunt_for_c2(p).add_finding(findings.finding(p.where("TCP_flags = 'FPU'"), "high", "Xmas Scan",
                                                                "{n} packets")).findings,
        _all(_C2, _finding("SELECT * FROM p WHERE TCP_flags = 'FPU'", "high", "Xmas Scan", "{n} packets"))),
    "audit_report_json": packets(
        _report_json, f"SELECT {', '.join(('title', 'part', *_REPORT_COLUMNS))} FROM ({_report_sql()})"),
    "host_basic_info": packets(lambda p: w.host_basics(p, _HOST), _BASICS),
    "host_traffic_stats": packets(lambda p: w.host_traffic(p, _HOST), _TRAFFIC),
    "host_protocol_breakdown": packets(lambda p: w.host_protocols(p, _HOST), _PROTOCOLS),
    "host_connections": packets(lambda p: w.check_connections(p, _HOST), _connections(_HOST)),
    "host_scanning_behavior": packets(lambda p: w.check_scanning_behavior(p, _SCANNER, 25), _scanning(_SCANNER, 25)),
    "host_attack_patterns": packets(lambda p: w.check_attack_patterns(p, _SCANNER, 20, 20), _attacks(_SCANNER, 20, 20)),
    "host_dns_activity": packets(lambda p: w.check_dns_activity(p, "10.0.1.18"), _dns_activity("10.0.1.18")),
    "host_investigation": packets(lambda p: w.ip_investigation(p, _SCANNER).findings, _INVESTIGATION),
    "host_investigation_clustered": packets(_clustered, _INVESTIGATION),
    "hunt_c2": packets(lambda p: w.hunt_for_c2(p).findings, _C2),
    "hunt_data_theft": packets(lambda p: w.hunt_for_data_theft(p).findings, _THEFT),
    "hunt_lateral_movement": packets(lambda p: w.hunt_for_lateral_movement(p).findings, _LATERAL),
}
