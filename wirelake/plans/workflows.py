"""Daily audit, host investigation and threat hunts, each a report made of checks.

A check is a function of the packet table that gives finding rows. Nothing is swallowed: a check whose columns
are missing raises when the plan is built.
"""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, functions as F

from wirelake.functions.lookups import protocol_name
from wirelake.operators import anomaly, arp, dns, flow, icmp, ip as ips, tcp
from wirelake.operators.filters import destination_ip, find_ip_information, source_ip
from wirelake.plans.facts import Facts, gather
from wirelake.plans.findings import Report, finding, section, union
from wirelake.schema import seconds_between


def _largest(value: str, shown: str):
    """Detail: `shown` of the row with the largest `value`."""
    return F.max(F.struct(F.col(value), F.col(shown)))[shown].cast("string")


def basic_stats(packets: DataFrame) -> DataFrame:
    """One info row with the number of packets and their time range."""
    return _stats(packets.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")))


def _stats(totals: DataFrame) -> DataFrame:
    return totals.withColumnsRenamed({"first": "a", "last": "z"}).select(F.lit("info").alias("severity"), F.lit("Statistics").alias("category"),
             F.concat(F.lit("Analyzed "), F.format_number("n", 0), F.lit(" packets")).alias("description"),
             F.concat_ws(" to ", F.col("a").cast("string"), F.col("z").cast("string")).alias("details"), "n")


def network_statistics(packets: DataFrame) -> DataFrame:
    """Section: packets, first and last time, duration."""
    return _network(packets.agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")))


def _network(totals: DataFrame) -> DataFrame:
    stats = totals.withColumnsRenamed({"n": "total_packets", "first": "start", "last": "end"}).withColumn("duration", seconds_between("start", "end"))
    return section(stats, "Network Statistics", "total_packets", "start", "end", "duration")


def check_port_scans(packets: DataFrame, threshold: int = 100, time_window: str = "1m") -> DataFrame:
    return _port_scans(anomaly.detect_port_scanning(packets, threshold=threshold, time_window=time_window, ports_contacted=False))


def _port_scans(scans: DataFrame) -> DataFrame:
    return finding(scans, "high", "Port Scan", "Detected {n} potential port scanning sources",
                   F.concat(F.lit("Top scanner: "), _largest("unique_ports", "scanner_ip")))


def check_syn_floods(packets: DataFrame, threshold: int = 1000, time_window: str = "1m") -> DataFrame:
    return _syn_floods(anomaly.detect_syn_flood(packets, threshold, time_window))


def _syn_floods(floods: DataFrame) -> DataFrame:
    return finding(floods, "critical", "SYN Flood", "Detected {n} potential SYN flood attacks",
                   F.concat(F.lit("Affected sources: "), F.count_distinct("src_ip").cast("string")))


def check_udp_floods(packets: DataFrame, threshold: int = 500, time_window: str = "1m") -> DataFrame:
    return _udp_floods(anomaly.detect_udp_flood(packets, threshold, time_window))


def _udp_floods(floods: DataFrame) -> DataFrame:
    return finding(floods, "high", "UDP Flood", "Detected {n} potential UDP flood attacks")


def check_dns_tunneling(packets: DataFrame, threshold: int = 100) -> DataFrame:
    return finding(dns.detect_dns_tunneling(packets, threshold), "high", "DNS Tunneling",
                   "Detected {n} potential DNS tunneling queries",
                   F.concat(F.lit("Longest query length: "), F.max("query_length").cast("string")))


def check_dns_threats(packets: DataFrame) -> DataFrame:
    return union([
        check_dns_tunneling(packets),
        finding(dns.identify_dga_domains(packets), "high", "DGA Domains", "Detected {n} potential DGA-generated domains"),
        finding(dns.detect_dns_amplification(packets), "medium", "DNS Amplification",
                "Detected {n} potential DNS amplification attempts"),
    ])


def check_arp_threats(packets: DataFrame) -> DataFrame:
    return union([
        finding(arp.detect_arp_spoofing(packets), "critical", "ARP Spoofing", "Detected {n} potential ARP spoofing attempts",
                F.concat(F.lit("Addresses affected: "), F.count_distinct("ip_address").cast("string"))),
        finding(arp.detect_arp_scanning(packets), "medium", "ARP Scanning", "Detected {n} hosts performing ARP scanning"),
    ])


def check_icmp_tunneling(packets: DataFrame) -> DataFrame:
    return finding(icmp.detect_icmp_tunneling(packets), "high", "ICMP Tunneling",
                   "Detected {n} host pairs with potential ICMP tunneling")


def check_icmp_threats(packets: DataFrame, flood_threshold: int = 100) -> DataFrame:
    return union([
        finding(icmp.detect_icmp_flood(packets, flood_threshold), "medium", "ICMP Flood",
                "Detected {n} potential ICMP flood sources"),
        check_icmp_tunneling(packets),
    ])


def top_talkers(packets: DataFrame) -> DataFrame:
    """Section: the five addresses with most bytes."""
    return _talkers(ips.get_most_active_ips(packets, 5, "bytes"))


def _talkers(top: DataFrame) -> DataFrame:
    return top.select(F.lit("Top 5 Bandwidth Consumers").alias("section"), F.col("ip_address").alias("metric"),
                      F.col("total_bytes").cast("string").alias("value"))


def check_failed_connections(packets: DataFrame, more_than: int = 100) -> DataFrame:
    return _failed(tcp.detect_incomplete_connections(packets), more_than)


def _failed(incomplete: DataFrame, more_than: int = 100) -> DataFrame:
    return finding(incomplete, "medium", "Failed Connections",
                   "High number of incomplete TCP connections: {n}", more_than=more_than)


def check_hubs(packets: DataFrame, threshold: int = 50) -> DataFrame:
    return _hubs(ips.detect_hub_ips(packets, threshold), threshold)


def _hubs(hubs: DataFrame, threshold: int = 50) -> DataFrame:
    return finding(hubs, "medium", "Hub IPs",
                   "Detected {n} IPs communicating with at least %d unique hosts" % threshold)


def check_suspicious_ips(packets: DataFrame) -> DataFrame:
    return union([check_hubs(packets), _asymmetric(ips.get_asymmetric_ips(packets, 0.9))])


def _asymmetric(hosts: DataFrame) -> DataFrame:
    return finding(hosts, "low", "Asymmetric Traffic", "Detected {n} IPs with >90% traffic imbalance")


def check_data_exfiltration(packets: DataFrame, threshold: int = 100_000_000, category: str = "Data Exfiltration") -> DataFrame:
    return _exfiltration(anomaly.detect_data_exfiltration(packets, threshold), threshold, category)


def _exfiltration(sources: DataFrame, threshold: int = 100_000_000, category: str = "Data Exfiltration") -> DataFrame:
    return finding(sources, "critical", category,
                   "Detected {n} IPs with more than %d bytes of outbound transfer" % threshold,
                   F.concat(F.lit("Top source: "), _largest("outbound_bytes", "src_ip")))


def check_off_hours_activity(packets: DataFrame, business_hours=(9, 17)) -> DataFrame:
    return _off_hours(anomaly.detect_off_hours_activity(packets, business_hours), business_hours)


def _off_hours(quiet: DataFrame, business_hours=(9, 17)) -> DataFrame:
    start, end = business_hours
    return finding(quiet, "low", "Off-Hours Activity", "Detected {n} sources active outside business hours",
                   F.concat(F.lit(f"Business hours: {start}-{end}; packets: "), F.sum("packets").cast("string")))


def check_beaconing(packets: DataFrame, tolerance: float = 0.1, category: str = "Beaconing Detected") -> DataFrame:
    return finding(flow.detect_beacon_behavior(packets, tolerance), "high", category,
                   "Detected {n} flows with periodic communication patterns")


def check_scanning_patterns(packets: DataFrame, hosts: int = 50, ports: int = 100) -> DataFrame:
    return _patterns(anomaly.detect_vertical_scanning(packets, hosts), anomaly.detect_horizontal_scanning(packets, ports))


def _patterns(vertical: DataFrame, horizontal: DataFrame) -> DataFrame:
    return union([
        finding(vertical, "medium", "Vertical Scan",
                "Detected {n} vertical scanning patterns"),
        finding(horizontal, "medium", "Horizontal Scan",
                "Detected {n} horizontal scanning patterns"),
    ])


def daily_audit(packets: DataFrame, business_hours=(9, 17)) -> Report:
    """All checks over one packet table, which is scanned three times: for the facts and for the packets of small protocols
    (see `facts.gather`; when the report is first looked at), and for beacons, whose flows need the time of every packet.
    """
    lock, held = Lock(), []

    def facts() -> Facts:
        with lock:  # checks are made side by side; the first gathers for all
            if not held:
                held.append(gather(packets, business_hours))
        return held[0]

    pairs = lambda: facts().pairs
    exfiltrating = lambda: anomaly.exfiltration(pairs().withColumnsRenamed({"src": "src_ip", "dst": "dst_ip"}), 100_000_000)
    checks = [
        lambda: check_beaconing(packets),
        lambda: _stats(facts().totals()),
        lambda: _port_scans(tcp.scans_of_ports(facts().ports(), 100)),
        lambda: _syn_floods(anomaly.syn_floods(facts().syn_counts(), 1000)),
        lambda: _udp_floods(facts().udp_counts().where("packet_count > 500")),
        lambda: check_dns_threats(facts().minor),
        lambda: check_arp_threats(facts().minor),
        lambda: check_icmp_threats(facts().minor),
        lambda: _failed(tcp.incomplete(facts().connections)),
        lambda: _hubs(ips.hubs(pairs(), 50)),
        lambda: _asymmetric(ips.asymmetric(pairs(), 0.9)),
        lambda: _exfiltration(exfiltrating()),
        lambda: _off_hours(facts().off_hours(), business_hours),
        lambda: _patterns(anomaly.vertical_scans(facts().traffic, 50), anomaly.horizontal_scans(facts().traffic, 100)),
    ]
    return Report("Daily Security Audit Report", checks,
                  lambda: union([_network(facts().totals()), _talkers(ips.most_active(pairs(), 5, "bytes"))]))


def host_basics(packets: DataFrame, ip: str) -> DataFrame:
    stats = find_ip_information(packets, ip).agg(
        F.count(F.lit(1)).alias("Total Packets"), F.min("timestamp").alias("First Seen"),
        F.max("timestamp").alias("Last Seen"))
    return section(stats, "Basic Information", "Total Packets", "First Seen", "Last Seen")


def host_traffic(packets: DataFrame, ip: str) -> DataFrame:
    stats = ips.get_ip_traffic_stats(packets, ip)
    return section(stats, "Traffic Statistics", *[c for c in stats.columns if c != "ip_address"])


def host_protocols(packets: DataFrame, ip: str) -> DataFrame:
    counts = find_ip_information(packets, ip).groupBy("IP_proto").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.lit("Protocol Breakdown").alias("section"),
                         F.coalesce(protocol_name(F.col("IP_proto")), F.lit("None")).alias("metric"),
                         F.col("n").cast("string").alias("value"))


def check_connections(packets: DataFrame, ip: str) -> DataFrame:
    """Distinct hosts the address talked to."""
    mine = find_ip_information(packets, ip)
    src, dst = source_ip(packets), destination_ip(packets)
    peers = mine.select(F.when(src == ip, dst).otherwise(src).alias("peer")).where(
        F.col("peer").isNotNull() & (F.col("peer") != ip)).distinct()
    return finding(peers, "info", "Connections", "IP communicated with {n} unique hosts")


def check_scanning_behavior(packets: DataFrame, ip: str, threshold: int = 50, time_window: str = "1m") -> DataFrame:
    own = find_ip_information(packets, ip)  # plain comparisons, which reach the scan
    scans = anomaly.detect_port_scanning(own, threshold=threshold, time_window=time_window, ports_contacted=False)
    return finding(scans.where(F.col("scanner_ip") == ip), "high", "Port Scanning", f"IP {ip} is performing port scanning")


def check_attack_patterns(packets: DataFrame, ip: str, syn: int = 500, udp: int = 300) -> DataFrame:
    own = find_ip_information(packets, ip)
    return union([
        finding(anomaly.detect_syn_flood(own, syn).where(F.col("src_ip") == ip), "critical", "SYN Flood",
                f"IP {ip} is source of SYN flood attack"),
        finding(anomaly.detect_udp_flood(own, udp).where(F.col("src_ip") == ip), "high", "UDP Flood",
                f"IP {ip} is source of UDP flood attack"),
    ])


def check_dns_activity(packets: DataFrame, ip: str, top: int = 20) -> DataFrame:
    return finding(dns.get_top_querying_ips(packets, top).where(F.col("src_ip") == ip), "info", "DNS Activity",
                   f"IP {ip} is among top {top} DNS queriers")


def ip_investigation(packets: DataFrame, ip: str) -> Report:
    """Everything about one address. The address filter reaches the scan in all checks but the top-n one."""
    checks = [check_connections(packets, ip), check_scanning_behavior(packets, ip),
              check_attack_patterns(packets, ip), check_dns_activity(packets, ip)]
    sections = union([host_basics(packets, ip), host_traffic(packets, ip), host_protocols(packets, ip)])
    return Report(f"IP Investigation Report: {ip}", checks, sections)


def hunt_for_c2(packets: DataFrame) -> Report:
    """Beacons, long-lived connections and DNS tunnels."""
    long_lived = tcp.identify_long_lived_connections(packets, "30m")
    return Report("Command and Control Hunt", [
        check_beaconing(packets, 0.1, "Beaconing"),
        finding(long_lived, "medium", "Long-lived Connections", "Detected {n} connections lasting >30 minutes"),
        check_dns_tunneling(packets, 80),
    ])


def hunt_for_data_theft(packets: DataFrame) -> Report:
    """Large outbound transfers, DNS and ICMP tunnels."""
    return Report("Data Theft Hunt", [
        check_data_exfiltration(packets, 50_000_000, "Large Outbound Transfer"),
        check_dns_tunneling(packets, 100), check_icmp_tunneling(packets),
    ])


def hunt_for_lateral_movement(packets: DataFrame) -> Report:
    """Hosts with many peers and port scans between hosts."""
    scans = anomaly.detect_port_scanning(packets, threshold=20, time_window="5m", ports_contacted=False)
    return Report("Lateral Movement Hunt", [
        check_hubs(packets, 30),
        finding(scans, "high", "Internal Port Scanning", "Detected {n} potential internal port scans"),
    ])
