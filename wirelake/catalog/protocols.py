"""Queries and oracles of the TCP, UDP, IP, DNS, ICMP, ARP, flow and anomaly operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wirelake.catalog.entry import bucket, changed, packets, seconds, sql_private
from wirelake.operators import anomaly, arp, dns, flow, icmp, ip, tcp, udp

_TCP = "IP_proto = 6"
_UDP = "IP_proto = 17"
_KEY = "IP_src, IP_dst, TCP_sport, TCP_dport"
_DNS = "(UDP_sport = 53 OR UDP_dport = 53 OR TCP_sport = 53 OR TCP_dport = 53)"
_S, _A, _R, _F = [f"contains(TCP_flags, '{x}')" for x in "SARF"]


def _n(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


def _flag_count(letter: str) -> str:
    return f"SELECT {_n(f'contains(TCP_flags, {letter!r})')} AS count FROM p WHERE {_TCP}"


_SEQUENCES = (f"SELECT {_KEY}, row_number() OVER (PARTITION BY {_KEY} ORDER BY timestamp NULLS LAST, TCP_seq NULLS FIRST, TCP_flags) AS position, "
              f"TCP_flags, count(*) OVER (PARTITION BY {_KEY}) AS packet_count FROM {{}} WHERE {_TCP} AND TCP_flags IS NOT NULL")


def _known_ports(df):
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("src_port", "dst_port")})


_DURATIONS = f"""
WITH c AS (SELECT {_KEY}, min(timestamp) AS start_time, max(timestamp) AS end_time,
           round({seconds('min(timestamp)', 'max(timestamp)')}, 6) AS duration_s
           FROM p WHERE {_TCP} GROUP BY ALL)
"""


SCAN_PORTS = """SELECT s.*, row_number() OVER (PARTITION BY window_start, scanner_ip, target_ip ORDER BY timestamp, port)
  AS position, port FROM s JOIN r USING (window_start, scanner_ip, target_ip) WHERE port IS NOT NULL"""


def _scan(proto: str, port: str, window: str, threshold: int, each_port: bool = True) -> str:
    every = SCAN_PORTS if each_port else "SELECT * FROM s"
    return f"""
WITH r AS (SELECT {bucket(window)} AS window_start, IP_src AS scanner_ip, IP_dst AS target_ip, timestamp, {port} AS port
  FROM p WHERE {proto}),
s AS (SELECT window_start, scanner_ip, target_ip, count(DISTINCT port) AS unique_ports, count(*) AS total_packets,
  min(timestamp) AS scan_start, max(timestamp) AS scan_end,
  round({seconds('min(timestamp)', 'max(timestamp)')}, 6) AS scan_duration_s,
  CASE WHEN count(DISTINCT port) > 50 THEN 'critical' WHEN count(DISTINCT port) > 30 THEN 'high'
       ELSE 'medium' END AS severity
  FROM r GROUP BY ALL HAVING count(DISTINCT port) > {threshold})
{every}"""


TCP = {
    "tcp_connection_success_ratio": packets(
        tcp.get_connection_success_ratio,
        f"SELECT round({_n(f'{_S} AND {_A}')} / ({_n(f'{_S} AND {_A}')} + {_n(_R)}), 6) AS success_ratio "
        f"FROM p WHERE {_TCP}"),
    "tcp_incomplete_connections": packets(
        tcp.detect_incomplete_connections,
        f"SELECT {_KEY}, {_n(_S)} AS syn_count, {_n(_F)} AS fin_count FROM p WHERE {_TCP} GROUP BY ALL "
        "HAVING syn_count > 0 AND fin_count = 0"),
    "tcp_connection_duration_stats": packets(
        tcp.get_connection_duration_stats, f"""
WITH c AS (SELECT trunc((epoch_us(max(timestamp) FILTER (WHERE {_F})) - epoch_us(min(timestamp) FILTER (WHERE {_S})))
           / 1e6) AS s FROM p WHERE {_TCP} GROUP BY {_KEY})
SELECT min(s) AS min, max(s) AS max, round(avg(s), 6) AS mean, round(median(s), 6) AS median
FROM c WHERE s IS NOT NULL"""),
    "tcp_long_lived_connections": packets(
        lambda p: tcp.identify_long_lived_connections(p, "5m"),
        f"{_DURATIONS} SELECT * FROM c WHERE duration_s > 300"),
    "tcp_short_lived_connections": packets(
        lambda p: tcp.identify_short_lived_connections(p, "3s"),
        f"{_DURATIONS} SELECT * FROM c WHERE duration_s < 3"),
    "tcp_handshake_analysis": packets(
        tcp.get_handshake_analysis, f"""
WITH s AS (SELECT {_n(f'{_S} AND NOT {_A}')} AS total_syn, {_n(f'{_S} AND {_A}')} AS total_syn_ack,
           {_n(f'{_A} AND NOT {_S} AND NOT {_R} AND NOT {_F}')} AS total_ack FROM p WHERE {_TCP})
SELECT *, least(total_syn, total_syn_ack, total_ack) AS complete_handshakes,
       total_syn - least(total_syn, total_syn_ack, total_ack) AS incomplete_handshakes FROM s"""),
    "tcp_flag_distribution": packets(
        tcp.get_flag_distribution, f"""
SELECT f.flag, f.flag_char, {_n('contains(TCP_flags, f.flag_char)')} AS count,
       round({_n('contains(TCP_flags, f.flag_char)')} * 100.0 / count(*), 6) AS percentage
FROM p, (VALUES ('FIN','F'),('SYN','S'),('RST','R'),('PSH','P'),('ACK','A'),('URG','U'),('ECE','E'),('CWR','C'))
     AS f(flag, flag_char) WHERE {_TCP} GROUP BY ALL"""),
    "tcp_syn_count": packets(tcp.get_syn_count, _flag_count("S")),
    "tcp_rst_count": packets(tcp.get_rst_count, _flag_count("R")),
    "tcp_fin_count": packets(tcp.get_fin_count, _flag_count("F")),
    "tcp_ack_count": packets(tcp.get_ack_count, _flag_count("A")),
    "tcp_psh_count": packets(tcp.get_psh_count, _flag_count("P")),
    "tcp_flag_sequences": packets(tcp.analyze_flag_sequences, _SEQUENCES.format("p")),
    "tcp_flag_sequences_without_times": changed(
        tcp.analyze_flag_sequences, {"timestamp": "CASE WHEN raw_size % 7 = 3 THEN NULL ELSE timestamp END",
                                     "TCP_seq": "CASE WHEN raw_size % 21 = 3 THEN NULL ELSE TCP_seq END"}, _SEQUENCES.format("q")),
    "tcp_window_size_stats": packets(
        tcp.get_window_size_stats,
        "SELECT min(TCP_window) AS min, max(TCP_window) AS max, round(avg(TCP_window), 6) AS mean, "
        f"round(median(TCP_window), 6) AS median, round(stddev_samp(TCP_window), 6) AS std FROM p WHERE {_TCP}"),
    "tcp_retransmissions": packets(
        tcp.detect_retransmissions,
        f"SELECT {_KEY}, TCP_seq, count(*) AS seq_count FROM p WHERE {_TCP} GROUP BY ALL HAVING count(*) > 1"),
    "tcp_throughput_by_connection": packets(
        tcp.get_throughput_by_connection, f"""
WITH c AS (SELECT {_KEY}, CAST(sum(IP_len) AS BIGINT) AS total_bytes,
           {seconds('min(timestamp)', 'max(timestamp)')} AS d FROM p WHERE {_TCP} GROUP BY ALL)
SELECT {_KEY}, total_bytes, round(d, 6) AS duration_s, round(total_bytes / d, 6) AS bytes_per_sec FROM c WHERE d > 0"""),
    "tcp_most_used_ports": packets(
        tcp.get_most_used_ports, f"""
SELECT TCP_dport, CASE TCP_dport WHEN 20 THEN 'FTP-DATA' WHEN 21 THEN 'FTP' WHEN 22 THEN 'SSH' WHEN 23 THEN 'TELNET'
  WHEN 25 THEN 'SMTP' WHEN 53 THEN 'DNS' WHEN 80 THEN 'HTTP' WHEN 110 THEN 'POP3' WHEN 143 THEN 'IMAP'
  WHEN 443 THEN 'HTTPS' WHEN 3306 THEN 'MySQL' WHEN 3389 THEN 'RDP' WHEN 5432 THEN 'PostgreSQL'
  WHEN 8080 THEN 'HTTP-ALT' ELSE 'Unknown' END AS service_name, count(*) AS count,
  round(count(*) * 100.0 / (SELECT count(*) FROM p WHERE {_TCP}), 6) AS percentage
FROM p WHERE {_TCP} AND TCP_dport IS NOT NULL GROUP BY TCP_dport ORDER BY count DESC, TCP_dport LIMIT 10"""),
    "tcp_non_standard_ports": changed(
        lambda p: tcp.detect_non_standard_ports(p, 2),
        {"TCP_dport": "CASE WHEN TCP_dport >= 20000 THEN 49150 + TCP_dport % 4 ELSE TCP_dport END"},
        f"SELECT IP_dst, TCP_dport, count(*) AS packet_count FROM q WHERE {_TCP} AND TCP_dport BETWEEN 49152 AND 65535 "
        "GROUP BY ALL HAVING count(*) > 2"),
    "tcp_port_class_ratio": packets(
        tcp.get_ephemeral_vs_wellknown_ratio, f"""
WITH c AS (SELECT {_n('TCP_dport >= 0 AND TCP_dport < 1024')} AS well_known,
  {_n('TCP_dport >= 1024 AND TCP_dport < 49152')} AS registered,
  {_n('TCP_dport >= 49152 AND TCP_dport < 65536')} AS ephemeral, count(*) AS total FROM p WHERE {_TCP})
SELECT *, round(well_known * 100.0 / total, 6) AS well_known_percent,
  round(registered * 100.0 / total, 6) AS registered_percent, round(ephemeral * 100.0 / total, 6) AS ephemeral_percent
FROM c"""),
    "tcp_port_scans_balanced": packets(
        lambda p: tcp.detect_port_scanning(p, "balanced"), _scan(_TCP, "TCP_dport", "5 minutes", 20)),
    "tcp_port_scans_stealth": packets(
        lambda p: tcp.detect_port_scanning(p, "stealth"), _scan(_TCP, "TCP_dport", "30 minutes", 25)),
    "tcp_port_scans_aggressive": packets(
        lambda p: tcp.detect_port_scanning(p, "aggressive"), _scan(_TCP, "TCP_dport", "1 minute", 15)),
}

_UDP_NAMES = """CASE port WHEN 53 THEN 'DNS' WHEN 67 THEN 'DHCP-SERVER' WHEN 68 THEN 'DHCP-CLIENT' WHEN 69 THEN 'TFTP'
  WHEN 123 THEN 'NTP' WHEN 137 THEN 'NETBIOS-NS' WHEN 138 THEN 'NETBIOS-DGM' WHEN 161 THEN 'SNMP'
  WHEN 162 THEN 'SNMP-TRAP' WHEN 500 THEN 'ISAKMP' WHEN 514 THEN 'SYSLOG' WHEN 520 THEN 'RIP' WHEN 1900 THEN 'SSDP'
  WHEN 4500 THEN 'IPSec-NAT-T' WHEN 5353 THEN 'MDNS' ELSE 'Unknown' END"""


def _udp_flood(threshold: int, test: str) -> str:
    return f"""
SELECT {bucket('1 hour')} AS window_start, IP_src AS src_ip, count(*) AS packet_count,
  CAST(sum(IP_len) AS BIGINT) AS byte_count, count(DISTINCT IP_dst) AS unique_destinations,
  count(DISTINCT UDP_dport) AS unique_ports
FROM p WHERE {_UDP} GROUP BY ALL HAVING count(*) {test} {threshold}"""


UDP = {
    "udp_unidirectional_traffic": packets(
        udp.detect_unidirectional_traffic, f"""
WITH u AS (SELECT * FROM p WHERE {_UDP} AND IP_src IS NOT NULL AND IP_dst IS NOT NULL AND UDP_sport IS NOT NULL
           AND UDP_dport IS NOT NULL)
SELECT IP_src AS src_ip, IP_dst AS dst_ip, UDP_sport AS src_port, UDP_dport AS dst_port, count(*) AS packet_count,
  CAST(sum(IP_len) AS BIGINT) AS total_bytes, min(timestamp) AS first_seen, max(timestamp) AS last_seen
FROM u WHERE NOT EXISTS (SELECT 1 FROM u r WHERE r.IP_src = u.IP_dst AND r.IP_dst = u.IP_src
  AND r.UDP_sport = u.UDP_dport AND r.UDP_dport = u.UDP_sport) GROUP BY ALL"""),
    "udp_most_used_ports": packets(
        udp.get_most_used_ports, f"""
WITH t AS (SELECT coalesce(UDP_dport, 0) AS port, count(*) AS count, count(DISTINCT IP_src) AS unique_sources
           FROM p WHERE {_UDP} GROUP BY ALL ORDER BY count DESC, port LIMIT 10)
SELECT *, {_UDP_NAMES} AS port_name, CASE WHEN port < 1024 THEN 'well-known' WHEN port < 49152 THEN 'registered'
  ELSE 'ephemeral' END AS port_class FROM t"""),
    "udp_flow_stats": packets(
        udp.get_udp_flow_stats, f"""
SELECT IP_src AS src_ip, IP_dst AS dst_ip, coalesce(UDP_sport, 0) AS src_port, coalesce(UDP_dport, 0) AS dst_port,
  count(*) AS packet_count, CAST(sum(coalesce(IP_len, 0)) AS BIGINT) AS total_bytes,
  round(avg(coalesce(IP_len, 0)), 6) AS avg_packet_size, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  CAST(trunc({seconds('min(timestamp)', 'max(timestamp)')}) AS BIGINT) AS duration_seconds,
  concat(IP_src, ':', coalesce(UDP_sport, 0), '->', IP_dst, ':', coalesce(UDP_dport, 0), ':UDP') AS flow_id
FROM p WHERE {_UDP} GROUP BY IP_src, IP_dst, coalesce(UDP_sport, 0), coalesce(UDP_dport, 0)"""),
    "udp_packet_rate": packets(
        lambda p: udp.calculate_packet_rate(p, "5m"),
        f"SELECT {bucket('5 minutes')} AS window_start, count(*) AS packet_count, CAST(sum(IP_len) AS BIGINT) "
        "AS byte_count, round(count(*) / 300.0, 6) AS packets_per_second, round(sum(IP_len) / 300.0, 6) "
        f"AS bytes_per_second FROM p WHERE {_UDP} GROUP BY 1"),
    "udp_flood": packets(lambda p: udp.detect_udp_flood(p, 2, "1h"), _udp_flood(2, ">=")),
    "udp_amplification": packets(
        udp.detect_udp_amplification, f"""
WITH rq AS (SELECT IP_src AS victim_ip, IP_dst AS reflector_ip, UDP_dport AS service_port, count(*) AS request_count,
            avg(IP_len) AS a FROM p WHERE {_UDP} AND UDP_dport IN (53,123,161,1900,5353) GROUP BY ALL),
rs AS (SELECT IP_dst AS victim_ip, IP_src AS reflector_ip, UDP_sport AS service_port, avg(IP_len) AS b
       FROM p WHERE {_UDP} AND UDP_sport IN (53,123,161,1900,5353) GROUP BY ALL)
SELECT victim_ip, reflector_ip, service_port, request_count, round(a, 6) AS avg_request_size,
  round(b, 6) AS avg_response_size, round(b / a, 6) AS amplification_ratio
FROM rq JOIN rs USING (victim_ip, reflector_ip, service_port) WHERE b / a >= 10"""),
    "udp_scan": packets(
        lambda p: udp.identify_udp_scan(p, 20), f"""
SELECT IP_src AS src_ip, count(DISTINCT UDP_dport) AS unique_ports_scanned, count(DISTINCT IP_dst) AS unique_destinations,
  count(*) AS total_packets, min(timestamp) AS first_seen, max(timestamp) AS last_seen,
  CAST(trunc({seconds('min(timestamp)', 'max(timestamp)')}) AS BIGINT) AS scan_duration_seconds
FROM p WHERE {_UDP} GROUP BY 1 HAVING count(DISTINCT UDP_dport) >= 20"""),
}

_HOSTS = """
WITH s AS (SELECT IP_src AS ip_address, count(*) AS packets_sent, CAST(sum(IP_len) AS BIGINT) AS bytes_sent,
           count(DISTINCT IP_dst) AS unique_destinations FROM p WHERE IP_src IS NOT NULL GROUP BY 1),
r AS (SELECT IP_dst AS ip_address, count(*) AS packets_received, CAST(sum(IP_len) AS BIGINT) AS bytes_received,
      count(DISTINCT IP_src) AS unique_sources FROM p WHERE IP_dst IS NOT NULL GROUP BY 1),
h AS (SELECT ip_address, coalesce(packets_sent, 0) AS packets_sent, coalesce(bytes_sent, 0) AS bytes_sent,
      coalesce(packets_received, 0) AS packets_received, coalesce(bytes_received, 0) AS bytes_received,
      coalesce(packets_sent, 0) + coalesce(packets_received, 0) AS total_packets,
      coalesce(bytes_sent, 0) + coalesce(bytes_received, 0) AS total_bytes FROM s FULL JOIN r USING (ip_address))
"""
_FRAGMENT = "(coalesce(contains(IP_flags, 'MF'), false) OR coalesce(IP_frag > 0, false))"
_DSCP_NAME = "CASE {} WHEN 0 THEN 'BE' WHEN 8 THEN 'CS1' WHEN 10 THEN 'AF11' WHEN 46 THEN 'EF' ELSE 'OTHER' END"
_SP, _DP = sql_private("IP_src"), sql_private("IP_dst")
# IPv6 text, the first seven private, the others public.
_V6 = ("fd00::1", "fe80::1%eth0", "::1", "2001:DB8::5", "::ffff:10.1.2.3", "64:ff9b:1:0:0:0:0:9", "2001:10::1",
       "2001:4860:4860::8888", "2606:4700::1111", "::ffff:8.8.8.8", "2001:3::1", "2001:20::7", "2400:cb00:2048:1::c629:d7a2")
_PICK = {"src": "raw_size % 13", "dst": "(raw_size + coalesce(IP_len, 0)) % 13"}
_IS_V6 = {"src": "raw_size % 3 = 0", "dst": "raw_size % 2 = 0"}
_BOTH_FAMILIES = {f"IP_{e}": f"CASE WHEN {_IS_V6[e]} THEN NULL ELSE IP_{e} END" for e in ("src", "dst")} | {
    f"IPv6_{e}": f"CASE WHEN {_IS_V6[e]} AND IP_{e} IS NOT NULL THEN CASE {_PICK[e]} "
                 + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_V6)) + " END END" for e in ("src", "dst")}
_SP6, _DP6 = (f"CASE WHEN IP_{e} IS NOT NULL THEN {sql_private(f'IP_{e}')} WHEN IPv6_{e} IS NOT NULL THEN {_PICK[e]} < 7 END" for e in ("src", "dst"))
_WIDE = ["timestamp", "IP_src", "IP_dst", "IP_len", "raw_size"]
_WIDE_SQL = ", ".join(_WIDE)

IP = {
    "ip_most_active_by_packets": packets(
        ip.get_most_active_ips, f"{_HOSTS} SELECT * FROM h ORDER BY total_packets DESC, ip_address LIMIT 10"),
    "ip_most_active_by_bytes": packets(
        lambda p: ip.get_most_active_ips(p, 5, "bytes"),
        f"{_HOSTS} SELECT * FROM h ORDER BY total_bytes DESC, ip_address LIMIT 5"),
    "ip_sender_only": packets(
        ip.get_sender_only_ips, f"{_HOSTS} SELECT s.* FROM s ANTI JOIN r USING (ip_address)"),
    "ip_receiver_only": packets(
        ip.get_receiver_only_ips, f"{_HOSTS} SELECT r.* FROM r ANTI JOIN s USING (ip_address)"),
    "ip_asymmetric": packets(
        lambda p: ip.get_asymmetric_ips(p, 0.6), f"""{_HOSTS}
SELECT *, round(packets_sent / total_packets, 6) AS send_ratio FROM h
WHERE packets_sent / total_packets > 0.6 OR packets_sent / total_packets < 1.0 - 0.6"""),
    "ip_communication_matrix": packets(
        ip.get_communication_matrix,
        "SELECT IP_src AS source_ip, IP_dst AS destination_ip, count(*) AS packets, CAST(sum(IP_len) AS BIGINT) AS bytes "
        "FROM p WHERE IP_src IS NOT NULL AND IP_dst IS NOT NULL GROUP BY 1, 2"),
    "ip_hubs": packets(
        lambda p: ip.detect_hub_ips(p, 20), """
WITH e AS (SELECT IP_src AS ip_address, IP_dst AS peer FROM p UNION ALL SELECT IP_dst, IP_src FROM p)
SELECT ip_address, count(DISTINCT peer) AS unique_peers, count(*) AS packets FROM e
WHERE ip_address <> peer GROUP BY 1 HAVING count(DISTINCT peer) >= 20"""),
    "ip_traffic_stats": packets(
        lambda p: ip.get_ip_traffic_stats(p, "192.168.1.5"), f"""
WITH m AS (SELECT * FROM p WHERE IP_src = '192.168.1.5' OR IP_dst = '192.168.1.5')
SELECT '192.168.1.5' AS ip_address, {_n("IP_src = '192.168.1.5'")} AS packets_sent,
  CAST(coalesce(sum(IP_len) FILTER (WHERE IP_src = '192.168.1.5'), 0) AS BIGINT) AS bytes_sent,
  {_n("IP_dst = '192.168.1.5'")} AS packets_received,
  CAST(coalesce(sum(IP_len) FILTER (WHERE IP_dst = '192.168.1.5'), 0) AS BIGINT) AS bytes_received,
  (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT CASE IP_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP'
   WHEN 1 THEN 'ICMP' END AS x FROM m)) AS protocols,
  count(DISTINCT CASE WHEN IP_src = '192.168.1.5' THEN IP_dst ELSE IP_src END) AS unique_peers,
  min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM m"""),
    "ip_internal_external_ratio": packets(
        ip.get_internal_vs_external_ratio, f"""
WITH c AS (SELECT CASE WHEN {_SP} AND {_DP} THEN 'internal' WHEN {_SP} THEN 'outbound' WHEN {_DP} THEN 'inbound'
           ELSE 'external' END AS direction, count(*) AS packets
           FROM p WHERE IP_src IS NOT NULL AND IP_dst IS NOT NULL GROUP BY 1)
SELECT direction, packets, round(packets / sum(packets) OVER (), 6) AS ratio FROM c"""),
    "ip_internal_network": packets(
        lambda p: ip.identify_internal_network(p, "10.0.0.0/16"), """
WITH h AS (SELECT IP_src AS ip_address FROM p UNION SELECT IP_dst FROM p)
SELECT ip_address, starts_with(ip_address, '10.0.') AS is_internal FROM h WHERE ip_address IS NOT NULL"""),
    "ip_border_traffic": packets(
        lambda p: ip.get_border_traffic(p).select(*_WIDE),
        f"SELECT {_WIDE_SQL} FROM p WHERE IP_src IS NOT NULL AND {_SP} <> {_DP}"),
    "ip_lateral_traffic": packets(
        lambda p: ip.get_lateral_traffic(p).select(*_WIDE),
        f"SELECT {_WIDE_SQL} FROM p WHERE IP_src IS NOT NULL AND {_SP} AND {_DP}"),
    "ip_border_traffic_ipv6": changed(
        lambda p: ip.get_border_traffic(p).select(*_WIDE, "IPv6_src", "IPv6_dst"), _BOTH_FAMILIES,
        f"SELECT {_WIDE_SQL}, IPv6_src, IPv6_dst FROM q WHERE ({_SP6}) <> ({_DP6})"),
    "ip_lateral_traffic_ipv6": changed(
        lambda p: ip.get_lateral_traffic(p).select(*_WIDE, "IPv6_src", "IPv6_dst"), _BOTH_FAMILIES,
        f"SELECT {_WIDE_SQL}, IPv6_src, IPv6_dst FROM q WHERE ({_SP6}) AND ({_DP6})"),
    "ip_internal_external_ratio_ipv6": changed(
        ip.get_internal_vs_external_ratio, _BOTH_FAMILIES, f"""
WITH c AS (SELECT CASE WHEN {_SP6} AND {_DP6} THEN 'internal' WHEN {_SP6} THEN 'outbound' WHEN {_DP6} THEN 'inbound'
           ELSE 'external' END AS direction, count(*) AS packets FROM q WHERE ({_SP6}) IS NOT NULL AND ({_DP6}) IS NOT NULL GROUP BY 1)
SELECT direction, packets, round(packets / sum(packets) OVER (), 6) AS ratio FROM c"""),
    "ip_fragmentation_stats": packets(
        ip.get_fragmentation_stats,
        f"SELECT count(*) AS total, {_n(_FRAGMENT)} AS fragmented, {_n(chr(40) + 'contains(IP_flags, ' + repr('DF') + '))')} "
        f"AS dont_fragment, round({_n(_FRAGMENT)} / count(*), 6) AS fragmentation_ratio FROM p"),
    "ip_top_fragmenting": packets(
        ip.get_top_fragmenting_ips,
        f"SELECT IP_src AS src_ip, count(*) AS fragments FROM p WHERE {_FRAGMENT} GROUP BY 1 "
        "ORDER BY fragments DESC, src_ip LIMIT 10"),
    "ip_excessive_fragmentation": packets(
        lambda p: ip.detect_excessive_fragmentation(p, 5),
        f"SELECT IP_src AS src_ip, count(*) AS fragments FROM p WHERE {_FRAGMENT} GROUP BY 1 HAVING count(*) > 5"),
    "ip_fragment_sizes": packets(
        ip.get_fragment_size_distribution,
        f"SELECT CAST(floor(IP_len / 64) * 64 AS BIGINT) AS size_bucket, count(*) AS fragments FROM p WHERE {_FRAGMENT} "
        "GROUP BY 1"),
    "ip_tos_bits": packets(
        ip.analyze_tos_bits,
        f"SELECT IP_tos AS tos, {_DSCP_NAME.format('IP_tos >> 2')} AS class_name, count(*) AS count FROM p "
        "WHERE IP_tos IS NOT NULL GROUP BY ALL"),
    "ip_dscp_values": packets(
        ip.analyze_dscp_values,
        f"SELECT IP_tos >> 2 AS dscp, {_DSCP_NAME.format('IP_tos >> 2')} AS class_name, count(*) AS count FROM p "
        "WHERE IP_tos IS NOT NULL GROUP BY ALL"),
    "ip_priority_traffic": packets(
        lambda p: ip.detect_priority_traffic(p).select(*_WIDE, "IP_tos"),
        f"SELECT {_WIDE_SQL}, IP_tos FROM p WHERE (IP_tos >> 2) = 46 OR (IP_tos >> 2) BETWEEN 34 AND 38"),
    "ip_ecn_flags": packets(
        ip.analyze_ecn_flags,
        f"SELECT {_n('(IP_tos & 3) = 0')} AS not_ect, {_n('(IP_tos & 3) > 0')} AS ect, {_n('(IP_tos & 3) = 3')} AS ce, "
        "count(IP_tos) AS total FROM p"),
}

_MATCHED = f"""
WITH q AS (SELECT row_number() OVER () AS rid, timestamp, IP_src AS client_ip, IP_dst AS server_ip, UDP_sport AS port,
           DNS_id, DNS_qname, IP_len FROM p WHERE {_DNS} AND DNS_qr = 0),
r AS (SELECT timestamp AS rts, IP_dst AS client_ip, IP_src AS server_ip, UDP_dport AS port, DNS_id, DNS_rcode,
      IP_len AS rlen FROM p WHERE {_DNS} AND DNS_qr = 1),
m AS (SELECT q.*, rts, DNS_rcode, rlen FROM q LEFT JOIN r ON q.client_ip = r.client_ip AND q.server_ip = r.server_ip
      AND q.port = r.port AND q.DNS_id = r.DNS_id AND rts >= timestamp AND rts <= timestamp + INTERVAL 5 SECOND
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY rts, DNS_rcode, rlen) = 1)
"""
_QNAMES = f"SELECT DNS_qname, count(*) AS count FROM p WHERE {_DNS} AND DNS_qr = 0 AND DNS_qname IS NOT NULL GROUP BY 1"
_ENTROPY = "list_aggregate(string_split({0}, ''), 'entropy')"

DNS = {
    "dns_top_queries": packets(dns.get_top_queries, f"{_QNAMES} ORDER BY count DESC, DNS_qname LIMIT 20"),
    "dns_query_response_ratio": packets(
        dns.get_query_response_ratio,
        f"SELECT {_n('DNS_qr = 0')} AS queries, {_n('DNS_qr = 1')} AS responses, "
        f"round({_n('DNS_qr = 1')} / {_n('DNS_qr = 0')}, 6) AS ratio FROM p WHERE {_DNS}"),
    "dns_response_time_stats": packets(
        dns.get_response_time_stats, f"""{_MATCHED},
t AS (SELECT (epoch_us(rts) - epoch_us(timestamp)) / 1000.0 AS ms FROM m WHERE rts IS NOT NULL)
SELECT count(*) AS matched, min(ms) AS min_ms, max(ms) AS max_ms, round(avg(ms), 6) AS avg_ms,
  round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms,
  round(quantile_cont(ms, 0.99), 6) AS p99_ms FROM t"""),
    "dns_top_querying_ips": packets(
        dns.get_top_querying_ips,
        f"SELECT IP_src AS src_ip, count(*) AS count FROM p WHERE {_DNS} AND DNS_qr = 0 GROUP BY 1 "
        "ORDER BY count DESC, src_ip LIMIT 10"),
    "dns_failed_queries": packets(
        dns.get_failed_queries, f"""{_MATCHED}
SELECT timestamp, client_ip, server_ip, DNS_id, DNS_qname, CASE WHEN rts IS NULL THEN 'NO_RESPONSE'
  WHEN DNS_rcode = 3 THEN 'NXDOMAIN' ELSE 'SERVFAIL' END AS reason FROM m WHERE rts IS NULL OR DNS_rcode IN (2, 3)"""),
    "dns_tunneling": packets(
        dns.detect_dns_tunneling, f"""
SELECT timestamp, IP_src, IP_dst, DNS_qname, CAST(length(DNS_qname) AS INTEGER) AS query_length,
  round({_ENTROPY.format('DNS_qname')}, 6) AS entropy, DNS_qtype = 16 AS is_txt
FROM p WHERE {_DNS} AND DNS_qr = 0 AND length(DNS_qname) > 100"""),
    "dns_tunneling_by_entropy": packets(
        lambda p: dns.detect_dns_tunneling(p, 100, 3.5), f"""
SELECT timestamp, IP_src, IP_dst, DNS_qname, CAST(length(DNS_qname) AS INTEGER) AS query_length,
  round({_ENTROPY.format('DNS_qname')}, 6) AS entropy, DNS_qtype = 16 AS is_txt
FROM p WHERE {_DNS} AND DNS_qr = 0 AND (length(DNS_qname) > 100 OR {_ENTROPY.format('DNS_qname')} >= 3.5)"""),
    "dns_amplification": packets(
        dns.detect_dns_amplification, f"""{_MATCHED}
SELECT timestamp, client_ip, server_ip, DNS_qname, IP_len AS request_bytes, rlen AS response_bytes,
  round(rlen / IP_len, 6) AS amplification_ratio FROM m WHERE rlen / IP_len > 10"""),
    "dns_excessive_nxdomain": packets(
        dns.detect_excessive_nxdomain,
        f"SELECT IP_dst AS client_ip, count(*) AS responses, {_n('DNS_rcode = 3')} AS nxdomain, "
        f"round({_n('DNS_rcode = 3')} / count(*), 6) AS nxdomain_ratio FROM p WHERE {_DNS} AND DNS_qr = 1 GROUP BY 1 "
        f"HAVING {_n('DNS_rcode = 3')} / count(*) > 0.5"),
    "dns_dga_domains": packets(
        lambda p: dns.identify_dga_domains(p, min_entropy=2.8), f"""
WITH n AS (SELECT DNS_qname AS domain, {_n('DNS_qr = 0')} AS queries, {_n('DNS_qr = 1')} AS rs,
           {_n('DNS_qr = 1 AND DNS_rcode = 3')} AS nx FROM p WHERE {_DNS} AND DNS_qname IS NOT NULL GROUP BY 1),
l AS (SELECT *, list_filter(string_split(domain, '.'), lambda x: length(x) =
      list_max(list_transform(string_split(domain, '.'), lambda y: length(y))))[1] AS label FROM n),
f AS (SELECT domain, CAST(length(label) AS INTEGER) AS label_length, {_ENTROPY.format('label')} AS entropy,
      length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) AS digit_ratio, queries,
      CASE WHEN rs = 0 THEN 0.0 ELSE nx / rs END AS nxdomain_rate FROM l)
SELECT domain, label_length, round(entropy, 6) AS entropy, round(digit_ratio, 6) AS digit_ratio, queries,
  round(nxdomain_rate, 6) AS nxdomain_rate FROM f
WHERE (entropy >= 2.8 AND label_length >= 12) OR (nxdomain_rate > 0.5 AND entropy >= 3.0)"""),
    "dns_query_types": packets(
        dns.get_query_type_distribution, f"""
SELECT DNS_qtype, CASE DNS_qtype WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA' WHEN 16 THEN 'TXT' WHEN 15 THEN 'MX' END
  AS type_name, count(*) AS count FROM p WHERE {_DNS} AND DNS_qr = 0 GROUP BY ALL"""),
    "dns_queried_domains": packets(dns.get_queried_domains_list, _QNAMES),
}

_PING_IP = "10.0.1.130"
ICMP = {
    "icmp_message_types": packets(
        icmp.get_message_type_distribution,
        "SELECT ICMP_type, CASE ICMP_type WHEN 0 THEN 'Echo Reply' WHEN 3 THEN 'Destination Unreachable' "
        "WHEN 8 THEN 'Echo Request' END AS type_name, count(*) AS count FROM p WHERE IP_proto = 1 GROUP BY ALL"),
    "icmp_echo_ratio": packets(
        icmp.get_echo_request_reply_ratio,
        f"SELECT {_n('ICMP_type = 8')} AS requests, {_n('ICMP_type = 0')} AS replies, "
        f"round({_n('ICMP_type = 0')} / {_n('ICMP_type = 8')}, 6) AS ratio, "
        f"greatest({_n('ICMP_type = 8')} - {_n('ICMP_type = 0')}, 0) AS unanswered FROM p WHERE IP_proto = 1"),
    "icmp_ping_patterns": packets(
        lambda p: icmp.analyze_ping_patterns(p, _PING_IP), f"""
WITH q AS (SELECT row_number() OVER () AS rid, timestamp AS ts, IP_dst AS peer, ICMP_id FROM p
           WHERE IP_proto = 1 AND ICMP_type = 8 AND IP_src = '{_PING_IP}'),
a AS (SELECT timestamp AS ts, IP_src AS peer, ICMP_id FROM p
      WHERE IP_proto = 1 AND ICMP_type = 0 AND IP_dst = '{_PING_IP}'),
w AS (SELECT q.rid, min(epoch_us(a.ts) - epoch_us(q.ts)) AS us FROM q JOIN a ON q.peer = a.peer AND q.ICMP_id = a.ICMP_id
      AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 5 SECOND GROUP BY 1),
g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6 AS gap FROM q),
s AS (SELECT avg(gap) AS m, stddev_samp(gap) / avg(gap) AS cv FROM g)
SELECT '{_PING_IP}' AS ip_address, (SELECT count(*) FROM q) AS requests, (SELECT count(*) FROM a) AS replies,
  round(m, 6) AS avg_interval_s, round(cv, 6) AS cv, round((SELECT avg(us) / 1000 FROM w), 6) AS avg_rtt_ms,
  CASE WHEN cv <= 0.1 THEN 'regular' WHEN cv > 1.0 THEN 'bursty' ELSE 'irregular' END AS pattern FROM s"""),
    "icmp_flood": packets(
        lambda p: icmp.detect_icmp_flood(p, 1, "1h"),
        f"SELECT {bucket('1 hour')} AS window_start, IP_src AS src_ip, count(*) AS packet_count FROM p "
        "WHERE IP_proto = 1 GROUP BY ALL HAVING count(*) > 1"),
    "icmp_tunneling": packets(
        icmp.detect_icmp_tunneling,
        "SELECT IP_src AS src_ip, IP_dst AS dst_ip, count(*) AS packets, max(IP_len - 28) AS max_payload, "
        "CAST(sum(IP_len) AS BIGINT) AS total_bytes FROM p WHERE IP_proto = 1 GROUP BY ALL HAVING max(IP_len - 28) > 64"),
    "icmp_smurf_attack": packets(
        lambda p: icmp.detect_smurf_attack(p, ["192.168.1.9", "192.168.1.19"], "1h"), f"""
WITH e AS (SELECT *, {bucket('1 hour')} AS w FROM p WHERE IP_proto = 1),
q AS (SELECT w AS window_start, IP_src AS src_ip, IP_dst AS broadcast_ip, count(*) AS requests FROM e
      WHERE ICMP_type = 8 AND (IP_dst LIKE '%.255' OR IP_dst IN ('192.168.1.9', '192.168.1.19')) GROUP BY ALL),
a AS (SELECT w AS window_start, IP_dst AS src_ip, count(*) AS replies FROM e WHERE ICMP_type = 0 GROUP BY ALL)
SELECT window_start, src_ip, broadcast_ip, requests, coalesce(replies, 0) AS replies
FROM q LEFT JOIN a USING (window_start, src_ip)"""),
    "icmp_ping_of_death": changed(
        lambda p: icmp.detect_ping_of_death(p).drop("ip_id"),
        {"IP_frag": "CASE WHEN IP_proto = 1 AND raw_size % 5 < 2 THEN 8100 + (raw_size % 3) * 45 ELSE IP_frag END",
         "IP_flags": "CASE WHEN IP_proto = 1 AND raw_size % 5 = 2 THEN 'MF' ELSE IP_flags END"}, f"""
SELECT IP_src AS src_ip, IP_dst AS dst_ip, count(*) AS fragments, max(CAST(IP_frag AS BIGINT) * 8 + IP_len - 20) AS reassembled_size
FROM q WHERE IP_proto = 1 AND {_FRAGMENT} GROUP BY ALL HAVING max(CAST(IP_frag AS BIGINT) * 8 + IP_len - 20) > 65535"""),
    "icmp_packet_count": packets(icmp.get_icmp_packet_count, "SELECT count(*) AS count FROM p WHERE IP_proto = 1"),
    "icmp_top_sources": packets(
        icmp.get_top_icmp_sources,
        "SELECT IP_src AS src_ip, count(*) AS count FROM p WHERE IP_proto = 1 GROUP BY 1 ORDER BY count DESC, src_ip LIMIT 10"),
}

_ARP = "ARP_opcode IS NOT NULL"
_ARP_TABLE = f"""
WITH t AS (SELECT ARP_sender_ip AS ip_address, ARP_sender_mac AS mac_address, min(timestamp) AS first_seen,
           max(timestamp) AS last_seen, count(*) AS observations FROM p WHERE {_ARP} GROUP BY 1, 2)
"""


ARP = {
    "arp_table": packets(arp.get_arp_table, f"{_ARP_TABLE} SELECT * FROM t"),
    "arp_duplicate_ips": packets(
        arp.get_duplicate_ips, f"""{_ARP_TABLE}
SELECT * FROM (SELECT ip_address, count(*) OVER (PARTITION BY ip_address) AS mac_count, mac_address FROM t) WHERE mac_count > 1"""),
    "arp_duplicate_macs": packets(
        arp.get_duplicate_macs, f"""{_ARP_TABLE}
SELECT * FROM (SELECT mac_address, count(*) OVER (PARTITION BY mac_address) AS ip_count, ip_address FROM t) WHERE ip_count > 1"""),
    "arp_spoofing": packets(
        arp.detect_arp_spoofing, f"""
WITH c AS (SELECT ARP_sender_ip AS ip_address, ARP_sender_mac AS new_mac, timestamp AS changed_at,
  ARP_sender_ip = ARP_target_ip AS is_gratuitous, lag(ARP_sender_mac) OVER (PARTITION BY ARP_sender_ip
  ORDER BY timestamp, ARP_sender_mac, ARP_sender_ip = ARP_target_ip) AS old_mac FROM p WHERE {_ARP})
SELECT * FROM c WHERE old_mac <> new_mac"""),
    "arp_gratuitous_flood": packets(
        lambda p: arp.detect_gratuitous_arp_flood(p, 5),
        f"SELECT ARP_sender_mac AS sender_mac, count(*) AS packet_count FROM p WHERE {_ARP} "
        "AND ARP_sender_ip = ARP_target_ip GROUP BY 1 HAVING count(*) > 5"),
    "arp_request_response_ratio": packets(
        arp.get_arp_request_response_ratio,
        f"SELECT {_n('ARP_opcode = 1')} AS requests, {_n('ARP_opcode = 2')} AS responses, "
        f"round({_n('ARP_opcode = 2')} / {_n('ARP_opcode = 1')}, 6) AS ratio FROM p WHERE {_ARP}"),
    "arp_scanning": packets(
        lambda p: arp.detect_arp_scanning(p, 3), f"""
WITH a AS (SELECT ARP_sender_ip AS s, ARP_target_ip AS t FROM p WHERE {_ARP} AND ARP_opcode = 1),
d AS (SELECT DISTINCT s, CAST(split_part(t,'.',1) AS BIGINT)*16777216 + CAST(split_part(t,'.',2) AS BIGINT)*65536
      + CAST(split_part(t,'.',3) AS BIGINT)*256 + CAST(split_part(t,'.',4) AS BIGINT) AS v FROM a),
l AS (SELECT s, v - lag(v) OVER (PARTITION BY s ORDER BY v) AS step FROM d),
q AS (SELECT s, CASE WHEN count(*) = 1 THEN 0.0 ELSE count(*) FILTER (WHERE step = 1) / (count(*) - 1) END AS share
      FROM l GROUP BY 1)
SELECT a.s AS sender_ip, count(*) AS requests, count(DISTINCT t) AS unique_targets, round(max(share), 6) AS sequential_share
FROM a JOIN q USING (s) GROUP BY 1 HAVING count(DISTINCT t) >= 3"""),
    "arp_packet_count": packets(arp.get_arp_packet_count, f"SELECT count(*) AS count FROM p WHERE {_ARP}"),
    "arp_most_active_ips": packets(
        arp.get_most_active_arp_ips, f"""
WITH e AS (SELECT ARP_sender_ip AS ip_address FROM p WHERE {_ARP} UNION ALL
           SELECT ARP_target_ip FROM p WHERE {_ARP} AND ARP_target_ip <> ARP_sender_ip)
SELECT ip_address, count(*) AS count FROM e GROUP BY 1 ORDER BY count DESC, ip_address LIMIT 10"""),
}

_FLOW_ROWS = """
WITH f AS (SELECT timestamp, IP_src AS src_ip, IP_dst AS dst_ip, coalesce(TCP_sport, UDP_sport, -1) AS src_port,
           coalesce(TCP_dport, UDP_dport, -1) AS dst_port, IP_proto AS protocol, IP_len
           FROM p WHERE IP_src IS NOT NULL AND IP_dst IS NOT NULL)
"""
_FK = "src_ip, dst_ip, src_port, dst_port, protocol"
_FLOW_ID = ("concat(src_ip, ':', CASE WHEN src_port < 0 THEN '*' ELSE CAST(src_port AS VARCHAR) END, '->', dst_ip, ':', "
            "CASE WHEN dst_port < 0 THEN '*' ELSE CAST(dst_port AS VARCHAR) END, ':', "
            "CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END)")
_FLOWS = f"""{_FLOW_ROWS},
g AS (SELECT {_FLOW_ID} AS flow_id, CAST(1 AS BIGINT) AS flow_seq, {_FK}, count(*) AS packet_count,
      CAST(sum(IP_len) AS BIGINT) AS byte_count, min(timestamp) AS start_time, max(timestamp) AS end_time,
      round({seconds('min(timestamp)', 'max(timestamp)')}, 6) AS duration_s FROM f GROUP BY {_FK})
"""


def _sessions(limit: str) -> str:
    return f"""{_FLOW_ROWS},
s AS (SELECT *, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY {_FK} ORDER BY timestamp)
      <= CAST({limit} AS BIGINT) * 1000000 THEN 0 ELSE 1 END AS fresh FROM f),
n AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY {_FK} ORDER BY timestamp RANGE UNBOUNDED PRECEDING) AS BIGINT)
      AS flow_seq FROM s)
SELECT concat({_FLOW_ID}, '#', flow_seq) AS flow_id, flow_seq, {_FK}, count(*) AS packet_count,
  CAST(sum(IP_len) AS BIGINT) AS byte_count, min(timestamp) AS start_time, max(timestamp) AS end_time,
  round({seconds('min(timestamp)', 'max(timestamp)')}, 6) AS duration_s FROM n GROUP BY {_FK}, flow_seq"""


def _ports(df):
    """Null ports as -1, so integer columns compare as integers in both engines."""
    names = [c for c in ("src_port", "dst_port", "port_a", "port_b") if c in df.columns]
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in names})


def _stats(column: str) -> str:
    return (f"{_FLOWS} SELECT CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max, "
            f"round(avg({column}), 6) AS avg, round(median({column}), 6) AS median FROM g")


def _gaps(key: str, rows: str = _FLOW_ROWS, source: str = "f") -> str:
    part = f"PARTITION BY {key}" if key else ""
    lead = f"{key}, " if key else ""
    return f"""{rows},
d AS (SELECT {lead}epoch_us(timestamp) AS us, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER ({part}
      ORDER BY timestamp))) / 1e6 AS gap FROM {source})
SELECT {lead}count(gap) AS n_intervals, round(min(gap), 6) AS min, round(max(gap), 6) AS max, round((max(us) - min(us)) / 1e6 / count(gap), 6) AS avg,
  round(stddev_samp(gap), 6) AS std FROM d {f'GROUP BY {key}' if key else ''} HAVING count(gap) > 0"""


_A_FLOW = "10.0.8.8:20501->93.184.216.34:443:TCP"
FLOW = {
    "flow_create": packets(lambda p: _ports(flow.create_flows(p)), f"{_FLOWS} SELECT * FROM g"),
    "flow_sessions": packets(lambda p: _ports(flow.create_flows(p, "5m")), _sessions("300")),
    "flow_sessions_short": packets(lambda p: _ports(flow.create_flows(p, 1)), _sessions("1")),
    "flow_sessions_by_protocol": packets(
        lambda p: _ports(flow.create_flows(p, "protocol")),
        _sessions("CASE protocol WHEN 6 THEN 3600 WHEN 17 THEN 120 ELSE 300 END")),
    "flow_by_id": packets(
        lambda p: flow.get_flow_by_id(p, _A_FLOW),
        "SELECT timestamp, IP_src AS src_ip, IP_dst AS dst_ip, TCP_sport AS src_port, TCP_dport AS dst_port, "
        "IP_proto AS protocol, IP_len AS length FROM p WHERE IP_src = '10.0.8.8' AND IP_dst = '93.184.216.34' "
        "AND TCP_sport = 20501 AND TCP_dport = 443 AND IP_proto = 6"),
    "flow_session_by_id": packets(
        lambda p: flow.get_flow_by_id(p, _A_FLOW + "#2", "30s"), """
WITH f AS (SELECT *, sum(CASE WHEN timestamp - prev <= INTERVAL 30 SECOND THEN 0 ELSE 1 END) OVER (ORDER BY timestamp
             RANGE UNBOUNDED PRECEDING) AS seq FROM (SELECT timestamp, IP_src AS src_ip, IP_dst AS dst_ip, TCP_sport AS src_port, TCP_dport AS dst_port,
             IP_proto AS protocol, IP_len AS length, lag(timestamp) OVER (ORDER BY timestamp) AS prev
             FROM p WHERE IP_src = '10.0.8.8' AND IP_dst = '93.184.216.34' AND TCP_sport = 20501 AND TCP_dport = 443))
SELECT timestamp, src_ip, dst_ip, src_port, dst_port, protocol, length FROM f WHERE seq = 2"""),
    "flow_all": packets(lambda p: _ports(flow.get_all_flows(p)), f"{_FLOWS} SELECT * FROM g"),
    "flow_duration_stats": packets(flow.get_flow_duration_stats, _stats("duration_s")),
    "flow_packet_count_stats": packets(flow.get_flow_packet_count_stats, _stats("packet_count")),
    "flow_byte_count_stats": packets(flow.get_flow_byte_count_stats, _stats("byte_count")),
    "flow_bidirectional_stats": packets(
        lambda p: _ports(flow.get_bidirectional_flow_stats(p)), f"""{_FLOW_ROWS},
k AS (SELECT *, (src_ip, src_port) <= (dst_ip, dst_port) AS fwd FROM f),
c AS (SELECT CASE WHEN fwd THEN src_ip ELSE dst_ip END AS i1, CASE WHEN fwd THEN src_port ELSE dst_port END AS p1,
      CASE WHEN fwd THEN dst_ip ELSE src_ip END AS i2, CASE WHEN fwd THEN dst_port ELSE src_port END AS p2, protocol,
      arg_min(fwd, (timestamp, NOT fwd)) AS up, {_n('fwd')} AS np, {_n('NOT fwd')} AS nq,
      CAST(coalesce(sum(IP_len) FILTER (WHERE fwd), 0) AS BIGINT) AS bp,
      CAST(coalesce(sum(IP_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bq FROM k GROUP BY 1, 2, 3, 4, 5)
SELECT CASE WHEN up THEN i1 ELSE i2 END AS ip_a, CASE WHEN up THEN p1 ELSE p2 END AS port_a,
  CASE WHEN up THEN i2 ELSE i1 END AS ip_b, CASE WHEN up THEN p2 ELSE p1 END AS port_b, protocol,
  CASE WHEN up THEN np ELSE nq END AS up_packets, CASE WHEN up THEN nq ELSE np END AS down_packets,
  CASE WHEN up THEN bp ELSE bq END AS up_bytes, CASE WHEN up THEN bq ELSE bp END AS down_bytes,
  np = 0 OR nq = 0 AS is_unidirectional FROM c"""),
    "flow_long_duration": packets(
        lambda p: _ports(flow.identify_long_duration_flows(p, "5m")), f"{_FLOWS} SELECT * FROM g WHERE duration_s > 300"),
    "flow_high_volume": packets(
        lambda p: _ports(flow.identify_high_volume_flows(p, 1000)), f"{_FLOWS} SELECT * FROM g WHERE byte_count > 1000"),
    "flow_beacons": packets(
        lambda p: _ports(flow.detect_beacon_behavior(p)), f"""{_FLOW_ROWS},
d AS (SELECT {_FK}, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY {_FK} ORDER BY timestamp)))
      / 1e6 AS gap FROM f),
s AS (SELECT {_FK}, count(*) AS packets, avg(gap) AS m, stddev_samp(gap) AS sd FROM d GROUP BY {_FK})
SELECT {_FK}, packets, round(m, 6) AS mean_interval_s, round(sd, 6) AS stddev_interval_s, round(sd / m, 6) AS cv
FROM s WHERE packets >= 5 AND m > 0 AND sd / m <= 0.1"""),
    "flow_top_by_packets": packets(
        lambda p: _ports(flow.get_top_flows_by_packets(p)), f"{_FLOWS} SELECT * FROM g ORDER BY packet_count DESC, flow_id LIMIT 10"),
    "flow_top_by_bytes": packets(
        lambda p: _ports(flow.get_top_flows_by_bytes(p)), f"{_FLOWS} SELECT * FROM g ORDER BY byte_count DESC, flow_id LIMIT 10"),
    "flow_packets_per_second": packets(
        flow.calculate_packets_per_second,
        f"SELECT {bucket('1 minute')} AS window_start, count(*) AS packet_count, round(count(*) / 60.0, 6) "
        "AS packets_per_second FROM p GROUP BY 1"),
    "flow_bytes_per_second": packets(
        flow.calculate_bytes_per_second,
        f"SELECT {bucket('1 minute')} AS window_start, CAST(coalesce(sum(IP_len), 0) AS BIGINT) AS byte_count, "
        "round(coalesce(sum(IP_len), 0) / 60.0, 6) AS bytes_per_second FROM p GROUP BY 1"),
    "flow_inter_arrival_by_flow": packets(
        lambda p: _ports(flow.calculate_inter_arrival_times(p, "flow")), _gaps(_FK)),
    "flow_inter_arrival_by_source": packets(lambda p: flow.calculate_inter_arrival_times(p, "src_ip"), _gaps("src_ip")),
    "flow_inter_arrival_by_destination": packets(
        lambda p: flow.calculate_inter_arrival_times(p, "dst_ip"), _gaps("dst_ip")),
    "flow_inter_arrival_global": packets(
        lambda p: flow.calculate_inter_arrival_times(p, "global"), _gaps("", "WITH a AS (SELECT timestamp FROM p)", "a")),
    "flow_periodic_patterns": packets(
        lambda p: flow.detect_periodic_patterns(p, min_strength=0.005), """
WITH f AS (SELECT IP_src AS src_ip, epoch_us(timestamp) // 1000000 AS t, count(*) AS x FROM p WHERE IP_src IS NOT NULL
           GROUP BY 1, 2),
b AS (SELECT src_ip, level, t // CAST(pow(10, level) AS BIGINT) AS t, sum(x) AS x
      FROM (SELECT *, unnest(range(0, 7)) AS level FROM f) GROUP BY ALL),
s AS (SELECT src_ip, level, sum(x) AS n, sum(x * x) AS xx, max(t) - min(t) + 1 AS bins FROM b GROUP BY 1, 2),
c AS (SELECT a.src_ip, a.level, z.t - a.t AS lag, sum(a.x * z.x) AS c FROM b a JOIN b z ON a.src_ip = z.src_ip
      AND a.level = z.level AND z.t > a.t AND z.t <= a.t + 300 GROUP BY ALL),
r AS (SELECT src_ip, level, lag, (c - (n / bins) * (n / bins) * (bins - lag)) / (xx - (n / bins) * (n / bins) * bins) AS st
      FROM c JOIN s USING (src_ip, level) WHERE bins - 1 >= lag * 3 AND (level = 0 OR lag > 30)
      AND xx - (n / bins) * (n / bins) * bins <> 0)
SELECT src_ip, lag * pow(10.0, level) AS period_s, round(round(st, 9), 6) AS strength FROM r WHERE st >= 0.005
QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY level, round(st, 9) DESC, lag) = 1"""),
}

_PORT = "coalesce(TCP_dport, UDP_dport)"
_SEQ = """
l AS (SELECT {key}, v - lag(v) OVER (PARTITION BY {key} ORDER BY v) AS step FROM d),
q AS (SELECT {key}, count(*) AS n, CASE WHEN count(*) = 1 THEN 0.0 ELSE count(*) FILTER (WHERE step = 1)
      / (count(*) - 1) END AS share FROM l GROUP BY {key})
"""
ANOMALY = {
    "anomaly_port_scans": packets(
        lambda p: anomaly.detect_port_scanning(p, threshold=25, time_window="1m"),
        _scan(f"{_PORT} IS NOT NULL", _PORT, "1 minute", 25)),
    "anomaly_host_scans": packets(
        lambda p: anomaly.detect_host_scanning(p, 1, "1h"),
        f"SELECT {bucket('1 hour')} AS window_start, IP_src AS src_ip, {_PORT} AS dst_port, "
        f"count(DISTINCT IP_dst) AS unique_hosts FROM p WHERE {_PORT} IS NOT NULL GROUP BY ALL "
        "HAVING count(DISTINCT IP_dst) > 1"),
    "anomaly_vertical_scans": packets(
        lambda p: anomaly.detect_vertical_scanning(p, 5), f"""
WITH d AS (SELECT DISTINCT IP_src AS src_ip, {_PORT} AS dst_port, CAST(split_part(IP_dst,'.',1) AS BIGINT)*16777216
  + CAST(split_part(IP_dst,'.',2) AS BIGINT)*65536 + CAST(split_part(IP_dst,'.',3) AS BIGINT)*256
  + CAST(split_part(IP_dst,'.',4) AS BIGINT) AS v FROM p WHERE {_PORT} IS NOT NULL AND IP_dst IS NOT NULL),
{_SEQ.format(key='src_ip, dst_port')}
SELECT src_ip, dst_port, n AS unique_hosts, round(share, 6) AS sequential_share FROM q WHERE n > 5"""),
    "anomaly_horizontal_scans": packets(
        lambda p: anomaly.detect_horizontal_scanning(p, 50), f"""
WITH d AS (SELECT DISTINCT IP_src AS src_ip, IP_dst AS dst_ip, CAST({_PORT} AS BIGINT) AS v FROM p
           WHERE {_PORT} IS NOT NULL AND IP_src IS NOT NULL AND IP_dst IS NOT NULL),
{_SEQ.format(key='src_ip, dst_ip')}
SELECT src_ip, dst_ip, n AS unique_ports, round(share, 6) AS sequential_share FROM q WHERE n > 50"""),
    "anomaly_syn_flood": packets(
        lambda p: anomaly.detect_syn_flood(p, 2, "1h"), f"""
WITH s AS (SELECT {bucket('1 hour')} AS window_start, IP_src AS src_ip, count(*) AS syn_count FROM p
           WHERE {_S} AND NOT {_A} GROUP BY ALL),
a AS (SELECT {bucket('1 hour')} AS window_start, IP_dst AS src_ip, count(*) AS acks FROM p WHERE {_S} AND {_A} GROUP BY ALL)
SELECT window_start, src_ip, syn_count, coalesce(acks, 0) AS syn_ack_received, syn_count - coalesce(acks, 0) AS imbalance
FROM s LEFT JOIN a USING (window_start, src_ip) WHERE syn_count > 2"""),
    "anomaly_udp_flood": packets(lambda p: anomaly.detect_udp_flood(p, 1, "1h"), _udp_flood(1, ">")),
    "anomaly_land_attack": changed(
        lambda p: _known_ports(anomaly.detect_land_attack(p)),
        {"IP_dst": "CASE WHEN raw_size % 31 = 5 THEN IP_src ELSE IP_dst END",
         "TCP_dport": "CASE WHEN raw_size % 62 = 5 THEN TCP_sport ELSE TCP_dport END"},
        "SELECT timestamp, IP_src AS src_ip, IP_dst AS dst_ip, coalesce(TCP_sport, UDP_sport, -1) AS src_port, "
        f"coalesce({_PORT}, -1) AS dst_port, coalesce(TCP_sport, UDP_sport) IS NOT DISTINCT FROM {_PORT} AS same_port FROM q "
        "WHERE IP_src = IP_dst"),
    "anomaly_tiny_fragments": packets(
        lambda p: anomaly.detect_tiny_fragments(p).select(*_WIDE, "IP_flags", "IP_frag"),
        f"SELECT {_WIDE_SQL}, IP_flags, IP_frag FROM p WHERE {_FRAGMENT} AND IP_len < 60"),
    "anomaly_null_scan": packets(
        lambda p: anomaly.detect_null_scan(p).select(*_WIDE, "TCP_dport"),
        f"SELECT {_WIDE_SQL}, TCP_dport FROM p WHERE {_TCP} AND TCP_dport IS NOT NULL AND coalesce(TCP_flags, '') = ''"),
    "anomaly_xmas_scan": packets(
        lambda p: anomaly.detect_xmas_scan(p).select(*_WIDE, "TCP_dport", "TCP_flags"),
        f"SELECT {_WIDE_SQL}, TCP_dport, TCP_flags FROM p WHERE TCP_flags = 'FPU'"),
    "anomaly_traffic_bursts": packets(
        anomaly.detect_traffic_bursts, f"""
WITH c AS (SELECT {bucket('1 minute')} AS window_start, count(*) AS packets FROM p GROUP BY 1),
s AS (SELECT avg(packets) AS m, stddev_samp(packets) AS sd FROM c)
SELECT window_start, packets, round(m, 6) AS mean, round(sd, 6) AS std, round((packets - m) / sd, 6) AS z
FROM c, s WHERE packets > m + 3 * sd"""),
    "anomaly_unusual_protocols": packets(
        lambda p: anomaly.detect_unusual_protocols(p, 0.2), """
WITH c AS (SELECT IP_proto, count(*) AS count FROM p WHERE IP_proto IS NOT NULL GROUP BY 1)
SELECT IP_proto, CASE IP_proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' END AS name, count,
  round(share, 6) AS share FROM (SELECT *, count / sum(count) OVER () AS share FROM c) WHERE share < 0.2"""),
    "anomaly_off_hours": packets(
        anomaly.detect_off_hours_activity,
        "SELECT IP_src AS src_ip, count(*) AS packets, CAST(coalesce(sum(IP_len), 0) AS BIGINT) AS bytes, "
        "min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM p WHERE IP_src IS NOT NULL "
        "AND (hour(timestamp) < 9 OR hour(timestamp) >= 17) GROUP BY 1"),
    "anomaly_data_exfiltration": packets(
        lambda p: anomaly.detect_data_exfiltration(p, 2000), f"""
SELECT IP_src AS src_ip, CAST(sum(IP_len) AS BIGINT) AS outbound_bytes, count(*) AS packets,
  count(DISTINCT IP_dst) AS unique_destinations FROM p WHERE IP_src IS NOT NULL AND {_SP} AND NOT {_DP}
GROUP BY 1 HAVING sum(IP_len) > 2000"""),
}

ENTRIES = TCP | UDP | IP | DNS | ICMP | ARP | FLOW | ANOMALY
